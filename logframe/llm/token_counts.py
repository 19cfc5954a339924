"""Token counts of texts of any length, by overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks. Two neighbouring chunks are
spliced at a boundary inside their overlap that is provably stable: both encodings have
a token boundary there, and it stands between a visible character and white space. No
pattern of the vocabulary's word splitter matches across such a place from either side,
so tokens before it do not depend on the text after it, and the other way round. Where
an overlap holds no such boundary, it is widened until it does or the text ends.

Counts equal those of the whole text in one piece. The vocabulary file is read for its
ranks and special tokens; its splitter must be the plain byte-level one, whose pattern is
``PATTERN``, without normaliser: any other file is refused, as its counts would be wrong.

A null text counts as empty and has no tokens. The end-of-text string inside a text is one
token, as the library's default. Repeated rows give repeated results; an empty table gives
an empty one; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, LIMIT = 32_768, 256, 1024
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def check_spec(spec: dict) -> None:
    """ValueError for a tokenizer that splits, changes or merges texts otherwise than this module does."""
    splitter = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    plain = [("type", "BPE"), *[(k, None) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")]]
    wrong = [k for k, v in plain if model.get(k) != v and not (v is None and model.get(k) == "")]
    wrong += [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if spec.get("normalizer") is not None:
        wrong.append("normalizer")
    if (splitter.get("type"), splitter.get("use_regex", True), splitter.get("add_prefix_space")) != ("ByteLevel", True, False):
        wrong.append("pre_tokenizer")
    wrong += [t["content"] for t in spec.get("added_tokens") or [] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if wrong:
        raise ValueError(f"not a plain byte-level vocabulary: {', '.join(wrong)}")


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level tokenizer file as an encoder with the same splits and ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    check_spec(spec)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # ids run in the order of the merges, so they serve as ranks
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.encoder, self.chunk, self.overlap = encoder(path), chunk, overlap
        lengths = {i: len(b) for b, i in self.encoder._mergeable_ranks.items()} | {i: len(s) for s, i in self.encoder._special_tokens.items()}
        self.lengths = np.zeros(max(lengths) + 1, dtype=np.int64)
        self.lengths[list(lengths)] = list(lengths.values())

    def ids(self, text: str) -> list[int]:
        return self.encoder.encode(text, allowed_special="all")

    def pieces(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, piece by piece: one piece unless it is longer than a chunk."""
        text, begin = text or "", 0
        while len(text) - begin > self.chunk:
            stop, overlap, found = begin + self.chunk, self.overlap, None
            while not found and stop + overlap < len(text):
                found = self.splice(text, begin, stop, stop + overlap)
                overlap *= 2
            if not found:
                break
            yield found[0]
            begin = found[1]
        yield self.ids(text[begin:])

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text)))

    def encode(self, text: str | None) -> list[int]:
        return [i for piece in self.pieces(text) for i in piece]

    def splice(self, text: str, begin: int, stop: int, end: int) -> tuple[list[int], int] | None:
        """Of the chunks [begin, end) and [stop, ...): the first's ids up to a stable common
        boundary, and where that stands; None if the overlap [stop, end) has none."""
        places = [p for p in range(stop + 1, end) if text[p].isspace() and not text[p - 1].isspace() and not "\x1c" <= text[p] <= "\x1f"]
        if not places:
            return None
        ids = self.ids(text[begin:end])
        first, second = self.ends(ids), self.ends(self.ids(text[stop:end]))
        # the last place may touch a token that only the text beyond the chunk completes
        for p in places[:-1]:
            at, back = len(text[begin:p].encode()), len(text[stop:p].encode())
            i, j = np.searchsorted(first, at), np.searchsorted(second, back)
            if i < len(first) and j < len(second) and first[i] == at and second[j] == back:
                return ids[: int(i) + 1], p
        return None

    def ends(self, ids: list[int]) -> np.ndarray:
        """Byte offset behind each token."""
        return np.cumsum(self.lengths[np.array(ids, dtype=np.int64)])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches):
        c = counter(path)
        for batch in batches:
            n = pa.array([c.count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

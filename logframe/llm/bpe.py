"""Byte-pair encoding by batched numpy merge rounds, and decoding.

The symbols of all words that a batch has not met before lie in one flat array. Every
round looks all adjacent pairs up by binary search over the sorted pair keys of the
merge table, takes the lowest rank of each word, and merges its occurrences in all words
at once. Whole texts are read; a null text counts as empty and has no ids. A text of any
length is cut at white space, so its words, not the text, are merged. A task remembers the
ids of at most ``REMEMBERED`` stretches with ``CHARACTERS`` characters, and those of the block
of texts at hand; at its end it forgets them, as its worker lives on beside other stages. Special
tokens written in a text are matched before normalisation, as the vocabulary file says.
Repeated rows give repeated results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import release, with_fields

#: Characters with the Unicode property White_Space.
SPACES = "\t-\r \x85\xa0  -     　"
#: Separators that str.split() takes for white space and the property does not.
ODD_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks that a task remembers before it starts anew, and their characters.
REMEMBERED, CHARACTERS = 300_000, 4_000_000
#: Characters of the texts that are encoded together.
BLOCK = 1_000_000
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable, else the next code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
    return [chr(moved.get(b, b)) for b in range(256)]


class WordBpe:
    """A byte-level vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.specials).items()}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", SPACES)).findall
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.spaced = re.compile(f"[^{SPACES}]+").findall
        symbols = byte_symbols()
        self.first = np.array([self.vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([self.vocab[s + self.end] for s in symbols], dtype=np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.known: dict[str | tuple[str], tuple[int, str, str]] = {}
        self.held = 0

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Ids of every word (none empty), by rounds of merges over all of them together."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbol = self.first[flat]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbol) > 1:
            key = np.where(word[1:] == word[:-1], (symbol[:-1] << 32) | symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank = np.append(np.where(hit, self.ranks[at], NO_RANK), NO_RANK)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, begins)
            lowest = np.repeat(least, np.diff(np.append(begins, len(symbol))))
            idle = lowest == NO_RANK
            if idle.any():  # words without a pair to merge are finished
                done_symbols.append(symbol[idle])
                done_words.append(word[idle])
                keep = ~idle
                symbol, word, rank, lowest = symbol[keep], word[keep], rank[keep], lowest[keep]
                at = np.append(at, 0)[keep]
            else:
                at = np.append(at, 0)
            if not len(symbol):
                break
            left = np.flatnonzero(rank == lowest)
            # of overlapping pairs (a run of one symbol) every second one merges, from the left
            run = np.cumsum(np.append(True, np.diff(left) != 1)) - 1
            place = left - left[np.append(True, np.diff(left) != 1)][run]
            left = left[place % 2 == 0]
            symbol[left] = self.made[at[left]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[left + 1] = False
            symbol, word = symbol[keep], word[keep]
        done_symbols.append(symbol)
        done_words.append(word)
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        cuts = np.cumsum(np.bincount(word, minlength=len(words)))[:-1]
        return [part.tolist() for part in np.split(symbol[order], cuts)]

    def chunks(self, text: str | None) -> list[str | tuple[str]]:
        """White-space separated, normalised stretches of a text, with special tokens on their own, each in a tuple.

        No piece crosses white space, so a stretch always has the same ids.
        """
        text = text or ""
        parts = self.special_split.split(text) if any(s in text for s in self.specials) else [text]
        out: list[str | tuple[str]] = []
        for part in parts:
            if part in self.specials:
                out.append((part,))
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            part = part.replace("Σ", "σ").lower()  # one character at a time: no final sigma
            # a text may spell a special token so that only lower-casing shows it: that is a stretch like any other
            out += self.spaced(part) if ODD_SEPARATORS.search(part) else part.split()
        return out

    def learn(self, chunks: set[str | tuple[str]]) -> None:
        """Encode the chunks that are not known yet."""
        if len(self.known) > REMEMBERED or self.held > CHARACTERS:
            self.forget()
        new = [c for c in chunks if c not in self.known]
        spelled = [() if isinstance(c, tuple) else self.pieces(c) for c in new]
        words = list(dict.fromkeys(w for s in spelled for w in s))
        ids = dict(zip(words, self.merge_words(words), strict=True)) if words else {}
        for c, s in zip(new, spelled, strict=True):
            own = [self.specials[c[0]]] if isinstance(c, tuple) else [i for w in s for i in ids[w]]
            self.known[c] = (len(own), " ".join(map(str, own)), self.decode(own))
        self.held += sum(map(len, new))

    def forget(self) -> None:
        """Drop what is remembered of texts; the vocabulary stays."""
        self.known, self.held = {}, 0

    def decode(self, ids) -> str:
        """The tokens of the ids, joined by blanks: the file names no decoder that would do more."""
        return " ".join([self.tokens[i] for i in ids])

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of each text."""
        split = [self.chunks(t) for t in texts]
        self.learn({c for s in split for c in s})
        known = self.known
        for s in split:
            got = [known[c] for c in s]
            yield sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def _blocks(column: pa.Array, characters: int = BLOCK) -> Iterator[list]:
    """The values of a text column in lists of a bounded number of characters, one text at least."""
    block, held = [], 0
    for value in column:
        block.append(text := value.as_py())
        held += len(text or "")
        if held >= characters:
            yield block
            block, held = [], 0
    if block:
        yield block


def _encoded(path: str, batches: Iterator[pa.RecordBatch], where: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, str, str]]]]:
    """(rows, what ``WordBpe.texts`` gives for their texts) for a block at a time; nothing of a task's texts stays in its worker."""
    c = codec(path)
    try:
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(where)):
                yield batch.slice(at, len(block)), list(c.texts(block))
                at += len(block)
    finally:
        c.forget()
        release()


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches):
        for batch, texts in _encoded(path, batches, 1):
            rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()) for n, ids, back in texts]
            n, ids, back = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``n_tokens`` long; columns of these names are replaced."""
    kept = docs.drop("ids", "n_tokens")
    schema = with_fields(kept.schema, "ids array<int>, n_tokens long")
    where = kept.columns.index(text)

    def run(batches):
        for batch, texts in _encoded(path, batches, where):
            ids = [np.array(s.split(), dtype=np.int32) for _, s, _ in texts]
            arrays = [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "ids", "n_tokens"])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` string in place of its ids; null ids decode to an empty text."""
    kept = encoded.drop("decoded")
    schema = with_fields(kept.schema, "decoded string")
    where = kept.columns.index(ids)

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(v.as_py() or ()) for v in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)

"""Chat formatting of conversations with typed content parts.

A visitor walks the parts of each turn in order. Text is written as it is, with control
characters escaped; image, audio and document parts become placeholders with a running
attachment number, and their references and expanded token counts are recorded.

Template of a turn: ``<turn ROLE>`` TEXT ``</turn>`` and a line break. Inside roles and
texts a backslash, ``<`` and ``>`` get a backslash before them, so no text can spell a
control string, and reading the output gives every text back.

Turns are ordered by (turn, role, parts), that is by text where a part is a text. A null text or part is an empty text, a null
role an empty role; turns with a null number come first. Rows of a null conversation id
form one conversation. Repeated rows are repeated turns. Extra columns are ignored; an
empty table gives an empty result. A part of an unknown type becomes a placeholder, too.
A conversation is read as a stream of sorted turns: its formatted pieces, spans and
digests are written piece by piece, so a long conversation never stands in memory whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPED = re.compile(r"([\\<>])")
UNESCAPED = re.compile(r"\\([\\<>])")
PIECE = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.|<attachment \w+ \d+>)*)</turn>\n", re.S)
MARK = re.compile(r"<attachment \w+ \d+>")
KINDS, NAME = ("text", "image", "audio", "document"), re.compile(r"[^A-Za-z0-9_]")
#: Tokens of an attachment: an image's 14-pixel patches, audio's 20 ms frames, a document's pages.
PATCH, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 14, 50, 512
TEST_TURN = "\\### Assistant: </turn> ok"
PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens one turn's parts; ``number`` runs on over the conversation."""

    def __init__(self, number: int = 0):
        self.number, self.text, self.attachments = number, [], []

    def visit(self, part: dict | None) -> None:
        part = part or {}
        kind = part.get("type") or "text"
        (getattr(self, f"visit_{kind}") if kind in KINDS else self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(escape(part.get("text") or ""))

    def visit_unknown(self, part: dict) -> None:
        """A part of another type: a placeholder under its type's letters, digits and underscores, of one token."""
        self.attach({**part, "type": NAME.sub("_", part["type"]) or "_"}, 1)

    def attach(self, part: dict, tokens: float) -> None:
        self.text.append(f"<attachment {part['type']} {self.number}>")
        self.attachments.append({"number": self.number, "type": part["type"], "uri": part.get("uri"), "tokens": max(1, math.ceil(tokens))})
        self.number += 1

    def visit_image(self, part: dict) -> None:
        self.attach(part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, (part.get("seconds") or 0) * FRAMES_PER_SECOND)

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part.get("pages") or 0) * TOKENS_PER_PAGE)


def format_turn(role: str | None, parts: list[dict | None], number: int = 0) -> tuple[str, int, int, list[dict]]:
    """(piece, begin and end of the text inside it, attachments) of one turn."""
    visitor = PartVisitor(number)
    for part in parts or []:
        visitor.visit(part)
    head, body = f"<turn {escape(role or '')}>", "".join(visitor.text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body), visitor.attachments


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; placeholders are left out."""
    at = 0
    while at < len(formatted):
        m = PIECE.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(MARK.sub("", m[2]))
        at = m.end()


def format_conversations(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, parts) as pieces of their conversations' formatted texts.

    conv_id, seq (0-based position), piece, span_begin and span_end (code points in the
    conversation's text that count for the loss; null unless the role is assistant),
    attachments array<struct<number,type,uri,tokens>>. Joining a conversation's pieces
    in the order of ``seq`` gives its text.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.col("parts").cast(PARTS).alias("parts"))
    # parts order by type, then text, as they stand: no key is made of them before the shuffle
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), "parts")
    schema = "conv_id long, seq long, piece string, span_begin long, span_end long, attachments array<struct<number:int,type:string,uri:string,tokens:int>>"
    kind = pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int32())]))

    def run(batches):
        now, seq, at, number = object(), 0, 0, 0
        for batch in batches:
            out = []
            for conv, role, parts in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                if conv != now:
                    now, seq, at, number = conv, 0, 0, 0
                piece, begin, end, found = format_turn(role, parts, number)
                loss = role == "assistant"
                out.append((conv, seq, piece, at + begin if loss else None, at + end if loss else None, found))
                seq, at, number = seq + 1, at + len(piece), number + len(found)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), kind]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "seq", "piece", "span_begin", "span_end", "attachments"])

    return ordered.select("conv_id", "role", "parts").mapInArrow(run, schema)


def text_parts(conversations: DataFrame) -> DataFrame:
    """Rows with plain ``text`` as turns of one text part."""
    names = ["uri", "width", "height", "seconds", "pages"]
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *[F.lit(None).cast(k).alias(n) for n, k in zip(names, ["string", "int", "int", "double", "int"], strict=True)],
    )
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted pieces gives: one row per conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The spans
    cut the loss text out of the stream of pieces, so they are checked as written.
    """

    def run(batches):
        now, state = object(), None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def row():
            n, turns, chars, loss, size = state
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def emit(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for conv, piece, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if state:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    masked = unescape(MARK.sub("", piece[begin - state[4] : end - state[4]]))
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(piece)
            if out:
                yield emit(out)
        if state:
            yield emit([row()])

    ordered = formatted.select("conv_id", "seq", "piece", "span_begin", "span_end").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.select("conv_id", "piece", "span_begin", "span_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def with_test_conversation(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts spell control strings."""
    rows = [(-7, 0, "user", TEST_TURN), (-7, 1, "assistant", TEST_TURN)]
    own = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(own)


def oracle(conversations: str = "conversations") -> str:
    """DuckDB SQL for the digests of the formatted table with the test conversation."""
    test = TEST_TURN.replace("'", "''")
    esc = lambda x: f"(length({x}) + length({x}) - length(translate({x}, '\\<>', '')))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{test}'), (-7, 1, 'assistant', '{test}')) v)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum({esc("role")} + {esc("text")} + length('<turn >' || '</turn>') + 1)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id"""

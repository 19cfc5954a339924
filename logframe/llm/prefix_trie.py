"""The prefix trie of conversations, with a count-min screen before anything is grouped.

Turns are numbered by one range sort, in which a conversation may lie in many tasks. The digest of a prefix is the
exclusive or of 128-bit hashes of (place, role, text) of its turns, so it is summed inside blocks of a conversation
and carried over them: no task holds a conversation. A count-min sketch of the prefix digests says of most prefixes
that one conversation alone has them (its estimate is never too small): such tails are written out where they stand.
Only prefixes that may be shared, and the first turn of each tail, are shuffled, and grouped exactly by their digests.

The sketch's width follows the number of prefixes up to ``WIDTH`` cells, so what is broadcast is bounded (one bit a
cell). On larger inputs more lone prefixes pass for shared ones and are grouped; the result is the same.

Leaves below a node and what it saves are sums over paths: every leaf has one conversation that stands for it, and
every shared node's saving is booked on one of those. Sums along that conversation's path, then a sum over the
conversations of a node, give the node's totals, however deep the trie is.

Turns are ordered by (turn, role, text), null turns first; a null role or text is empty. Repeated rows are repeated
turns. Rows without a conversation id belong to no conversation and are left out. A conversation without turns is a
member of the root. No conversations give no nodes. Extra columns are ignored. Rows that agree in conversation, turn,
role and the first 64 characters are sorted by one task, on disk where they are many.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logframe.llm.common import Scratch, release
from logframe.llm.sharding import mix64

#: Conversations that share a base, and how many turns of it at most (one less).
EVERY, HEADS = 20, 4
#: Turns of a block of one conversation.
BLOCK = 65_536
#: Rows of the count-min sketch, its cells in a row at most, cells of a piece that travels.
ROWS, WIDTH, PIECE = 4, 1 << 24, 1 << 16
#: Ids that are joined to one text.
IDS = 4096
#: Rows of a small table that is broadcast after it was counted.
BROADCAST = 200_000
SHARED, FIRST, TAIL = 0, 1, 2
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "x", "y"]


# --- turns


def number_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, place, a, b, words) of every turn: its place from 0, two hashes of role and text, the words of its text."""
    spark = conversations.sparkSession
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turn = F.asc_nulls_first("turn")
    # a text's beginning orders as the text does, and keeps the borders that the driver gets small
    dealt = rows.repartitionByRange("conv_id", turn, F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions("conv_id", turn, "role", "text")
    hashed = dealt.select("conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit("|"), "role").alias("b"), F.regexp_count("text", F.lit(r"[^ \t-\r]+")).cast("long").alias("words"))

    def run(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            begins = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            sizes = np.diff(np.append(begins, len(conv)))
            at = np.arange(len(conv)) - np.repeat(begins, sizes)
            if conv[0] == last:
                at[: sizes[0]] += seen
            last, seen = conv[-1], at[-1] + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), pa.array(at), *batch.columns], names=["part", "at", "conv_id", "a", "b", "words"])
        release()

    turns = scratch.keep(hashed.mapInArrow(run, "part long, at long, conv_id long, a long, b long, words long"), "turns")
    # a row for each task: where its first conversation began in earlier tasks
    ends = turns.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("last")).orderBy("part").collect()
    moved, before = [], {}
    for past, now in zip(ends, ends[1:], strict=False):
        if past["last"]["conv_id"] == now["first"]:
            held = before.get(past["part"], 0) if past["first"] == now["first"] else 0
            before[now["part"]] = past["last"]["at"] + 1 + held
            moved.append((now["part"], now["first"], before[now["part"]]))
    if not moved:
        return turns.select("conv_id", F.col("at").alias("place"), "a", "b", "words")
    starts = F.broadcast(spark.createDataFrame(moved, "part long, conv_id long, start long"))
    return turns.join(starts, ["part", "conv_id"], "left").select("conv_id", (F.col("at") + F.coalesce("start", F.lit(0))).alias("place"), "a", "b", "words")


def _sized(small: DataFrame, bound: int = BROADCAST) -> DataFrame:
    """A stored table, for a broadcast if it is counted and found small enough."""
    return F.broadcast(small) if small.count() <= bound else small


def share_heads(turns: DataFrame, scratch: Scratch, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns with the first of their base's in place of their own, and the conversations (conv_id, n_turns).

    Conversation c takes the first h turns of conversation c - c % every, h = crc32(c) % heads, then its own after its first h.
    """
    conv = F.col("conv_id")
    base = conv - conv % every
    own = F.when(base == conv, 0).otherwise(F.crc32(conv.cast("string").cast("binary")) % heads)
    turn = F.struct("place", "a", "b", "words")
    bases = turns.filter((conv % every == 0) & (F.col("place") < heads - 1)).groupBy(conv.alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    counted = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": base, "h": own})
    known = counted.join(bases, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,a:bigint,b:bigint,words:bigint>>")), F.lit(1), F.col("h").cast("int")))
    taken = F.size("head").cast("long")
    convs = scratch.keep(known.select("conv_id", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"), "head"), "conversations")
    shifted = _sized(scratch.keep(convs.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("shift")), "shifted"))
    kept = turns.filter(F.col("place") >= own).join(shifted, "conv_id", "left")
    kept = kept.select("conv_id", (F.col("place") - F.coalesce("shift", F.lit(0))).alias("place"), "a", "b", "words")
    lent = convs.filter("taken > 0").select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    return kept.unionByName(lent), convs.select("conv_id", "n_turns")


# --- prefixes


def prefixes(turns: DataFrame, convs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, x, y, px, py, words, more): the digest of the first ``depth`` turns and of one turn less, the
    last one's words, and whether more turns follow."""
    at = turns.withColumn("depth", F.col("place") + 1).withColumns({
        "hx": F.xxhash64("depth", "a", "b"), "hy": F.xxhash64(F.lit(1), "b", "depth", "a"), "block": F.floor(F.col("place") / block),
    })
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = at.withColumns({"x": F.bit_xor("hx").over(to_here), "y": F.bit_xor("hy").over(to_here), "more": F.lead("depth").over(inside).isNotNull()})
    long = convs.filter(F.col("n_turns") > block)
    if not long.isEmpty():  # conversations of more than one block: at most one for each ``block`` turns
        sums = at.join(_sized(long), "conv_id").groupBy("conv_id", "block", "n_turns").agg(F.bit_xor("hx").alias("sx"), F.bit_xor("hy").alias("sy"))
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carry = sums.select("conv_id", "block", "n_turns", F.coalesce(F.bit_xor("sx").over(earlier), F.lit(0)).alias("cx"), F.coalesce(F.bit_xor("sy").over(earlier), F.lit(0)).alias("cy"))
        rows = rows.join(_sized(scratch.keep(carry, "carry")), ["conv_id", "block"], "left")
        rows = rows.withColumns({
            "x": F.col("x").bitwiseXOR(F.coalesce("cx", F.lit(0))), "y": F.col("y").bitwiseXOR(F.coalesce("cy", F.lit(0))),
            "more": F.coalesce(F.col("depth") < F.col("n_turns"), "more"),
        })
    return rows.select("conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "words", "more")


# --- the count-min screen


def cells(x: np.ndarray, y: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = mix64(x.view(np.uint64) ^ mix64(y.view(np.uint64) + np.uint64(row * 0x51ED27)))
    return (mixed & np.uint64(width - 1)).astype(np.int64)


def width_for(n: int, most: int = WIDTH) -> int:
    """A power of two: two cells or more for each prefix, up to ``most``."""
    return min(most, max(1 << 10, 1 << (2 * n).bit_length()))


def crowded(rows: DataFrame, width: int) -> list[np.ndarray]:
    """For each row of the sketch of the digests (x, y), one bit a cell: its count is 2 or more.

    Tasks count into sketches of their own, which stop at 2; pieces of these are added up by piece.
    """
    piece = min(PIECE, width)

    def count(batches):
        seen = np.zeros((ROWS, width), dtype=np.uint8)
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row in range(ROWS):
                at, n = np.unique(cells(x, y, row, width), return_counts=True)
                seen[row, at] = np.minimum(2, seen[row, at] + n)
        for row in range(ROWS):
            for k in range(0, width, piece):
                part = seen[row, k : k + piece]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k // piece]), pa.array([zlib.compress(part.tobytes(), 1)])], names=["row", "piece", "data"])
        release()

    def add(batches):
        now, total = None, np.zeros(piece, dtype=np.uint8)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([np.packbits(total > 1).tobytes()])], names=["row", "piece", "data"])

        for batch in batches:
            for row, k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (row, k):
                    if now:
                        yield flush()
                    now, total = (row, k), np.zeros(piece, dtype=np.uint8)
                total = np.minimum(2, total + np.frombuffer(zlib.decompress(data), dtype=np.uint8))
        if now:
            yield flush()

    kind = "row long, piece long, data binary"
    merged = rows.select("x", "y").mapInArrow(count, kind).repartition("row", "piece").sortWithinPartitions("row", "piece").mapInArrow(add, kind)
    bits = [np.zeros(max(1, width // 8), dtype=np.uint8) for _ in range(ROWS)]
    for r in merged.toLocalIterator():  # ROWS * width / 8 bytes at most
        bits[r["row"]][r["piece"] * piece // 8 : (r["piece"] + 1) * piece // 8] = np.frombuffer(bytes(r["data"]), dtype=np.uint8)
    return bits


def screened(rows: DataFrame, bits: list[np.ndarray], width: int) -> DataFrame:
    """``rows`` of :func:`prefixes` with ``kind``: may be shared, first of a tail, or further down a tail."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def shared(x, y):
        out = np.ones(len(x), dtype=bool)
        for row, own in enumerate(held.value):
            at = cells(x, y, row, width)
            out &= (own[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out

    def run(batches):
        for batch in batches:
            depth, x, y, px, py = (batch.column(i).to_numpy() for i in range(1, 6))
            kind = np.where(shared(x, y), SHARED, np.where((depth == 1) | shared(px, py), FIRST, TAIL))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.int32())], names=[*batch.schema.names, "kind"])
        release()

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", kind int")


# --- the trie


def _digest_of_ids(enders: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256): of each node's ids in ascending order, joined by commas.

    Stretches of ``IDS`` ids become texts first; a node's texts are then read in order as a stream.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = enders.groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("stretch")).agg(text.alias("ids"))

    def run(batches):
        now, state = None, None
        names = [*NODE, "ends_sha256"]

        def row():
            return (*now, state.hexdigest())

        def table(out):
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != now:
                    if now:
                        out.append(row())
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield table(out)
        if now:
            yield table([row()])

    ordered = texts.repartition(*NODE).sortWithinPartitions(*NODE, "stretch").select(*NODE, "ids")
    return ordered.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def _sums_to_the_end(rows: DataFrame, convs: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """``rows`` (conv_id, depth, x, y, value) with ``total``: the values of the conversation's rows from this depth on."""
    cut = rows.withColumn("block", F.floor(F.col("depth") / block))
    deeper = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.withColumn("total", F.sum("value").over(deeper))
    long = convs.filter(F.col("n_turns") >= block).select("conv_id")
    if not long.isEmpty():
        sums = cut.join(_sized(long), "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.sum("value").alias("s"))
        later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        carry = scratch.keep(sums.select("conv_id", "block", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("later")), "later")
        out = out.join(_sized(carry), ["conv_id", "block"], "left").withColumn("total", F.col("total") + F.coalesce("later", F.lit(0)))
    return out


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = scratch.keep(prefixes(turns, convs, scratch, block), "prefixes")
    cells_ = width_for(paths.count(), width)
    rows = scratch.keep(screened(paths, crowded(paths, cells_), cells_), "screened", by="kind")
    shared, first, tail = (rows.filter(F.col("kind") == k).drop("kind") for k in (SHARED, FIRST, TAIL))

    # the root is a node like the others: every conversation's prefix of no turns
    top = [F.lit(0).cast("long").alias(c) for c in NODE]
    root = convs.select("conv_id", *top, (F.col("n_turns") > 0).alias("more"))
    grouped = shared.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("px").alias("px"), F.max("py").alias("py"))
    origin = root.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).withColumns({"words": F.lit(0).cast("long"), "px": F.lit(None).cast("long"), "py": F.lit(None).cast("long")})
    nodes = scratch.keep(grouped.unionByName(origin), "nodes")

    up = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    kids = nodes.filter("depth > 0").select(*up).unionByName(first.select(*up)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    counted = scratch.keep(nodes.join(kids, NODE, "left").fillna(0, ["n_children"]), "counted")

    # one conversation stands for each leaf: the owner of a lone tail, or the smallest of those that end in a shared leaf
    standing = first.select("conv_id").unionByName(counted.filter("n_children = 0").select("conv_id"))
    walked = shared.select("conv_id", *NODE).unionByName(root.select("conv_id", *NODE)).join(standing, "conv_id", "left_semi")
    walked = scratch.keep(walked, "walked")
    leaves = walked.groupBy(*NODE).agg(F.count("*").alias("n_leaves"), F.min("conv_id").alias("standing"))
    booked = counted.join(leaves, NODE)
    booked = scratch.keep(booked, "booked")
    worth = (F.col("n_convs") - 1) * F.col("words")
    values = booked.filter(worth > 0).select(F.col("standing").alias("conv_id"), "depth", F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y"), worth.alias("value"))
    path = _sums_to_the_end(walked.withColumn("value", F.lit(0).cast("long")).unionByName(values), convs, scratch, block)
    saved = path.filter("x IS NOT NULL").groupBy(*NODE).agg(F.sum("total").alias("saved_tokens"))
    ends = _digest_of_ids(shared.filter("NOT more").select("conv_id", *NODE).unionByName(root.filter("NOT more").select("conv_id", *NODE)))

    owner = counted.select("depth", "x", "y", F.col("conv_id").alias("parent_conv_id"))
    of_root = origin.agg(F.min("conv_id"))

    def with_parent(rows: DataFrame) -> DataFrame:
        """Rows with the id of their parent node; the root is no partner of the join, as it may have most nodes under it.

        A parent that is not among the grouped nodes lies in a lone tail: the sketch passed its child for a shared one, and both have the same one member.
        """
        deep = owner.filter("depth > 0").withColumn("depth", F.col("depth") + 1).withColumnsRenamed({"x": "px", "y": "py"})
        found = rows.join(deep, ["depth", "px", "py"], "left")
        return found.withColumn("parent_conv_id", F.when(F.col("depth") == 1, of_root.scalar()).when(F.col("depth") > 1, F.coalesce("parent_conv_id", "conv_id")))

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    totals = with_parent(booked).join(saved, NODE).join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))

    def lone(rows: DataFrame, parent: Column) -> DataFrame:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        ends = F.when(F.col("more"), EMPTY).otherwise(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
        return rows.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.col("more").cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"))

    return totals.select(*names).unionByName(lone(with_parent(first), F.col("parent_conv_id"))).unionByName(lone(tail, F.col("conv_id")))


def shared_head_trie(conversations: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """The trie of the conversations rebuilt by :func:`share_heads`."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = share_heads(number_turns(conversations, scratch), scratch)
    return trie(turns, convs, scratch, block, width)


def oracle(conversations: str = "conversations") -> str:
    """DuckDB SQL for :func:`shared_head_trie`; a node is known by the digests of all its turns."""
    return f"""WITH crc AS (SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t FROM range(0, 256) r(b)),
        turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
            coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations} WHERE conv_id IS NOT NULL),
        convs AS (SELECT c, c - c % {EVERY} AS base, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT),
            lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {HEADS} AS h FROM (SELECT DISTINCT c FROM turns), crc),
        parts AS (SELECT k.c, 0 AS own, t.p, t.role, t.text FROM convs k JOIN turns t ON t.c = k.base AND t.p < k.h
            UNION ALL SELECT k.c, 1, t.p, t.role, t.text FROM convs k JOIN turns t ON t.c = k.c AND t.p >= k.h),
        built AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, sha256(length(role) || ':' || role || text) AS s,
            len(regexp_extract_all(text, '[^ \\t-\\r]+'))::BIGINT AS words FROM parts),
        path AS (SELECT c, d, sha256(string_agg(s, '') OVER (PARTITION BY c ORDER BY d)) AS k, words FROM built
            UNION ALL SELECT c, 0, '', 0 FROM convs),
        steps AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, lead(k) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM path),
        nodes AS (SELECT d, k, min(c) AS c, count(*) AS n, any_value(words) AS words, any_value(up) AS up, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM steps GROUP BY d, k),
        kids AS (SELECT up, d - 1 AS d, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
        full_nodes AS (SELECT n.*, coalesce(kids, 0) AS kids FROM nodes n LEFT JOIN kids k ON k.up = n.k AND k.d = n.d),
        leaves AS (SELECT s.d, s.k, count(*) AS leaves FROM full_nodes n JOIN steps s ON s.c = n.c AND s.d <= n.d WHERE kids = 0 GROUP BY ALL),
        saved AS (SELECT s.d, s.k, sum((n - 1) * n.words) AS saved FROM full_nodes n JOIN steps s ON s.c = n.c AND s.d <= n.d GROUP BY ALL)
        SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n AS n_convs, n.kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM full_nodes n JOIN leaves l ON l.d = n.d AND l.k = n.k JOIN saved s ON s.d = n.d AND s.k = n.k LEFT JOIN nodes u ON u.d = n.d - 1 AND u.k = n.up"""

"""Jump consistent hashing of stable keys onto shards.

The law is ``key``: the key and the number of shards alone decide the shard, there is
no ring table, and going from n to n + 1 shards moves rows only into shard n.

Null keys share one fixed hash; a null text has no bytes. Texts of any length are only
measured and hashed where they are read. Rows with equal keys share a
shard and get different slots. An empty table gives an empty result. Extra columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logframe.llm.common import Scratch

NULL_KEY = 0x6E756C6C
BUCKET_BITS = 8
#: Rows from which on a bucket may be dealt by ranges.
HOT = 1_000_000


def mix64(key: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: neighbouring keys become unrelated 64-bit values."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def jump_hash(hashed: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit hash: all keys jump together until the last has landed."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = hashed.astype(np.uint64).copy()
    landed = np.zeros(len(state), dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while len(moving):
        landed[moving] = jump[moving]
        with np.errstate(over="ignore"):
            state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[moving] = np.floor((landed[moving] + 1) * (float(1 << 31) / step)).astype(np.int64)
        moving = moving[jump[moving] < shards]
    return landed


def shard_of(key: Column, shards: int, bits: int = BUCKET_BITS) -> Column:
    """Struct (shard, grown_shard, bucket): with ``shards``, with one more, and the top hash bits."""

    @F.pandas_udf("struct<shard int, grown_shard int, bucket int>")
    def place(keys: pd.Series) -> pd.DataFrame:
        hashed = mix64(keys.to_numpy(dtype=np.int64).view(np.uint64))
        return pd.DataFrame({
            "shard": jump_hash(hashed, shards).astype(np.int32),
            "grown_shard": jump_hash(hashed, shards + 1).astype(np.int32),
            "bucket": (hashed >> np.uint64(64 - bits)).astype(np.int32),
        })

    return place(F.coalesce(key.cast("long"), F.lit(NULL_KEY)))


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", bits: int = BUCKET_BITS, hot: int = HOT) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    Slots run from 0 without a gap in every shard, ordered by (bucket, key, size, crc).
    A shard is numbered in 2**bits independent buckets: rows are ranked inside (shard,
    bucket), and a table of shards x buckets counts gives each bucket its start. A bucket
    of more than ``hot`` rows and four times the mean holds a key with very many rows (or
    none): it is dealt by ranges of the order, and ranked inside these.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(F.col(key), shards, bits).alias("at"),
    ).select("doc_id", "size", "text_crc32", "at.shard", "at.grown_shard", "at.bucket")

    # at most shards * 2**bits rows, whatever the size of the input
    counts = docs.select(shard_of(F.col(key), shards, bits).alias("at")).groupBy("at.shard", "at.bucket").agg(F.count("*").alias("n")).collect()
    starts, total, large = [], {}, max(hot, 4 * sum(r["n"] for r in counts) / max(1, len(counts)))
    for r in sorted(counts, key=lambda r: (r["shard"], r["bucket"])):
        starts.append((r["shard"], r["bucket"], total.get(r["shard"], 0), r["n"] > large))
        total[r["shard"]] = starts[-1][2] + r["n"]
    begun = F.broadcast(docs.sparkSession.createDataFrame(starts, "shard int, bucket int, start long, large boolean"))

    rows = placed.join(begun, ["shard", "bucket"])
    order = [F.asc_nulls_first("doc_id"), F.col("size"), F.col("text_crc32")]
    rank = lambda *by: F.row_number().over(Window.partitionBy("shard", "bucket", *by).orderBy(*order))
    ranked = rows.filter("NOT large").withColumn("rank", rank())
    if any(x[3] for x in starts):
        scratch = Scratch(docs.sparkSession, "large")
        dealt = rows.filter("large").withColumn("row", F.monotonically_increasing_id()).repartitionByRange("shard", "bucket", *order, "row")
        dealt = scratch.keep(dealt.withColumn("part", F.spark_partition_id()), "rows")
        earlier = Window.partitionBy("shard", "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = dealt.groupBy("shard", "bucket", "part").agg(F.count("*").alias("n"))  # a few rows for each task
        parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
        inside = dealt.join(parts, ["shard", "bucket", "part"]).withColumn("rank", rank("part") + F.col("before"))
        ranked = ranked.unionByName(inside.select(*ranked.columns))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard",
    )


def _mix_sql(x: str) -> list[str]:
    m = "18446744073709551616::UHUGEINT"
    return [
        f"(({x} + 11400714819323198485::UHUGEINT) % {m})",
        f"((xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % {m})",
        f"((xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % {m})",
        "xor(z, z >> 31)",
    ]


def oracle(shards: int, documents: str = "documents") -> str:
    """DuckDB SQL for :func:`shard_rows`."""
    a, b, c, d = _mix_sql(f"(CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616 ELSE k::HUGEINT END)::UHUGEINT")
    step = "((s * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT)"
    jump = f"floor((j + 1) * (2147483648.0::DOUBLE / (({step} >> 33)::DOUBLE + 1.0::DOUBLE)))::BIGINT"

    def landed(name: str, n: int) -> str:
        return f"""{name}(k, s, b, j) AS (
            SELECT k, z, 0::BIGINT, 0::BIGINT FROM hashed
            UNION ALL SELECT k, {step}, j, {jump} FROM {name} WHERE j < {n})"""

    return f"""WITH RECURSIVE keys AS (SELECT DISTINCT coalesce(doc_id, {NULL_KEY})::BIGINT AS k FROM {documents}),
        m1 AS (SELECT k, {a} AS z FROM keys), m2 AS (SELECT k, {b} AS z FROM m1), m3 AS (SELECT k, {c} AS z FROM m2),
        hashed AS (SELECT k, {d} AS z FROM m3),
        {landed("now", shards)}, {landed("grown", shards + 1)},
        crc AS (SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t
            FROM range(0, 256) r(b)),
        placed AS (SELECT h.k, (SELECT max(b) FROM now n WHERE n.k = h.k)::INTEGER AS shard,
            (SELECT max(b) FROM grown g WHERE g.k = h.k)::INTEGER AS grown_shard, (h.z >> {64 - BUCKET_BITS})::INTEGER AS bucket FROM hashed h)
        SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
            xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
            'key' AS law, shard,
            (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1)::BIGINT AS slot, grown_shard
        FROM crc, {documents} JOIN placed ON k = coalesce(doc_id, {NULL_KEY})"""

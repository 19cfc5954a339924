"""A stored merged view: the lines of many sources in time order, in buckets of time, which an append leaves alone or rewrites.

The folder holds ``lines`` by bucket of their merge time, sorted inside, and ``ends`` by batch: each source's last line
and last known time. New lines go into the buckets that their times ask for. A bucket whose lines are all earlier than the
new ones gets a further file (the common case of growing logs); one that they fall into is rewritten; all others are
neither read nor written. Batches count as in a log of commits: rows of a batch without ``ends`` are passed over by
readers, and taken out when a later append rewrites their bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logframe.operators.blocks import last_known
from logframe.operators.small import attach

#: Seconds of a bucket.
BUCKET = 3600
_ORDER = ["merge_ts", "source_ord", "line_no"]


def _batches(spark: SparkSession, out: str, name: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    home = path(f"{out}/{name}")
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(home):
        return []
    return [int(n[6:]) for f in files.listStatus(home) if (n := f.getPath().getName()).startswith("batch=") and files.exists(path(f"{out}/{name}/{n}/_SUCCESS"))]


def _lines(spark: SparkSession, out: str, last: int) -> DataFrame:
    return spark.read.parquet(f"{out}/lines").filter(F.col("batch") <= last)


def read_merged(spark: SparkSession, out: str) -> DataFrame:
    """The merged lines, with their ``bucket``; order by bucket, merge_ts, source_ord, line_no, or take a range of buckets."""
    done = _batches(spark, out, "ends")
    if not done:
        raise ValueError(f"{out} holds no merged lines")
    return _lines(spark, out, max(done)).drop("batch")


def append_merged(new: DataFrame, out: str, ts: str = "arrival_ts", seconds: int = BUCKET) -> dict[str, list[int]]:
    """Merge the lines (source, source_ord, line_no, ts) after each source's last stored one into the folder.

    Returns the buckets that were appended to and those that were rewritten. The first append makes the folder.
    """
    spark = new.sparkSession
    done = _batches(spark, out, "ends")
    batch = max(done) + 1 if done else 0
    if done:
        ends = spark.read.parquet(f"{out}/ends/batch={max(done)}").select("source", F.col("line_no").alias("__line"), F.col("merge_ts").alias("__ts"))
        fresh = attach(new, ends, "left").filter(F.col("__line").isNull() | (F.col("line_no") > F.col("__line")))
    else:
        fresh = new.withColumns({"__line": F.lit(None).cast("long"), "__ts": F.lit(None).cast("timestamp")})
    carried = last_known(fresh, ts, "__last").withColumn("merge_ts", F.coalesce("__last", "__ts", F.timestamp_seconds(F.lit(0)))).drop("__last", "__line", "__ts")
    rows = carried.withColumns({"bucket": F.floor(F.unix_micros("merge_ts") / (seconds * 1_000_000)), "batch": F.lit(batch).cast("long")})
    # the new lines are used three times: written once, beside the folder
    aside = f"{out}/new-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    rows = spark.read.schema(rows.schema).parquet(aside)
    key = F.struct(*_ORDER)
    first = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.min(key).alias("first")).collect()}
    stored = spark.read.parquet(f"{out}/lines").filter(F.col("bucket").isin(*first)) if done and first else None
    # of the buckets that get lines: is any stored one later, or left over from an append that did not end
    held = stored.groupBy("bucket").agg(F.max(key).alias("last"), F.max("batch").alias("batch")).collect() if stored is not None else []
    again = [r["bucket"] for r in held if tuple(r["last"]) > tuple(first[r["bucket"]]) or r["batch"] >= batch]
    onward = [b for b in first if b not in set(again)]

    def write(part: DataFrame, mode: str) -> None:
        dealt = part.repartitionByRange("bucket", *_ORDER).sortWithinPartitions("bucket", *_ORDER)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/lines")

    if again:
        old = stored.filter(F.col("bucket").isin(*again) & (F.col("batch") < batch))
        write(old.unionByName(rows.filter(F.col("bucket").isin(*again))), "overwrite")
    if onward or not done:
        write(rows.filter(F.col("bucket").isin(*onward)) if onward else rows, "append")
    last = rows.groupBy("source").agg(F.max_by(F.struct("line_no", "merge_ts"), "line_no").alias("e")).select("source", "e.*")
    if done:
        kept = spark.read.parquet(f"{out}/ends/batch={max(done)}").select("source", "line_no", "merge_ts")
        last = last.unionByName(kept).groupBy("source").agg(F.max_by(F.struct("line_no", "merge_ts"), "line_no").alias("e")).select("source", "e.*")
    last.write.mode("overwrite").parquet(f"{out}/ends/batch={batch}")
    path = spark._jvm.org.apache.hadoop.fs.Path(aside)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return {"appended": sorted(onward), "rewritten": sorted(again)}

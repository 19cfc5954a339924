"""Stored logs whose line numbers, offsets and counts go on from one append to the next.

A log is a folder of three tables: ``lines`` with their metadata, ``blocks`` with one row for each ``every`` lines of a
source (what lies in it, and the counts up to its end), and ``commits``. An append reads the last block of each source,
not the lines. Statistics, checkpoints and rates are read from the blocks.

An append writes its lines and blocks as one more batch, then its commit. Readers pass over batches without commit, and
the next append writes over them, so a job that stops midway leaves no trace and no line is stored twice. Only one
append may run at a time. A block that an append leaves unfinished goes on as a second row, which readers merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from logframe.functions.metadata import SEVERITIES, with_metadata
from logframe.operators.aggregate import ingest_rate, line_blocks, stats_of_blocks
from logframe.operators.blocks import sums_before
from logframe.operators.small import attach

#: Lines of a block.
EVERY = 100
COUNTS = [f"n_{s}" for s in SEVERITIES]
_COMMIT = "batch long, capture string, epoch long"


def _committed(spark: SparkSession, out: str) -> dict | None:
    """The last commit; None for a folder without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    home = path(f"{out}/commits")
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(home):
        return None
    numbers = [int(name) for f in files.listStatus(home) if (name := f.getPath().getName()).isdigit() and files.exists(path(f"{out}/commits/{name}/_SUCCESS"))]
    return spark.read.schema(_COMMIT).json(f"{out}/commits/{max(numbers)}").first().asDict() if numbers else None


def _table(spark: SparkSession, out: str, name: str) -> DataFrame:
    last = _committed(spark, out)
    if last is None:
        raise ValueError(f"{out} is no stored log")
    found = spark.read.parquet(f"{out}/{name}").schema
    # the type of a folder's name is guessed: a source named 007 must stay that
    kinds = StructType([StructField(f.name, StringType()) if f.name == "source" else f for f in found.fields])
    return spark.read.schema(kinds).parquet(f"{out}/{name}").filter(F.col("batch") <= last["batch"])


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """The committed lines with their metadata."""
    return _table(spark, out, "lines").drop("batch")


def read_blocks(spark: SparkSession, out: str) -> DataFrame:
    """The committed blocks, one row a block; ``c_<severity>`` are the counts of the source up to the block's end."""
    return _merged(_table(spark, out, "blocks"))


def _merged(pieces: DataFrame) -> DataFrame:
    last = lambda c: F.max_by(c, "line_no").alias(c)
    return pieces.groupBy("source", "block").agg(
        *[F.sum(c).alias(c) for c in ("lines", "bytes", *COUNTS)], F.max("line_no").alias("line_no"), F.min("first_line").alias("first_line"),
        F.min_by("first_ts", "first_line").alias("first_ts"), *[last(c) for c in ("arrival_ts", "byte_offset", "fingerprint", "end_offset")],
        *[F.max(f"c{c[1:]}").alias(f"c{c[1:]}") for c in COUNTS],
    )


def _ends(spark: SparkSession, out: str) -> DataFrame | None:
    """Per source: the last stored line, where its text ends, and the counts up to it; None without any."""
    if _committed(spark, out) is None:
        return None
    blocks = _table(spark, out, "blocks")
    ends = blocks.groupBy("source").agg(F.max_by(F.struct("line_no", "end_offset", *[f"c{c[1:]}" for c in COUNTS]), "line_no").alias("end"))
    return ends.select("source", F.col("end.line_no").alias("__last"), F.col("end.end_offset").alias("__end"), *[F.col(f"end.c{c[1:]}").alias(f"__c{c[1:]}") for c in COUNTS])


def _write(lines: DataFrame, out: str, every: int, capture: str | None = None, epoch: int | None = None) -> None:
    """Lines (numbered, after what is stored) and their blocks as the next batch."""
    spark = lines.sparkSession
    last, ends = _committed(spark, out), _ends(spark, out)
    batch = last["batch"] + 1 if last else 0
    rows = with_metadata(lines)
    for name, kind in (("arrival_ts", "timestamp"), ("byte_offset", "long"), ("byte_length", "int")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    kept = f"{out}/lines/batch={batch}"
    rows.sortWithinPartitions("source", "line_no").write.mode("overwrite").partitionBy("source").parquet(kept)
    stored = spark.read.schema(rows.schema).parquet(kept)
    extra = stored.groupBy("source", F.floor(F.col("line_no") / every).alias("block")).agg(
        *[F.max_by(c, "line_no").alias(c) for c in ("byte_offset", "fingerprint")], F.max_by(F.col("byte_offset") + F.col("byte_length"), "line_no").alias("end_offset")
    )
    blocks = sums_before(line_blocks(stored, every), COUNTS).join(extra, ["source", "block"])
    if ends is not None:
        blocks = attach(blocks, ends, "left")
    else:
        blocks = blocks.withColumns({f"__c{c[1:]}": F.lit(0).cast("long") for c in COUNTS} | {"__last": F.lit(None), "__end": F.lit(None)})
    run = {f"c{c[1:]}": F.coalesce(f"__c{c[1:]}", F.lit(0)) + F.col(f"{c}_before") + F.col(c) for c in COUNTS}
    blocks.withColumns(run).drop("__last", "__end", *[f"__c{c[1:]}" for c in COUNTS], *[f"{c}_before" for c in COUNTS]).write.mode("overwrite").parquet(f"{out}/blocks/batch={batch}")
    commit = spark.createDataFrame([(batch, capture, epoch)], _COMMIT).coalesce(1)
    commit.write.mode("overwrite").json(f"{out}/commits/{batch}")


def append_log(lines: DataFrame, out: str, every: int = EVERY) -> None:
    """Store the lines (source, line_no, content, and what :func:`read_lines` gives) after each source's last stored one.

    The folder is made by the first append; lines that are stored already are passed over, so a whole file may be offered again.
    """
    ends = _ends(lines.sparkSession, out)
    if ends is not None:
        lines = attach(lines, ends.select("source", "__last"), "left").filter(F.col("__last").isNull() | (F.col("line_no") > F.col("__last"))).drop("__last")
    _write(lines, out, every)


def capture_log(stream: DataFrame, out: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Store the lines (source, content) of a stream as they arrive, numbered and with byte offsets, each once.

    Numbers and offsets go on from what is stored. A batch that was committed and is run again after a stop is passed
    over; one that was not is written over. Inside a batch the lines of a task keep their order, and tasks follow one another.
    """
    spark = stream.sparkSession

    def store(batch: DataFrame, epoch: int) -> None:
        last = _committed(spark, out)
        if last and last["capture"] != checkpoint and epoch:  # something else was stored since: look for this capture's own last batch
            own = spark.read.schema(_COMMIT).json(f"{out}/commits/*").filter(F.col("capture") == checkpoint).agg(F.max("epoch")).first()[0]
            last = {"capture": checkpoint, "epoch": -1 if own is None else own}
        if last and last["capture"] == checkpoint and last["epoch"] >= epoch:
            return
        size = (F.octet_length("content") + 1).cast("long")
        rows = batch.select("source", "content", F.current_timestamp().alias("arrival_ts"), F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id"), size.alias("__size"))
        rows = rows.persist()  # read twice: ids and lines must be of one reading
        try:
            parts = rows.groupBy("source", F.col("__part").alias("block")).agg(F.count("*").alias("n"), F.sum("__size").alias("bytes"))
            before = sums_before(parts, ["n", "bytes"]).select("source", F.col("block").alias("__part"), "n_before", "bytes_before")
            inside = Window.partitionBy("source", "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
            placed = rows.withColumns({"__rank": F.count(F.lit(1)).over(inside), "__bytes": F.coalesce(F.sum("__size").over(inside), F.lit(0))}).join(before, ["source", "__part"])
            ends = _ends(spark, out)
            if ends is not None:
                placed = attach(placed, ends.select("source", "__last", "__end"), "left")
            else:
                placed = placed.withColumns({"__last": F.lit(None).cast("long"), "__end": F.lit(None).cast("long")})
            number = F.coalesce(F.col("__last") + 1, F.lit(0)) + F.col("n_before") + F.col("__rank")
            offset = F.coalesce(F.col("__end") + 1, F.lit(0)) + F.col("bytes_before") + F.col("__bytes")
            numbered = placed.select("source", number.alias("line_no"), "content", offset.alias("byte_offset"), (F.col("__size") - 1).cast("int").alias("byte_length"), "arrival_ts")
            _write(numbered, out, every, checkpoint, epoch)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).start()


def stored_stats(spark: SparkSession, out: str) -> DataFrame:
    """Statistics of a stored log as ``stats`` gives them, from its blocks alone."""
    columns = ",".join(sorted(read_log(spark, out).columns))
    return stats_of_blocks(read_blocks(spark, out)).withColumn("columns", F.lit(columns))


def stored_checkpoints(spark: SparkSession, out: str) -> DataFrame:
    """Checkpoints of a stored log as ``checkpoints`` gives them, from its blocks alone: the counts are stored, nothing runs on."""
    counts = [F.col(f"c{c[1:]}").alias(c) for c in COUNTS]
    return read_blocks(spark, out).select("source", "block", "line_no", "byte_offset", "fingerprint", "arrival_ts", *counts)


def stored_rate(spark: SparkSession, out: str) -> DataFrame:
    """The ingestion rate of each source, from the blocks alone."""
    return ingest_rate(read_blocks(spark, out))

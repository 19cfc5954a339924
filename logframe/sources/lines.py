"""Log files as tables of lines, source tables, and stored log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logframe.functions.metadata import sanitize, with_metadata
from logframe.operators.blocks import sums_before
from logframe.operators.small import attach

#: Splits (of files) whose starts are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 200_000


def _numbered(raw: DataFrame, source: Column) -> DataFrame:
    """Line numbers and offsets: rows are counted in each split of each file, and the splits' counts run on.

    Ids rise by one inside a split, so a line's place in it is its id less the split's
    first id: the lines themselves are not shuffled for their numbers.
    """
    split = raw.select(
        source.alias("source"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"),
        F.monotonically_increasing_id().alias("__id"), "value",
    )
    size = (F.octet_length("value") + 1).cast("long")
    splits = split.groupBy("__file", "__from").agg(F.min("__id").alias("__first"), F.count("*").alias("n"), F.sum(size).alias("bytes"))
    splits = sums_before(splits.withColumn("block", F.col("__from")), ["n", "bytes"], "__file")
    splits = splits.select(F.col("__file").alias("f"), F.col("__from").alias("b"), "__first", "n_before", "bytes_before")
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    placed = split.join(splits, (F.col("__file") == F.col("f")) & (F.col("__from") == F.col("b")))
    return placed.withColumns({"line_no": F.col("n_before") + F.col("__id") - F.col("__first"), "__size": size})


def _lines(raw: DataFrame, source: Column, offsets: bool) -> DataFrame:
    from pyspark.sql.window import Window

    rows = _numbered(raw, source)
    text = F.regexp_replace("value", "\r$", "")
    if offsets:
        before = Window.partitionBy("__file", "__from").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("byte_offset", F.col("bytes_before") + F.coalesce(F.sum("__size").over(before), F.lit(0)))
        return rows.select("source", "line_no", sanitize(text).alias("content"), "byte_offset", F.octet_length(text).alias("byte_length"))
    return rows.select("source", "line_no", sanitize(text).alias("content"))


def read_lines(spark: SparkSession, paths: str | list[str], offsets: bool = True) -> DataFrame:
    """(source, line_no, content[, byte_offset, byte_length]) of text files; source is the file's path.

    Lines end at a line feed only; one carriage return before it is dropped. Numbers and
    offsets start at 0 in every file.
    """
    raw = spark.read.option("lineSep", "\n").text(paths)
    return _lines(raw, F.col("_metadata.file_path"), offsets)


def read_log_dir(spark: SparkSession, directory: str, offsets: bool = True) -> DataFrame:
    """Lines of the ``*.log`` files of one folder; source is the file's stem."""
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.log").text(directory)
    return _lines(raw, F.regexp_extract("_metadata.file_name", r"^(.*)\.log$", 1), offsets)


def list_sources(spark: SparkSession, project: str | None = None, globally: str | None = None) -> DataFrame:
    """(name, path, size_bytes, location) of the ``*.log`` files: the project's first, then the global ones, by name."""
    tables = []
    for location, directory in (("project", project), ("global", globally)):
        if directory is not None:
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(directory)
            name = F.regexp_extract("path", r"([^/]*)\.log$", 1)
            tables.append(files.select(name.alias("name"), "path", F.col("length").alias("size_bytes"), F.lit(location).alias("location")))
    if not tables:
        raise ValueError("name a folder")
    rows = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    return rows.orderBy(F.when(F.col("location") == "project", 0).otherwise(1), "name")


def resolve_sources(sources: DataFrame) -> DataFrame:
    """One row a name: the project's source goes before the global one."""
    rank = F.when(F.col("location") == "project", 0).otherwise(1)
    best = F.min(F.struct(rank.alias("rank"), *[F.col(c) for c in sources.columns if c != "name"])).alias("best")
    return sources.groupBy("name").agg(best).select("name", *[f"best.{c}" for c in sources.columns if c != "name"])


def valid_source_name(c: Column) -> Column:
    return F.coalesce((c != "") & (F.octet_length(c) <= 255) & ~c.rlike(r"[/\\\x00:*?]") & ~c.startswith("."), F.lit(False))


def missing_metadata(sources: DataFrame, log_table: DataFrame) -> DataFrame:
    """Sources that have no lines in the log table."""
    return sources.join(log_table.select(F.col("source").alias("name")).distinct(), "name", "left_anti")


def build_log_table(lines: DataFrame, out: str) -> None:
    """Lines and their metadata columns as Parquet, by source; sorted, so that ranges of lines and times prune."""
    rows = with_metadata(lines)
    order = [c for c in ("source", "line_no") if c in rows.columns]
    rows.sortWithinPartitions(*order).write.partitionBy("source").parquet(out)


def append_log_table(lines: DataFrame, out: str) -> None:
    """Only the lines after each source's last stored line."""
    spark = lines.sparkSession
    stored = spark.read.parquet(out).groupBy(F.col("source").cast("string").alias("source")).agg(F.max("line_no").alias("__last"))
    fresh = attach(lines, stored, "left").filter(F.col("__last").isNull() | (F.col("line_no") > F.col("__last"))).drop("__last")
    with_metadata(fresh).sortWithinPartitions("source", "line_no").write.mode("append").partitionBy("source").parquet(out)


def write_results(df: DataFrame, out: str) -> None:
    """Rows as JSON lines."""
    df.write.json(out)


def as_json(df: DataFrame) -> DataFrame:
    """One column ``json`` with a record of all columns."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))

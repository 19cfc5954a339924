"""Operators on growing logs as streaming DataFrames; each gives what its batch form gives on the same lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logframe.functions.metadata import SEVERITIES, sanitize, severity, with_metadata
from logframe.operators.aggregate import with_group_keys
from logframe.operators.predicates import where_spec
from logframe.operators.small import attach
from logframe.streaming.generations import newest_lines


def stream_lines(stream: DataFrame, source: str = "stream") -> DataFrame:
    """Any stream with a ``value`` column as lines (source, content)."""
    text = F.regexp_replace(F.col("value").cast("string"), "\r$", "")
    return stream.select(F.lit(source).alias("source"), sanitize(text).alias("content"))


def stream_log_dir(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of the ``*.log`` files of a folder; new files join as they come."""
    raw = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", "*.log").text(directory)
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.log$", 1)
    return raw.select(name.alias("source"), sanitize(F.regexp_replace("value", "\r$", "")).alias("content"))


def capture(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append lines with their arrival time and metadata to a Parquet table; resumes from its checkpoint without loss."""
    rows = with_metadata(stream.withColumn("arrival_ts", F.current_timestamp()))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("source").outputMode("append").start()


def live_filter(stream: DataFrame, spec: dict | Column, now_ms: int = 0) -> DataFrame:
    """New lines that match; stateless, append mode."""
    return where_spec(stream, spec, now_ms)


def live_count_by(stream: DataFrame, fields: list[str], parser: str = "json", top: int | None = None) -> DataFrame:
    """Running groups by count, then keys; complete mode."""
    keys = [F.col(f"`{f}`") for f in fields]
    groups = with_group_keys(stream, fields, parser).groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys)
    return groups if top is None else groups.limit(top)


def live_severity(stream: DataFrame) -> DataFrame:
    """Running severity counts per source; update mode."""
    s = severity(F.col("content"))
    return stream.groupBy("source").agg(*[F.count_if(s == name).alias(f"n_{name}") for name in SEVERITIES])


def live_rate(stream: DataFrame, window: str = "5 seconds", slide: str = "1 second", arrival: str = "arrival_ts", late: str = "10 seconds") -> DataFrame:
    """Lines a second in each sliding window; null where its lines span less than half a second."""
    counted = stream.withWatermark(arrival, late).groupBy(F.window(arrival, window, slide).alias("window"), "source")
    span = (F.unix_micros(F.max(arrival)) - F.unix_micros(F.min(arrival))) / 1e6
    return counted.agg(F.count("*").alias("lines"), F.when(span >= 0.5, F.count("*") / span).alias("lines_per_second"))


def latest_generation(df: DataFrame) -> DataFrame:
    """Lines of each source's newest generation: what was read before a file shrank is dropped.

    Of a stream, the lines of each source's newest generation so far; what was handed on before stays handed on.
    """
    if df.isStreaming:
        return newest_lines(df)
    newest = df.groupBy("source").agg(F.max("generation").alias("__newest"))
    return attach(df, newest).filter(F.col("generation") == F.col("__newest")).drop("__newest")

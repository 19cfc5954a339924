"""Running values of growing files that start anew when a file is cut off.

A source's lines carry a generation, which rises when its file became smaller or was replaced. The processors keep a
state for each source and drop it when a newer generation comes, so counts never mix what was read before and after.
Lines are counted by task before they are dealt by source: of a source with very many lines only its groups travel.

The state store must be the one with keys of its own in a state: call :func:`use_rocksdb` once before such a query
starts, or set ``spark.sql.streaming.stateStore.providerClass`` yourself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from logframe.functions.metadata import SEVERITIES, severity
from logframe.operators.aggregate import with_group_keys
from logframe.operators.small import attach

_PROVIDER, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, _ROCKSDB)


def _checked(df: DataFrame) -> None:
    if df.isStreaming and "RocksDB" not in (df.sparkSession.conf.get(_PROVIDER, "") or ""):
        raise ValueError(f"call use_rocksdb(spark) first: {_PROVIDER} must be {_ROCKSDB}")


class _Generations(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "generation long")

    def rise(self, rows: pd.DataFrame) -> tuple[int, bool]:
        """The newest generation, and whether these rows brought it."""
        known, seen = self.newest.get()[0] if self.newest.exists() else None, int(rows["generation"].max())
        if known is not None and known >= seen:
            return known, False
        self.newest.update((seen,))
        return seen, known is not None

    def close(self) -> None:
        pass


class NewestLines(_Generations):
    """Hands on the lines of the newest generation."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            newest, _ = self.rise(part)
            yield part[part["generation"] == newest]


class Counts(_Generations):
    """Adds up partial counts of groups; a new generation begins with none."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getMapState("counts", ", ".join(f"k{i} string" for i in range(len(self.keys))), "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[tuple, int] = {}
        newest = None
        for part in rows:
            newest, risen = self.rise(part)
            if risen:
                self.counts.clear()
                changed = {}
            for *group, n in part.loc[part["generation"] == newest, [*self.keys, "count"]].itertuples(index=False):
                group = tuple(group)
                if group not in changed:
                    changed[group] = self.counts.getValue(group)[0] if self.counts.containsKey(group) else 0
                changed[group] += int(n)
        for group, n in changed.items():
            self.counts.updateValue(group, (n,))
        out = pd.DataFrame([[key[0], newest, *g, n] for g, n in changed.items()], columns=["source", "generation", *self.keys, "count"])
        yield out


def _partial(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(source, generation, keys, count) of each task's batches: a stream may not group twice."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby(["source", "generation", *keys], dropna=False).size().reset_index(name="count")

    rows = keyed.select("source", F.col("generation").cast("long").alias("generation"), *[F.col(f"`{k}`").cast("string").alias(k) for k in keys])
    return rows.mapInPandas(count, StructType([*rows.schema.fields, StructField("count", LongType())]))


def running_counts(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts of each source's newest generation by its columns ``keys`` (not null): (source, generation, keys, count); update mode.

    A group is given whenever it changes. What older generations gave is void from the first row of a newer one on:
    :func:`newest_counts` reads a table of such rows.
    """
    _checked(keyed)
    partial = _partial(keyed, keys)
    return partial.groupBy("source").transformWithStateInPandas(Counts(keys), partial.schema, "Update", "None")


def generation_count_by(stream: DataFrame, fields: list[str], parser: str = "json") -> DataFrame:
    """Count-by of lines with ``generation``, by source, starting anew with each generation; update mode."""
    return running_counts(with_group_keys(stream, fields, parser), fields)


def generation_severity(stream: DataFrame) -> DataFrame:
    """Severity counts by source, starting anew with each generation: (source, generation, severity, count); update mode."""
    return running_counts(stream.withColumn("severity", severity(F.col("content"))), ["severity"])


def newest_counts(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The present counts by ``keys``, over all sources, from all rows that :func:`running_counts` has given."""
    newest = updates.groupBy("source").agg(F.max("generation").alias("__newest"))
    present = attach(updates, newest).filter(F.col("generation") == F.col("__newest"))
    columns = [F.col(f"`{k}`") for k in keys]
    return present.groupBy("source", *columns).agg(F.max("count").alias("count")).groupBy(*columns).agg(F.sum("count").alias("count"))


def severity_table(updates: DataFrame) -> DataFrame:
    """The present severity counts, as ``severity_counts`` gives them, from all rows of :func:`generation_severity`."""
    newest = updates.groupBy("source").agg(F.max("generation").alias("__newest"))
    present = attach(updates, newest).filter(F.col("generation") == F.col("__newest")).groupBy("source", "severity").agg(F.max("count").alias("count"))
    return present.groupBy("source").agg(*[F.coalesce(F.max(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).alias(f"n_{s}") for s in SEVERITIES])


def newest_lines(stream: DataFrame) -> DataFrame:
    """Lines of each source's newest generation so far; append mode."""
    _checked(stream)
    rows = stream.withColumn("generation", F.col("generation").cast("long"))
    return rows.groupBy("source").transformWithStateInPandas(NewestLines(), rows.schema, "Append", "None").select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in stream.schema.fields])

"""Many sources as one view in time order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logframe.operators.blocks import last_known
from logframe.operators.small import attach


def carry_forward_ts(df: DataFrame, ts: str = "arrival_ts") -> DataFrame:
    """``df`` with ``merge_ts``: the line's time, or the last one known in its source; the epoch before the first."""
    return last_known(df, ts, "__last").withColumn("merge_ts", F.coalesce("__last", F.timestamp_seconds(F.lit(0)))).drop("__last")


def tag_sources(dfs: list[DataFrame]) -> DataFrame:
    """The tables one under the other, with ``source_ord``: the table's place in the list."""
    return reduce(DataFrame.unionByName, [d.withColumn("source_ord", F.lit(i)) for i, d in enumerate(dfs)])


def merge_sources(dfs: list[DataFrame] | DataFrame, ts: str = "arrival_ts") -> DataFrame:
    """All lines ordered by (merge_ts, source_ord, line_no). One table is merged by its own ``source_ord``."""
    rows = dfs if isinstance(dfs, DataFrame) else tag_sources(dfs)
    return carry_forward_ts(rows, ts).orderBy("merge_ts", "source_ord", "line_no")


def append_merge(merged: DataFrame, new: DataFrame, ts: str = "arrival_ts", known: DataFrame | None = None) -> DataFrame:
    """``merged`` with the lines of ``new`` that come after its last line of their source, carrying on its last known time.

    ``known`` (source, line_no, merge_ts) tells each source's last line, so that ``merged`` is not read for it. A stored
    merged view that leaves old lines where they are is ``logframe.sources.merged``.
    """
    if known is None:
        known = merged.groupBy("source").agg(F.max_by(F.struct("line_no", "merge_ts"), "line_no").alias("e")).select("source", "e.*")
    known = known.select("source", F.col("line_no").alias("__line"), F.col("merge_ts").alias("__ts"))
    fresh = attach(new, known, "left").filter(F.col("__line").isNull() | (F.col("line_no") > F.col("__line")))
    start = F.coalesce("__ts", F.timestamp_seconds(F.lit(0)))
    carried = last_known(fresh, ts, "__last").withColumn("merge_ts", F.coalesce("__last", start)).drop("__last", "__line", "__ts")
    return merged.unionByName(carried).orderBy("merge_ts", "source_ord", "line_no")


def merge_by_category(df: DataFrame, ts: str = "arrival_ts") -> DataFrame:
    """Lines of the categories with two sources or more, each category in merged order."""
    several = df.groupBy("category").agg(F.min("source").alias("a"), F.max("source").alias("b")).filter("a <> b").select("category")
    return carry_forward_ts(df.join(several, "category", "left_semi"), ts).orderBy("category", "merge_ts", "source_ord", "line_no")

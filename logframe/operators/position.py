"""Reads by line number: ranges, tails, context, pages, nearest matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logframe.functions.metadata import arrival_text, severity_label
from logframe.operators.blocks import sums_before
from logframe.operators.small import attach

# fixed values: limits of the reads
MAX_LINES, MAX_CONTEXT, MAX_PAGE = 1000, 50, 5000
# end of fixed values
#: Lines in a block of matches that is numbered at once.
PAGE_BLOCK = 100_000


def _total(df: DataFrame) -> DataFrame:
    """One row a source: how many lines it has."""
    return df.groupBy("source").agg((F.max("line_no") + 1).alias("__total"))


def _checked(name: str, value: int, most: int) -> int:
    if not 0 <= value <= most:
        raise ValueError(f"{name} must be from 0 to {most}")
    return value


def get_lines(df: DataFrame, start: int = 0, count: int = 100) -> DataFrame:
    """Lines [start, start + count) of each source, with has_more."""
    _checked("count", count, MAX_LINES)
    rows = df.filter((F.col("line_no") >= start) & (F.col("line_no") < start + count))
    return attach(rows, _total(df)).withColumn("has_more", F.col("__total") > start + count).drop("__total")


def get_tail(df: DataFrame, count: int = 100, since_line: int | None = None) -> DataFrame:
    """The last lines of each source, or those after ``since_line``; with has_more (earlier lines, or later ones)."""
    _checked("count", count, MAX_LINES)
    if since_line is not None:
        rows = df.filter((F.col("line_no") > since_line) & (F.col("line_no") <= since_line + count))
        return attach(rows, _total(df)).withColumn("has_more", F.col("__total") > since_line + 1 + count).drop("__total")
    placed = attach(df, _total(df)).filter(F.col("line_no") >= F.col("__total") - count)
    return placed.withColumn("has_more", F.col("__total") > count).drop("__total")


def get_context(df: DataFrame, line: int, before: int = 5, after: int = 5) -> DataFrame:
    """Lines around ``line`` of each source that has it, with role before, target or after; an error if none has."""
    _checked("before", before, MAX_CONTEXT)
    _checked("after", after, MAX_CONTEXT)
    has = df.filter(F.col("line_no") == line).select("source")
    if has.isEmpty():
        raise ValueError(f"no line {line}")
    rows = attach(df.filter(F.col("line_no").between(line - before, line + after)), has.distinct(), "left_semi")
    return rows.withColumn("role", F.when(F.col("line_no") < line, "before").when(F.col("line_no") > line, "after").otherwise("target"))


def with_context(matches: DataFrame, lines: DataFrame, context: int, content: str = "content") -> DataFrame:
    """Each match (source, line_no, content) with arrays before and after of up to ``context`` lines, in order."""
    _checked("context", context, MAX_CONTEXT)
    near = F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("near")
    wanted = matches.select("source", F.col("line_no").alias("match"), near)
    around = lines.select("source", F.col("line_no").alias("near"), F.col(content).alias("text"))
    found = wanted.join(around, ["source", "near"])
    side = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("near", "text")))), lambda x: x["text"])
    lists = found.groupBy("source", "match").agg(
        F.first(F.when(F.col("near") == F.col("match"), F.col("text")), ignorenulls=True).alias("content"),
        side(F.col("near") < F.col("match")).alias("before"),
        side(F.col("near") > F.col("match")).alias("after"),
    )
    return lists.select("source", F.col("match").alias("line_no"), "content", "before", "after")


def first_matches(df: DataFrame, n: int = 100) -> DataFrame:
    """The first matches by source and line."""
    _checked("n", n, MAX_LINES)
    return df.orderBy("source", "line_no").limit(n)


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Matches [offset, offset + limit) of each source in line order, with their 1-based ``display_no``.

    Matches are counted by block first; only those of the blocks that the page touches are numbered.
    """
    _checked("limit", limit, MAX_PAGE)
    block = F.floor(F.col("line_no") / PAGE_BLOCK)
    counts = sums_before(df.groupBy("source", block.alias("block")).agg(F.count("*").alias("n")), ["n"])
    touched = counts.filter((F.col("n_before") < offset + limit) & (F.col("n_before") + F.col("n") > offset))
    touched = touched.select(F.col("source").alias("__source"), F.col("block").alias("__block"), "n_before")
    near = df.join(touched, (F.col("source") == F.col("__source")) & (block == F.col("__block")))
    rank = F.row_number().over(Window.partitionBy("source", "__block").orderBy("line_no"))
    ranked = near.withColumn("display_no", F.col("n_before") + rank).drop("__source", "__block", "n_before")
    return ranked.filter((F.col("display_no") > offset) & (F.col("display_no") <= offset + limit))


def nearest_match(df: DataFrame, target: int) -> DataFrame:
    """Per source: the matching line closest to ``target``; the lower one of two."""
    return df.groupBy("source").agg(F.min(F.struct(F.abs(F.col("line_no") - target).alias("d"), "line_no"))["line_no"].alias("line_no"))


def decorate(df: DataFrame) -> DataFrame:
    """``df`` with severity_label (null for unknown) and arrival (text) from its flags and arrival_ts."""
    return df.withColumns({"severity_label": severity_label(F.col("flags")), "arrival": arrival_text(F.unix_millis("arrival_ts"))})

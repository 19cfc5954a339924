"""Counts and statistics over lines and log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.functions.fields import json_field, json_variant, let, logfmt_map
from logframe.functions.metadata import SEVERITIES
from logframe.operators.blocks import sums_before

#: Lines in a block, and blocks that are merged at once.
BLOCK, FAN = 10_000, 1_000
MISSING, PARSE_ERROR, RAW = "<missing>", "<parse error>", "<raw>"


def with_group_keys(df: DataFrame, fields: list[str], parser: str, content: str = "content") -> DataFrame:
    """``df`` with one text column a field: its value, or a sentinel. A column that a field is named after is replaced."""
    c = F.col(content)

    def key(p: Column, f: str) -> Column:
        if parser == "logfmt":
            return F.coalesce(F.try_element_at(p, F.lit(f)), F.lit(MISSING))
        return F.when(p.isNull(), PARSE_ERROR).otherwise(F.coalesce(json_field(c, f, p), F.lit(MISSING)))

    if parser == "raw":
        return df.withColumns({f: F.lit(RAW) for f in fields})
    parsed = {"json": json_variant, "logfmt": logfmt_map}[parser](c)
    keys = let(parsed, lambda p: F.struct(*[key(p, f).alias(f"k{i}") for i, f in enumerate(fields)]))
    return df.withColumn("__keys", keys).withColumns({f: F.col(f"__keys.k{i}") for i, f in enumerate(fields)}).drop("__keys")


def _named(f: str) -> Column:
    return F.col(f"`{f}`")


def _first_lines(keyed: DataFrame, keys: list[Column], members: int) -> DataFrame:
    """Groups with ``count``, ``line_indices`` and ``members``, from one pass over the lines.

    Each (group, source, block of lines) is counted with its first lines; then the first of ``FAN`` blocks, of a source, of
    a ``FAN``-th of the sources and of all are merged: no array grows with the lines of a group or its sources together.
    """
    source = F.col("source") if "source" in keyed.columns else F.lit(None).cast("string")
    line = F.struct(F.col("line_no").cast("long").alias("line_no"), source.alias("source"))
    first = lambda lists: F.slice(F.array_sort(lists), 1, members).alias("__first")
    rows = keyed.select(*keys, source.alias("__source"), F.floor(F.col("line_no") / BLOCK).alias("__block"), line.alias("__line"))
    rows = rows.groupBy(*keys, "__source", "__block").agg(F.count("*").alias("count"), first(F.collect_list("__line")))
    for level in (["__source", F.floor(F.col("__block") / FAN).alias("__block")], ["__source"], [F.pmod(F.xxhash64("__source"), F.lit(FAN)).alias("__part")], []):
        rows = rows.groupBy(*keys, *level).agg(F.sum("count").alias("count"), first(F.flatten(F.collect_list("__first"))))
    places = F.transform("__first", lambda x: F.struct(x["source"].alias("source"), x["line_no"].alias("line_no")))
    return rows.select(*keys, "count", F.transform("__first", lambda x: x["line_no"]).alias("line_indices"), places.alias("members"))


def count_by(df: DataFrame, fields: list[str], parser: str = "json", top: int | None = None, members: int | None = None, content: str = "content", named: bool = False) -> DataFrame:
    """Groups with ``count`` and ``total_matches``, ordered by count (largest first), then keys.

    ``members`` adds ``line_indices``, the group's line numbers, ascending, at most so many; with ``named`` also
    ``members``, the same lines as (source, line_no), in the order of (line_no, source).
    """
    keys = [_named(f) for f in fields]
    keyed = with_group_keys(df, fields, parser, content)
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("count")) if members is None else _first_lines(keyed, keys, members)
    # names all columns of the groups, so that both readers share one shuffle of the lines
    counted = F.col("count") if members is None else F.when(F.size("line_indices") >= 0, F.col("count"))
    total = groups.agg(F.coalesce(F.sum(counted), F.lit(0)).alias("total_matches"))
    groups = groups if named or members is None else groups.drop("members")
    ordered = groups.withColumn("total_matches", total.scalar()).orderBy(F.desc("count"), *keys)
    return ordered if top is None else ordered.limit(top)


def totals(df: DataFrame, matches: Column | None = None) -> DataFrame:
    """One row: lines_searched, total_matches."""
    hit = F.lit(True) if matches is None else matches
    return df.agg(F.count("*").alias("lines_searched"), F.count_if(hit).alias("total_matches"))


def drill_down(df: DataFrame, group: dict[str, str], parser: str = "json", content: str = "content") -> DataFrame:
    """Lines of one group, sentinels included."""
    keyed = with_group_keys(df, [*group], parser, content)
    for f, value in group.items():
        keyed = keyed.filter(_named(f) == value)
    return keyed.select(*df.columns)


def severity_counts(df: DataFrame) -> DataFrame:
    """Per source: a column n_<severity> for each of the seven severities."""
    return df.groupBy("source").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])


def checkpoints(df: DataFrame, every: int = 100) -> DataFrame:
    """Per source, at every ``every``-th line and at the last: line_no, running severity counts up to it, and its byte
    offset, fingerprint and arrival time where ``df`` has them. Counts are summed inside blocks, then over the blocks."""
    extra = [F.max_by(F.col(c), "line_no").alias(c) for c in ("byte_offset", "fingerprint", "arrival_ts") if c in df.columns]
    names = [f"n_{s}" for s in SEVERITIES]
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    blocks = df.groupBy("source", F.floor(F.col("line_no") / every).alias("block")).agg(F.max("line_no").alias("line_no"), *extra, *counts)
    summed = sums_before(blocks, names)
    return summed.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in names}).drop(*[f"{n}_before" for n in names])


#: Line numbers that one group of checkpoints spans.
SPAN = 1_000_000


def _newest(points: Column) -> Column:
    """The last two of an array of points (line_no, arrival_ts), the last first."""
    return F.slice(F.sort_array(points, asc=False), 1, 2)


def _rate(two: Column) -> Column:
    """Lines a second between two points; null with fewer, or without time between them."""
    last, prev = F.get(two, F.lit(0)), F.get(two, F.lit(1))
    dt = (F.unix_micros(last["arrival_ts"]) - F.unix_micros(prev["arrival_ts"])) / 1e6
    return F.when(dt > 0, (last["line_no"] - prev["line_no"]) / dt)


def ingest_rate(points: DataFrame) -> DataFrame:
    """Per source: lines a second between the last two checkpoints; null with fewer, or without time between them."""
    point = F.collect_list(F.struct("line_no", "arrival_ts"))
    groups = points.groupBy("source", F.floor(F.col("line_no") / SPAN).alias("__group")).agg(_newest(point).alias("two"))
    ends = groups.groupBy("source").agg(_newest(F.flatten(F.collect_list("two"))).alias("two"))
    return ends.select("source", _rate(F.col("two")).alias("lines_per_second"))


def time_range(df: DataFrame) -> DataFrame:
    """Per source: arrival time of the first and of the last line; null if either has none."""
    ends = df.groupBy("source").agg(F.min_by("arrival_ts", "line_no").alias("start_ts"), F.max_by("arrival_ts", "line_no").alias("end_ts"))
    both = F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull()
    return ends.select("source", F.when(both, F.col("start_ts")).alias("start_ts"), F.when(both, F.col("end_ts")).alias("end_ts"))


def stats(df: DataFrame, every: int = 100) -> DataFrame:
    """Per source: lines, bytes, severity counts, time range, rate and the columns stored.

    The lines are read once, into a table of blocks from which all figures come.
    """
    return stats_of_blocks(line_blocks(df, every)).withColumn("columns", F.lit(",".join(sorted(df.columns))))


def line_blocks(df: DataFrame, every: int = 100) -> DataFrame:
    """One row for each ``every`` line numbers of a source: lines, bytes, line_no and arrival_ts of the last line, first_line, first_ts, severity counts."""
    return df.groupBy("source", F.floor(F.col("line_no") / every).alias("block")).agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("content") + 1).alias("bytes"), F.max("line_no").alias("line_no"), F.min("line_no").alias("first_line"),
        F.min_by("arrival_ts", "line_no").alias("first_ts"), F.max_by("arrival_ts", "line_no").alias("arrival_ts"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES],
    )


def stats_of_blocks(blocks: DataFrame) -> DataFrame:
    """Per source, from the rows of :func:`line_blocks`: lines, bytes, severity counts, time range and rate."""
    names = [f"n_{s}" for s in SEVERITIES]
    point = F.collect_list(F.struct("line_no", "arrival_ts"))
    sums = [F.sum(c).alias(c) for c in ("lines", "bytes", *names)]
    groups = blocks.groupBy("source", F.floor(F.col("line_no") / SPAN).alias("__group")).agg(
        *sums, F.min_by("first_ts", "block").alias("first_ts"), F.max_by("arrival_ts", "block").alias("last_ts"), _newest(point).alias("two")
    )
    ends = [F.min_by("first_ts", "__group").alias("start_ts"), F.max_by("last_ts", "__group").alias("end_ts"), _newest(F.flatten(F.collect_list("two"))).alias("two")]
    base = groups.groupBy("source").agg(*sums, *ends)
    both = F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull()
    return base.withColumns({**{c: F.when(both, F.col(c)) for c in ("start_ts", "end_ts")}, "lines_per_second": _rate(F.col("two"))}).drop("two")


def severity_bars(counts: DataFrame, width: int = 10) -> DataFrame:
    """Rows (source, severity, n, bar), fatal to trace, without zero counts; ``counts`` as :func:`severity_counts` gives it."""
    shown = [s for s in reversed(SEVERITIES) if s != "unknown"]
    largest = F.greatest(*[F.col(f"n_{s}") for s in shown])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("severity"), F.col(f"n_{s}").alias("n")) for i, s in enumerate(shown)]))
    bars = counts.select("source", largest.alias("largest"), rows.alias("r")).select("source", "r.rank", "r.severity", "r.n", "largest").filter("n > 0")
    return bars.select("source", "severity", "n", F.greatest(F.lit(1), F.floor(F.col("n") * width / F.col("largest"))).cast("int").alias("bar"), "rank").orderBy("source", "rank").drop("rank")


def search_summary(df: DataFrame, max_results: int = 100) -> DataFrame:
    return df.agg(F.count("*").alias("total_matches")).withColumn("truncated", F.col("total_matches") > max_results)

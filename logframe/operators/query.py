"""A whole query in one call: filter, then count, or lines with context, cut and cleaned for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.functions.formatting import layout_first
from logframe.functions.metadata import arrival_text, severity_label, strip_ansi, truncate_line
from logframe.operators.aggregate import BLOCK, count_by
from logframe.operators.position import MAX_CONTEXT, MAX_LINES
from logframe.operators.predicates import check_spec, search

# fixed values: results of a search where nothing else is asked for
RESULTS = 100


def shown(c: Column, raw: bool = False, full: bool = False) -> Column:
    """A line as it is read: without escape sequences and cut to 500 bytes; ``raw`` keeps the sequences, ``full`` the length."""
    c = c if raw else strip_ansi(c)
    return c if full else truncate_line(c)


def readable(
    lines: DataFrame, raw: bool = False, full: bool = False, include_ts: bool = False, content: str = "content", layouts: list[tuple[str | None, list[dict]]] | None = None
) -> DataFrame:
    """``lines`` with ``content`` (and before, after, where they are) as :func:`shown`.

    ``include_ts`` adds ``arrival``, the arrival time as text, and severity where flags are stored: null without them.
    ``layouts``, pairs of a parser and a layout, add ``rendered``: the line in the first layout that shows a field of it,
    cut and cleaned like the line; null where none does.
    """
    added = {}
    if layouts:
        added["rendered"] = shown(layout_first(F.col(content), layouts), raw, full)
    for side in ("before", "after"):
        if side in lines.columns:
            added[side] = F.transform(side, lambda x: shown(x, raw, full))
    if include_ts:
        added["arrival"] = arrival_text(F.unix_millis("arrival_ts")) if "arrival_ts" in lines.columns else F.lit(None).cast("string")
        added["severity_label"] = severity_label(F.col("flags")) if "flags" in lines.columns else F.lit(None).cast("string")
    return lines.withColumns({**added, content: shown(F.col(content), raw, full)})


def run_query(
    df: DataFrame, query: dict | Column | None = None, pattern: str | None = None, mode: str = "plain", case: bool = False, max_results: int = RESULTS,
    context: int = 0, now_ms: int = 0, raw: bool = False, full: bool = False, include_ts: bool = False, content: str = "content",
    layouts: list[tuple[str | None, list[dict]]] | None = None,
) -> DataFrame:
    """What a query asks for.

    With an ``aggregate`` part (``{"type": "count_by", "fields": [...], "limit": n}``) the groups of the matches, as
    :func:`count_by` gives them. Else the first ``max_results`` (1,000 at most) matches by source and line with
    ``total_matches``, ``truncated`` and ``lines_searched``, readable (``layouts`` as there), with arrays before and
    after of up to ``context`` (50 at most) lines if it is not 0.

    The condition is tried once on each line, which gives the number of matches and the places of the first. Their
    lines and those around them, at most 1,000 times 101 places, are then fetched by a broadcast of the places.
    """
    max_results, context = min(max_results, MAX_LINES), min(context, MAX_CONTEXT)
    aggregate = check_spec(query).get("aggregate") if isinstance(query, dict) else None
    matches = search(df, pattern, mode, case, query, now_ms, content)
    if aggregate:
        return count_by(matches, list(aggregate["fields"]), query.get("parser", "raw"), aggregate.get("limit"), content=content)
    first = F.slice(F.array_sort(F.collect_list("line_no")), 1, max(1, max_results)).alias("first")
    blocks = matches.groupBy("source", F.floor(F.col("line_no") / BLOCK).alias("block")).agg(F.count("*").alias("n"), first)
    # names the places, too, so that both readers share the pass over the lines
    total = blocks.agg(F.coalesce(F.sum(F.when(F.size("first") >= 0, F.col("n"))), F.lit(0)).alias("n")).scalar()
    places = blocks.select("source", F.explode("first").alias("line_no"), "n").filter("n > 0").orderBy("source", "line_no").limit(max_results)
    near = F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("__near")
    wanted = places.select(F.col("source").alias("__source"), F.col("line_no").alias("__match"), near)
    found = df.join(F.broadcast(wanted), (F.col("source") == F.col("__source")) & (F.col("line_no") == F.col("__near")))
    if context:
        own = F.when(F.col("__near") == F.col("__match"), F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        side = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("__near", F.col(content).alias("text"))))), lambda x: x["text"])
        sides = [side(F.col("__near") < F.col("__match")).alias("before"), side(F.col("__near") > F.col("__match")).alias("after")]
        grouped = found.groupBy("__source", "__match").agg(F.first(own, ignorenulls=True).alias("__own"), *sides)
        found = grouped.select("__own.*", "before", "after")
    else:
        found = found.select(*df.columns)
    out = readable(found, raw, full, include_ts, content, layouts)
    searched = df.agg(F.count("*").alias("n")).scalar()
    out = out.withColumns({"total_matches": total, "lines_searched": searched}).withColumn("truncated", F.col("total_matches") > max_results)
    return out.orderBy("source", "line_no")

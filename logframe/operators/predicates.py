"""Filters over lines: plain text, regular expressions and structured specs.

A spec is a dict: ``{"parser": "raw|json|logfmt", "filters": [{"field", "op", "value"}],
"exclude": [{"field", "pattern"}]}``. Filters are joined by AND; filters on ``@ts`` bound
the arrival time. Any boolean Column is accepted where a spec is. Its ``aggregate`` part is
for ``operators.query.run_query``; the functions here filter only. Unknown keys are refused.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.functions.fields import NUMBER, java_regex, json_field, json_variant, let, logfmt_map, parse_ts, resolve_time
from logframe.functions.metadata import FLAG_EMPTY, FLAG_JSON, FLAG_LOGFMT, LEVELS, SEVERITIES, SEVERITY_MASK

#: What a spec and its parts may say; anything else is a misspelling and is refused.
SPEC_KEYS = {"": {"parser", "filters", "ts_filters", "exclude", "aggregate"}, "ts_filters": {"field", "op", "value"}, "filters": {"field", "op", "value"}, "exclude": {"field", "pattern"}, "aggregate": {"type", "fields", "limit"}}
OPS = ("eq", "ne", "contains", "regex", "not_regex", "gt", "lt", "gte", "lte")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def match_plain(c: Column, pattern: str, case: bool = False, ascii_only: bool = False) -> Column:
    """Substring. Any case by default; ``ascii_only`` folds A-Z alone, and an empty pattern then matches nothing."""
    if ascii_only:
        if not pattern:
            return F.lit(False)
        return c.contains(pattern) if case else F.translate(c, _UPPER, _LOWER).contains(pattern.translate(str.maketrans(_UPPER, _LOWER)))
    return c.contains(pattern) if case else F.lower(c).contains(F.lower(F.lit(pattern)))


def match_regex(c: Column, pattern: str, case: bool = False) -> Column:
    """Find a pattern in Java's dialect. Repeat alternatives possessively (``(?:a|bc)*+``): what may be given back is walked by
    recursion, so ``(?:a|bc)*`` over a line of some thousand characters overflows the stack of Java's matcher.
    """
    return c.rlike(("" if case else "(?i)") + java_regex(pattern))


def compare(c: Column, op: str, value: str, now_ms: int = 0) -> Column:
    """gt, lt, gte, lte: times if ``value`` is a time, else numbers if both sides are, else text; never true for NaN."""
    holds = {"gt": Column.__gt__, "lt": Column.__lt__, "gte": Column.__ge__, "lte": Column.__le__}[op]
    at = resolve_time(value, now_ms)
    if at is not None:
        return holds(parse_ts(c), F.lit(at))
    text = holds(c, F.lit(value))
    try:
        n = float(value) if value == value.strip() and "_" not in value else None
    except ValueError:
        n = None
    if n is None:
        return text
    x = c.try_cast("double")
    return F.when(c.rlike(NUMBER), holds(x, F.lit(n)) & ~F.isnan(x) & F.lit(n == n)).otherwise(text)


def predicate(c: Column, op: str, value: str, now_ms: int = 0) -> Column:
    """One field's condition; a missing field never matches."""
    value = str(value)
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}")
    if op in ("gt", "lt", "gte", "lte"):
        holds = compare(c, op, value, now_ms)
    else:
        holds = {
            "eq": lambda: c == value, "ne": lambda: c != value, "contains": lambda: c.contains(value),
            "regex": lambda: c.rlike(java_regex(value)), "not_regex": lambda: ~c.rlike(java_regex(value)),
        }[op]()
    return F.coalesce(holds, F.lit(False))


def check_spec(spec: dict) -> dict:
    """``spec`` itself; ValueError where it has an unknown key or lacks a needed one."""

    def check(part: dict, where: str, needed: set[str]) -> None:
        if not isinstance(part, dict):
            raise ValueError(f"{where or 'the spec'} must be a dict, not {part!r}")
        if bad := (set(part) - SPEC_KEYS[where]) or (needed - set(part)):
            raise ValueError(f"{where or 'the spec'} has unknown or lacks needed keys: {', '.join(sorted(map(str, bad)))}")

    check(spec, "", set())
    for where, needed in (("filters", {"field", "op", "value"}), ("ts_filters", {"op", "value"}), ("exclude", {"field", "pattern"})):
        for part in spec.get(where) or []:
            check(part, where, needed)
    if spec.get("aggregate") is not None:
        check(spec["aggregate"], "aggregate", {"type", "fields"})
        if spec["aggregate"]["type"] != "count_by" or not spec["aggregate"]["fields"]:
            raise ValueError("aggregate takes the type count_by and at least one field")
    return spec


def _bound(value, f: dict, now_ms: int) -> Column:
    return let(value(f["field"]), lambda x: predicate(x, f["op"], f["value"], now_ms))


def split_ts(spec: dict) -> tuple[dict, list[dict]]:
    """The spec without its ``@ts`` filters, and those, given among the filters or apart."""
    filters = spec.get("filters") or []
    bounds = [f for f in filters if f["field"] == "@ts"] + list(spec.get("ts_filters") or [])
    return {**spec, "filters": [f for f in filters if f["field"] != "@ts"], "ts_filters": []}, bounds


def ts_bounds(arrival: Column, bounds: list[dict], now_ms: int = 0) -> Column:
    """AND of arrival time bounds; lines without arrival time fail."""
    holds = F.lit(True)
    for b in bounds:
        at = resolve_time(str(b["value"]), now_ms)
        if b["op"] not in ("gt", "lt", "gte", "lte"):
            raise ValueError(f"@ts takes gt, lt, gte, lte, not {b['op']!r}")
        if at is None:
            raise ValueError(f"{b['value']!r} is no time")
        when = F.lit(datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(milliseconds=at))
        holds = holds & {"gt": arrival > when, "lt": arrival < when, "gte": arrival >= when, "lte": arrival <= when}[b["op"]]
    return F.coalesce(holds, F.lit(False))


def spec_column(c: Column, spec: dict | Column, now_ms: int = 0, parsed: Column | None = None) -> Column:
    """The spec's condition on a line, without ``@ts``. ``parsed`` is the line's variant or map if it is at hand."""
    if isinstance(spec, Column):
        return spec
    spec, _ = split_ts(spec)
    filters, exclude, parser = spec.get("filters") or [], spec.get("exclude") or [], spec.get("parser", "raw")
    if parser == "raw":
        return F.lit(not filters and not exclude)
    if parser not in ("json", "logfmt"):
        raise ValueError(f"unknown parser {parser!r}")
    if parsed is None:  # a line is parsed once for all conditions
        return let(json_variant(c) if parser == "json" else logfmt_map(c), lambda p: spec_column(c, spec, now_ms, p))
    source = parsed
    value = (lambda f: json_field(c, f, source)) if parser == "json" else (lambda f: F.try_element_at(source, F.lit(f)))
    keep = [source.isNotNull()] if parser == "json" else [c.isNotNull()]
    keep += [~F.coalesce(value(e["field"]).contains(e["pattern"]), F.lit(False)) for e in exclude]
    keep += [_bound(value, f, now_ms) for f in filters]
    return reduce(lambda a, b: a & b, keep)


def candidate_mask(spec: dict) -> tuple[int, int]:
    """(mask, want) over packed flags for lines that may match; unsound where text and field disagree, so opt-in."""
    bit = {"json": FLAG_JSON, "logfmt": FLAG_LOGFMT}.get(spec.get("parser", "raw"), 0)
    mask, want = bit | FLAG_EMPTY if bit else 0, bit
    for f in spec.get("filters") or []:
        if bit and f["field"] == "level" and f["op"] == "eq" and (known := LEVELS.get(str(f["value"]).lower())):
            mask, want = mask | SEVERITY_MASK, want | SEVERITIES.index(known)
    return mask, want


def where_spec(df: DataFrame, spec: dict | Column, now_ms: int = 0, content: str = "content", arrival: str = "arrival_ts", reference_mask: bool = False) -> DataFrame:
    """Lines that match. A stored ``is_json`` column prunes JSON specs; the full mask over stored ``flags`` is opt-in."""
    if isinstance(spec, Column):
        return df.filter(spec)
    spec, bounds = split_ts(check_spec(spec))
    parser, columns = spec.get("parser", "raw"), df.columns
    if bounds:
        df = df.filter(ts_bounds(F.col(arrival), bounds, now_ms))
    if reference_mask:
        mask, want = candidate_mask(spec)
        df = df.filter(F.col("flags").bitwiseAND(mask) == want)
    by_name = any(not f["field"].split(".")[0].isdigit() for f in spec.get("filters") or [])
    if parser == "json" and by_name and "is_json" in columns:
        df = df.filter("is_json")  # a line with a named root field starts with a brace
    return df.filter(spec_column(F.col(content), spec, now_ms))


def scan_flags(df: DataFrame, mask: int, want: int, limit: int | None = None) -> DataFrame:
    found = df.filter(F.col("flags").bitwiseAND(mask) == want)
    return found if limit is None else found.orderBy("line_no").limit(limit)


def line_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Lines in [start, end)."""
    return df.filter((F.col("line_no") >= start) & (F.col("line_no") < end))


def search(df: DataFrame, pattern: str | None = None, mode: str = "plain", case: bool = False, query: dict | Column | None = None, now_ms: int = 0, content: str = "content") -> DataFrame:
    """A structured query goes before pattern, mode and case."""
    if query is not None:
        return where_spec(df, query, now_ms, content)
    if pattern is None:
        raise ValueError("give a pattern or a query")
    if mode not in ("plain", "regex"):
        raise ValueError(f"unknown mode {mode!r}")
    return df.filter((match_regex if mode == "regex" else match_plain)(F.col(content), pattern, case))

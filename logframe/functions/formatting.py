"""Formatted values, labels and layouts of lines.

A layout is a list of entries: ``{"literal": text}`` or ``{"field": name, ...}`` with
``width``, ``max_width``, ``format`` (``datetime``, ``relative``, ``duration_ms``,
``duration_ns``, ``bytes``; for the field ``_rest``: ``kv`` or ``json``) and ``value_type``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logframe.functions.fields import NUMBER, auto_fields, java_regex, json_field, json_map, json_type, json_variant, let, logfmt_map, parse_ts, regex_map, rest_fields
from logframe.functions.metadata import FLAG_JSON, FLAG_LOGFMT

# fixed values: the built-in layouts, severity and status classes
LAYOUT_JSON = [
    {"field": "timestamp"}, {"literal": " "}, {"field": "level", "width": 5}, {"literal": " | "},
    {"field": "message"}, {"field": "msg"}, {"literal": " "}, {"field": "_rest"},
]
LAYOUT_LOGFMT = [{"field": "ts"}, {"literal": " "}, {"field": "level", "width": 5}, {"literal": " "}, {"field": "msg"}, {"literal": " "}, {"field": "_rest"}]
SEVERITY_CLASSES = {"error": "error", "err": "error", "fatal": "error", "warn": "warn", "warning": "warn", "info": "info", "debug": "debug", "trace": "trace"}
STATUS_CLASSES = {"2": "success", "3": "redirect", "4": "client_error", "5": "server_error"}
# end of fixed values


def number(c: Column) -> Column:
    """The text as a double, where it is one without suffix or blanks."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def _one(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x, 1))


def fmt_datetime(c: Column, mode: str = "absolute", now_ms: int | None = None) -> Column:
    """An ISO time as ``yyyy-MM-dd hh:mm:ss`` in UTC, or relative to ``now_ms``; null if it is none."""
    iso = F.when(c.rlike(r"^\s*[0-9]{4}-"), F.floor(parse_ts(F.replace(c, F.lit("t"), F.lit("T"))) / 1000))
    if mode == "absolute":
        return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(iso), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    if now_ms is None:
        raise ValueError("relative times need now_ms")
    # the time is read once, however many units are tried
    return let(F.lit(now_ms // 1000) - iso, _relative)


def _relative(ago: Column) -> Column:
    text = lambda by, unit: F.concat(F.floor(ago / by).cast("string"), F.lit(f"{unit} ago"))
    return F.when(ago < 0, F.concat(F.lit("in "), (-ago).cast("string"), F.lit("s"))).when(ago < 60, text(1, "s")).when(ago < 3600, text(60, "m")).when(ago < 86400, text(3600, "h")).when(ago.isNotNull(), text(86400, "d"))


def fmt_duration(c: Column, unit: str = "ms") -> Column:
    """A number of milliseconds or nanoseconds in us, ms, s, minutes or hours."""
    n = number(c.cast("string"))
    ms = n / 1_000_000 if unit == "ns" else n
    whole = lambda x: F.floor(x).cast("long").cast("string")
    plain = lambda x, u: F.concat(F.when(x == F.floor(x), whole(x)).otherwise(_one(x)), F.lit(u))
    seconds = F.floor(ms / 1000)
    two = lambda big, small, a, b: F.concat(whole(big), F.lit(a), F.when(small == 0, F.lit("")).otherwise(F.concat(F.lit(" "), whole(small), F.lit(b))))
    return (
        F.when(ms < 1, F.concat(F.format_string("%.0f", F.bround(ms * 1000)), F.lit("us"))).when(ms < 1000, plain(ms, "ms")).when(ms < 60_000, plain(ms / 1000, "s"))
        .when(ms < 3_600_000, two(seconds / 60, seconds % 60, "m", "s"))
        .when(ms.isNotNull() & ~F.isnan(ms), two(seconds / 3600, F.floor(seconds % 3600 / 60), "h", "m"))
    )


def _scaled(x: Column, steps: list[tuple[float, str]], small: Column, form) -> Column:
    out = None
    for size, unit in steps:
        text = F.concat(form(x / size), F.lit(unit))
        out = F.when(x >= size, text) if out is None else out.when(x >= size, text)
    return out.otherwise(small)


_BINARY = [(1024.0**4, "TB"), (1024.0**3, "GB"), (1024.0**2, "MB"), (1024.0, "KB")]


def fmt_bytes(c: Column) -> Column:
    x = number(c.cast("string"))
    return F.when(x.isNotNull(), _scaled(x, [(s, f" {u}") for s, u in _BINARY], F.concat(x.cast("long").cast("string"), F.lit(" B")), _one))


def _compact(x: Column) -> Column:
    return F.when(x >= 10, F.floor(x).cast("long").cast("string")).otherwise(_one(x))


def _upto(steps: list[tuple[float, str]], largest: str) -> list[tuple[float, str]]:
    units = [u for _, u in steps]
    if largest not in units:
        raise ValueError(f"no unit {largest!r} in {units}")
    return steps[units.index(largest) :]


def fmt_count(c: Column, largest: str = "Bn") -> Column:
    """A count in K, M or Bn; with ``largest`` in no larger unit than that one."""
    return _scaled(c.cast("double"), _upto([(1e9, "Bn"), (1e6, "M"), (1e3, "K")], largest), c.cast("long").cast("string"), _compact)


def fmt_size(c: Column, largest: str = "GB") -> Column:
    """A number of bytes in B, KB, MB or GB; with ``largest`` in no larger unit than that one."""
    return _scaled(c.cast("double"), _upto(_BINARY[1:], largest), F.concat(c.cast("long").cast("string"), F.lit("B")), _compact)


def fmt_rate(c: Column) -> Column:
    """Lines a second with the unit that keeps the value readable."""
    pick = lambda by, unit: F.concat(_one(c * by), F.lit(f" lines/{unit}"))
    return F.when(c >= 1, pick(1, "s")).when(c * 60 >= 1, pick(60, "min")).when(c.isNotNull(), pick(3600, "h"))


def fit(c: Column, width: int | None = None, max_width: int | None = None) -> Column:
    if width is not None:
        return F.rpad(c, width, " ")
    return c if max_width is None else F.substring(c, 1, max_width)


def severity_class(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in SEVERITY_CLASSES.items() for x in p])[F.lower(c)]


def status_class(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in STATUS_CLASSES.items() for x in p])[F.substring(c, 1, 1)]


def map_label(c: Column, labels: dict[str, str]) -> Column:
    found = F.create_map(*[F.lit(x) for p in labels.items() for x in p])[c]
    return F.coalesce(found, F.lit(labels.get("_default"))) if "_default" in labels else found


def rule_label(c: Column, fields: Column, rules: list[dict]) -> Column:
    """Label of the first rule that holds: {op, value, label, field?}; order comparisons are numeric only."""
    out = None
    for rule in rules:
        v, want, op = fields[rule["field"]] if rule.get("field") else c, str(rule["value"]), rule["op"]
        if op in ("gt", "lt", "gte", "lte"):
            n = float(want) if re.fullmatch(NUMBER.replace("(?i:", "(?:"), want, re.I) else None
            x = number(v)
            holds = F.lit(False) if n is None else {"gt": x > n, "lt": x < n, "gte": x >= n, "lte": x <= n}[op] & ~F.isnan(x)
        else:
            holds = {"eq": lambda: v == want, "ne": lambda: v != want, "contains": lambda: v.contains(want), "regex": lambda: v.rlike(java_regex(want))}[op]()
        holds = F.coalesce(holds, F.lit(False))
        out = F.when(holds, rule["label"]) if out is None else out.when(holds, rule["label"])
    return F.lit(None).cast("string") if out is None else out


_FORMATS = {
    "datetime": lambda v, now: fmt_datetime(v), "relative": lambda v, now: fmt_datetime(v, "relative", now),
    "duration_ms": lambda v, now: fmt_duration(v), "duration_ns": lambda v, now: fmt_duration(v, "ns"), "bytes": lambda v, now: fmt_bytes(v),
}


def layout_text(c: Column, layout: list[dict], parser: str | None = None, flags: Column | None = None, pattern: str | None = None, now_ms: int | None = None) -> Column:
    """Literals and fields in order; missing fields are left out, a blank stands between fields without a literal; null if no field matched."""
    if pattern:
        return let(regex_map(c, pattern), lambda m: _laid_out(c, m, layout, None, now_ms))
    if parser == "logfmt":
        return let(logfmt_map(c), lambda m: _laid_out(c, m, layout, None, now_ms))
    # a JSON line is parsed once: its variant is bound beside the map of its fields
    fields = (lambda v: json_map(c, v)) if parser == "json" else (lambda v: auto_fields(c, flags, v))
    return let(json_variant(c), lambda v: let(fields(v), lambda m: _laid_out(c, m, layout, v, now_ms, parser == "json")))


def _shown(raw: Column, form, now_ms: int | None) -> Column:
    return let(raw, lambda x: F.coalesce(form(x, now_ms), x))


def _laid_out(c: Column, fields: Column, layout: list[dict], variant: Column | None, now_ms: int | None, dotted: bool = False) -> Column:
    consumed = [e["field"] for e in layout if "field" in e and e["field"] != "_rest"]
    pieces: list[tuple[str, Column]] = []
    for e in layout:
        if "literal" in e:
            pieces.append(("literal", F.lit(e["literal"])))
            continue
        if e["field"] == "_rest":
            rest = rest_fields(fields, consumed)
            pairs = F.array_join(F.transform(rest, lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ")
            value = F.when(F.size(rest) > 0, F.to_json(F.map_from_entries(rest)) if e.get("format") == "json" else pairs)
        else:
            raw = json_field(c, e["field"], variant) if dotted and "." in e["field"] else fields[e["field"]]
            form = _FORMATS[e["format"]] if e.get("format") else None
            shown = _shown(raw, form, now_ms) if form else raw
            value = fit(shown, e.get("width"), e.get("max_width"))
        if e.get("value_type"):
            value = F.when(json_type(c, e["field"], variant) == e["value_type"], value)
        pieces.append(("field", value))
    # one pass over the pieces; what a missing field leaves out is null
    entries = F.array(*[F.struct(F.lit(kind == "field").alias("field"), value.alias("text")) for kind, value in pieces])
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("after"), F.lit(False).alias("any"))

    def put(state: Column, e: Column) -> Column:
        blank = F.when(e["field"] & state["after"], F.lit(" ")).otherwise(F.lit(""))
        put_on = F.struct(F.concat(state["out"], blank, e["text"]).alias("out"), e["field"].alias("after"), (state["any"] | e["field"]).alias("any"))
        return F.when(e["text"].isNull(), state).otherwise(put_on)

    return F.aggregate(entries, start, put, lambda s: F.when(s["any"], s["out"]))


def layout_first(c: Column, layouts: list[tuple[str | None, list[dict]]]) -> Column:
    """Text of the first (parser, layout) that shows a field."""
    return F.coalesce(*[layout_text(c, layout, parser) for parser, layout in layouts])


def glob_regex(pattern: str) -> str:
    return "(?s)^" + "".join(".*" if x == "*" else "." if x == "?" else "\\" + x if not x.isalnum() else x for x in pattern) + "$"


def detect_layout(file_name: Column, flags: Column, layouts: list[dict]) -> Column:
    """Name of the first layout {name, filename?, parser?}: a matching file name goes before a matching parser bit."""
    by_name = [F.when(file_name.rlike(glob_regex(x["filename"])), x["name"]) for x in layouts if x.get("filename")]
    bits = {"json": FLAG_JSON, "logfmt": FLAG_LOGFMT}
    by_flag = [F.when(flags.bitwiseAND(bits[x["parser"]]) != 0, x["name"]) for x in layouts if x.get("parser") in bits]
    return F.coalesce(*by_name, *by_flag, F.lit(None).cast("string"))

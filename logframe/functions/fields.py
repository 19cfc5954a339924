"""Fields inside lines: JSON by dotted path, logfmt, regular expressions, times."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pair, a bare key, or all behind an empty key. Every repeated group is possessive: it gives nothing back, so values of
#: any length are read in a loop; a group that may give back is walked by recursion and ends the JVM on long values.
_ENTRY = r"""(?U)=[\s\S]*+|[^\s=]++(?:="(?:[^"\\]++|\\[\s\S]|\\$)*+"?+|=\S*+)?+"""
_CLOSED = r'''^"(?:[^"\\]++|\\[\s\S])*+"$'''
#: How a JSON document begins and ends.
_DOCUMENT = r"""^[ \t\n\r]*(?:\{[\s\S]*\}|\[[\s\S]*\]|"[\s\S]*"|-?[0-9][0-9.eE+\-]*|true|false|null)[ \t\n\r]*$"""
#: Text that a plain float reader takes: no suffix, no blanks.
NUMBER = r"^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan))$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def json_variant(c: Column) -> Column:
    """The line's single JSON document inside an array, as a variant; null where the line is not strictly one document.

    A line that does not begin and end like a document is not parsed at all: a failing parse
    costs more than a good one. The parser stops after a first complete value, so a line
    that closes the bracket early could go on with anything; such a line must also parse
    inside braces, where the same text fails.
    """
    named = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    has = lambda x, i: F.try_variant_get(x, f"$[{i}]", "variant").isNotNull()
    listed = F.when(c.rlike(_DOCUMENT), F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))))
    return let(listed, lambda x: F.when(has(x, 0) & ~has(x, 1) & (~c.contains("]") | named.isNotNull()), x))


def valid_json(c: Column) -> Column:
    return json_variant(c).isNotNull()


def _paths(field: str) -> list[str]:
    """Variant paths that a dotted path may mean: a numeric part is an index of an array or a key of an object."""
    choices = [[f"[{int(p)}]", f'["{p}"]'] if p.isascii() and p.isdigit() else [f'["{p}"]'] for p in field.split(".")]
    return ["$[0]" + "".join(parts) for parts in product(*choices)]


def field_variant(v: Column, field: str) -> Column:
    """The value at a dotted path of a :func:`json_variant`; null if there is none."""
    return F.coalesce(*[F.try_variant_get(v, p, "variant") for p in _paths(field)])


def _text(x: Column, raw: Column) -> Column:
    """A variant as text; ``raw`` is the same number as it was written, where the path is plain: it is taken for numbers only, and once."""

    def told(kind: Column) -> Column:
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        plain = F.try_variant_get(x, "$", "string")
        number = let(raw, lambda r: F.when(r.rlike(r"^-?[0-9]+\.[0-9]+$"), r).otherwise(plain))
        return F.when(nested, F.to_json(x)).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT|BIGINT)"), number).otherwise(plain)

    return F.when(x.isNull(), None).when(F.is_variant_null(x), "null").otherwise(let(F.schema_of_variant(x), told))


def json_field(c: Column, field: str, v: Column | None = None) -> Column:
    """Text of a JSON field: strings raw, numbers and booleans as written, null as ``null``, nested values as compact JSON.

    Pass ``v``, a column holding :func:`json_variant`, to parse a line once for many fields.
    """
    # only a number with a point can be written otherwise than the variant tells it
    raw = F.when(c.contains("."), F.get_json_object(c, "$" + "".join(f"['{p}']" for p in field.split("."))))
    return let(field_variant(json_variant(c) if v is None else v, field), lambda x: _text(x, raw))


def json_type(c: Column, field: str, v: Column | None = None) -> Column:
    """string, number, bool, array or object; null for JSON null and for a missing field."""

    def named(kind: Column) -> Column:
        return (
            F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "bool").when(kind.rlike("^(DECIMAL|BIGINT|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number")
        )

    return let(F.schema_of_variant(field_variant(json_variant(c) if v is None else v, field)), named)


def _last_wins(entries: Column) -> Column:
    """A map of entries (at, key, value) in their order; of equal keys the last one stays. Sorted twice, so no key is searched for."""

    def last(sorted_: Column) -> Column:
        kept = F.filter(sorted_, lambda e, i: ~F.coalesce(F.get(sorted_, i + 1)["key"] == e["key"], F.lit(False)))
        return F.array_sort(F.transform(kept, lambda e: F.struct(e["at"].alias("at"), e["key"].alias("key"), e["value"].alias("value"))))

    by_key = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["at"].alias("at"), e["value"].alias("value"))))
    return let(let(by_key, last), lambda x: F.map_from_arrays(F.transform(x, lambda e: e["key"]), F.transform(x, lambda e: e["value"])))


def logfmt_map(c: Column) -> Column:
    """``key=value`` and ``key="quoted"`` pairs; bare keys are skipped, an empty key ends the line, the last duplicate wins.

    Linear in the line's length (but for the sort of its keys), whatever its values hold; an unclosed quote runs to the line's end.
    """
    matches = F.filter(F.regexp_extract_all(c, F.lit(_ENTRY), F.lit(0)), lambda m: m.rlike(r"(?U)^[^\s=]++="))

    def entry(m: Column, at: Column) -> Column:
        def cut(k: Column) -> Column:
            raw = F.substr(m, k + 1)
            closed = raw.rlike(_CLOSED)
            inner = F.substr(raw, F.lit(2), F.length(raw) - F.when(closed, 2).otherwise(1))
            for escaped, plain in (('\\"', '"'), ("\\\\", "\\"), ("\\n", "\n"), ("\\t", "\t")):
                inner = F.replace(inner, F.lit(escaped), F.lit(plain))
            return F.struct(at.alias("at"), F.substr(m, F.lit(1), k - 1).alias("key"), F.when(raw.startswith('"'), inner).otherwise(raw).alias("value"))

        return let(F.instr(m, "="), cut)

    return let(F.transform(matches, entry), _last_wins)


def java_regex(pattern: str, unicode: bool = True) -> str:
    """The pattern in Java's dialect; bad patterns fail here, on the driver."""
    from pyspark.sql import SparkSession

    java = re.sub(r"\(\?P<", "(?<", pattern)
    java = ("(?U)" if unicode else "") + java
    spark = SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "_jvm"):
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise ValueError(f"bad pattern {pattern!r}: {str(e).splitlines()[0]}") from None
    return java


def regex_map(c: Column, pattern: str) -> Column:
    """Named groups of the first match; null where there is none."""
    java = java_regex(pattern)
    names = re.findall(r"\(\?P?<([A-Za-z][A-Za-z0-9]*)>", pattern)
    order = [m[1] for m in re.finditer(r"\\.|\((?!\?)|\(\?P?<([A-Za-z][A-Za-z0-9]*)>", pattern) if not m[0].startswith("\\")]
    if not names:
        raise ValueError("the pattern has no named group")
    pairs = [x for n in names for x in (F.lit(n), F.regexp_extract(c, java, order.index(n) + 1))]
    return F.when(c.rlike(java), F.create_map(*pairs))


def json_map(c: Column, v: Column | None = None) -> Column:
    """Top-level fields of a JSON object as text; null for other lines."""
    top = F.try_variant_get(json_variant(c) if v is None else v, "$[0]", "map<string,variant>")
    return let(top, lambda m: F.when(F.json_object_keys(c).isNotNull(), F.transform_values(m, lambda k, x: _text(x, F.lit(None).cast("string")))))


def auto_fields(c: Column, flags: Column | None = None, v: Column | None = None) -> Column:
    """Fields of a JSON or logfmt line: by its flags, or by trying JSON objects, then logfmt with any pair.

    ``v`` is the line's :func:`json_variant` if it is at hand.
    """
    from logframe.functions.metadata import FLAG_JSON, FLAG_LOGFMT

    if flags is not None:
        return F.when(flags.bitwiseAND(FLAG_JSON) != 0, json_map(c, v)).when(flags.bitwiseAND(FLAG_LOGFMT) != 0, logfmt_map(c))
    return F.coalesce(json_map(c, v), let(logfmt_map(c), lambda m: F.when(F.size(m) > 0, m)))


def rest_fields(fields: Column, consumed: list[str]) -> Column:
    """Entries not consumed, sorted by key."""
    left = F.map_filter(fields, lambda k, v: ~k.isin(consumed)) if consumed else fields
    return F.array_sort(F.map_entries(left))


_TIME = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]*))?(?:([Zz])|([+-])(?:([0-9]{2}):([0-9]{2})|([0-9]{2})([0-9]{2})|([0-9]{2})))?"


def parse_ts(text: Column) -> Column:
    """Epoch milliseconds of 13 or 10 digits, or of an ISO time; null if it is none."""
    return let(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), _parse_trimmed)


#: The groups of ``_TIME`` that are digits or empty.
_DIGITS = (1, 2, 3, 4, 5, 6, 10, 11, 12, 13, 14)


def _parse_trimmed(t: Column) -> Column:
    # one match gives all groups and what follows, which alone may hold a comma; the zero keeps an empty group castable
    # (a cast that fails throws and catches, which takes most of the time of a row)
    groups = F.regexp_replace(t, f"(?s){_TIME}(.*)$", ",".join(f"0${i}" if i in _DIGITS else f"${i}" for i in range(1, 16)))
    numbers = lambda p: F.array(*[p[i - 1].cast("int") for i in _DIGITS])
    iso = F.when(t.rlike(_TIME), let(F.split(groups, ",", 15), lambda p: let(numbers(p), lambda n: _milliseconds(p, n))))
    return F.when(t.rlike("^[+-]?[0-9]+$"), F.when(F.length(t) == 13, t.try_cast("long")).when(F.length(t) == 10, t.try_cast("long") * 1000)).otherwise(iso)


def _milliseconds(p: Column, n: Column) -> Column:
    """From the groups of ``_TIME`` and what follows them, and the numbers of ``_DIGITS``."""
    part, number = (lambda i: p[i - 1]), (lambda i: n[_DIGITS.index(i)])
    month, day, hour, minute, second = (number(i) for i in range(2, 7))
    ok = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
    broken_zone = part(15).rlike("^[+-]") & (part(9) == "") & (part(8) == "")
    fraction = F.rpad(F.substring(part(7), 1, 3), 3, "0").cast("long")
    zone = F.when(part(9) == "-", -1).otherwise(1) * ((number(10) + number(12) + number(14)) * 60 + number(11) + number(13))
    days = F.unix_date(F.make_date(number(1), F.when(month.between(1, 12), month).otherwise(1), F.lit(1))) + day - 1
    seconds = days.cast("long") * 86400 + hour * 3600 + minute * 60 + second - zone * 60
    return F.when(ok & ~broken_zone, seconds * 1000 + fraction)


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_duration(text: str) -> int | None:
    """Seconds of ``1h30m`` and the like; None if malformed or zero."""
    if not re.fullmatch(r"(?:[0-9]+[smhdw])+", text):
        return None
    return sum(int(n) * _UNITS[u] for n, u in re.findall(r"([0-9]+)([smhdw])", text)) or None


def timestamp_ms(text: str) -> int | None:
    """:func:`parse_ts` for one literal, on the driver."""
    t = text.strip()
    if re.fullmatch(r"[+-]?[0-9]+", t):
        return int(t) if len(t) == 13 else int(t) * 1000 if len(t) == 10 else None
    m = re.match(_TIME, t)
    if not m or (re.match(r"[+-]", t[m.end() :]) and not m[9] and not m[8]):
        return None
    year, month, day, hour, minute, second = (int(m[i]) for i in range(1, 7))
    if not (1 <= month <= 12 and 1 <= day <= 31 and hour <= 23 and minute <= 59 and second <= 60):
        return None
    days = datetime.date(year, month, 1).toordinal() - datetime.date(1970, 1, 1).toordinal() + day - 1
    zone = (-1 if m[9] == "-" else 1) * (int(m[10] or m[12] or m[14] or 0) * 60 + int(m[11] or m[13] or 0))
    return ((days * 24 + hour) * 60 + minute - zone) * 60_000 + second * 1000 + int((m[7] or "")[:3].ljust(3, "0"))


def resolve_time(text: str, now_ms: int) -> int | None:
    """Epoch milliseconds of ``now``, ``now-1h30m``, ``now+5m`` or a timestamp; None if it is no time."""
    t = text.strip()
    if t == "now":
        return now_ms
    if m := re.fullmatch(r"now([+-])(.+)", t):
        seconds = parse_duration(m[2])
        return None if seconds is None else now_ms + (1 if m[1] == "+" else -1) * seconds * 1000
    return timestamp_ms(t)

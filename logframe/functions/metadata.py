"""Per-line metadata: emptiness, format, severity, packed flags, sizes, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.functions.fields import let

# fixed values: severity codes, flag bits, level aliases
SEVERITIES = ("unknown", "trace", "debug", "info", "warn", "error", "fatal")
FLAG_JSON, FLAG_LOGFMT, FLAG_ANSI, FLAG_TIMESTAMP, FLAG_EMPTY = 1 << 3, 1 << 4, 1 << 5, 1 << 6, 1 << 8
SEVERITY_MASK, TEMPLATE_SHIFT = 0b111, 16
LEVELS = {
    "trace": "trace", "debug": "debug", "info": "info", "warn": "warn", "warning": "warn", "error": "error", "err": "error",
    "fatal": "fatal", "critical": "fatal", "crit": "fatal", "emerg": "fatal", "emergency": "fatal", "panic": "fatal",
}
# end of fixed values
BLANK = r"[ \t\n\f\r]"
_KEYWORD = r"(?i)(?<![A-Za-z])(fatal|error|warning|warn|info|debug|trace)(?![A-Za-z])"
_CSI = r"\x1b\[[^@-~]*[@-~]"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def left_trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+", "")


def is_empty(c: Column) -> Column:
    return ~c.rlike(r"[^ \t\n\f\r]")


def is_json(c: Column) -> Column:
    return c.rlike(rf"^{BLANK}*\{{")


def has_ansi(c: Column) -> Column:
    return c.contains("\x1b")


def severity(c: Column) -> Column:
    """The first severity keyword that stands alone; a colour sequence counts as a word border."""
    plain = lambda x: F.when(has_ansi(x), F.regexp_replace(x, _CSI, " ")).otherwise(x)
    named = lambda w: F.when(w == "", "unknown").when(w == "warning", "warn").otherwise(w)
    # bound, as filters on the result would repeat the line's expression with every mention
    return let(c, lambda x: let(F.lower(F.regexp_extract(plain(x), _KEYWORD, 1)), named))


def is_logfmt(c: Column) -> Column:
    return ~is_json(c) & left_trimmed(c).rlike(rf"(^|{BLANK})[A-Za-z0-9_.]+=[^ \t\n\f\r]")


def has_timestamp(c: Column) -> Column:
    return F.substring(left_trimmed(c), 1, 30).rlike(r"[0-9]{4}-|[0-9]{2}:[0-9]{2}:[0-9]{2}")


def severity_code(s: Column) -> Column:
    return F.coalesce(_map({name: i for i, name in enumerate(SEVERITIES)})[s], F.lit(0))


def severity_label(flags: Column) -> Column:
    """Label of the severity bits; unknown has none."""
    return _map(dict(enumerate(SEVERITIES[1:], 1)))[flags.bitwiseAND(SEVERITY_MASK)]


def flags(c: Column) -> Column:
    """The packed word; an empty line has its own bit only."""

    def packed(x: Column) -> Column:
        bits = [F.when(on, F.lit(bit)).otherwise(F.lit(0)) for on, bit in ((is_json(x), FLAG_JSON), (is_logfmt(x), FLAG_LOGFMT), (has_ansi(x), FLAG_ANSI), (has_timestamp(x), FLAG_TIMESTAMP))]
        return F.when(is_empty(x), F.lit(FLAG_EMPTY)).otherwise(reduce(Column.bitwiseOR, bits, severity_code(severity(x))))

    return let(c, packed)


def template_id(f: Column) -> Column:
    return F.shiftrightunsigned(f, TEMPLATE_SHIFT).bitwiseAND(0xFFFF)


def with_template_id(f: Column, template: Column) -> Column:
    return f.bitwiseAND(0xFFFF).bitwiseOR(F.shiftleft(template.bitwiseAND(0xFFFF).cast("int"), TEMPLATE_SHIFT))


def level_severity(level: Column) -> Column:
    return _map(LEVELS)[F.lower(level)]


def fingerprint(c: Column) -> Column:
    """Hash of up to 256 bytes from the start of the line; for equality only."""
    return F.xxhash64(F.substring(c.cast("binary"), 1, 256))


# fixed values: the four kinds of escape sequences (CSI, OSC, character sets, two bytes)
_ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[()][A-Z0-9]|\x1b[^\[\]()0-9]"


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, _ANSI, "")


def truncate_line(c: Column, limit: int = 500) -> Column:
    """Longer lines cut at a character border of at most ``limit`` bytes, with the number of bytes left out."""
    raw = c.cast("binary")
    cut = F.coalesce(*[F.when(F.is_valid_utf8(F.substring(raw, 1, n).cast("string")), F.lit(n)) for n in range(limit, max(limit - 4, 0), -1)], F.lit(limit))
    size = F.octet_length(raw)
    head = F.substring(raw, F.lit(1), cut).cast("string")
    return F.when(size > limit, F.concat(head, F.lit("…[+"), (size - cut).cast("string"), F.lit(" chars]"))).otherwise(c)


def arrival_text(ms: Column) -> Column:
    """Epoch milliseconds as ``yyyy-MM-ddTHH:mm:ssZ``, milliseconds cut off, in UTC whatever the session's zone."""
    seconds = F.floor(ms / 1000)
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sanitize(c: Column) -> Column:
    """Invalid UTF-8 becomes U+FFFD; control characters but tab, BEL and ESC go."""
    return F.regexp_replace(F.make_valid_utf8(c), r"[\x00-\x06\x08\x0A-\x1A\x1C-\x1F]", "")


def with_metadata(lines: DataFrame, content: str = "content") -> DataFrame:
    """``lines`` with severity, is_empty, is_json, is_logfmt, has_ansi, has_timestamp, flags and fingerprint."""
    c = F.col(content)
    return lines.withColumns({
        "severity": severity(c), "is_empty": is_empty(c), "is_json": ~is_empty(c) & is_json(c), "is_logfmt": ~is_empty(c) & is_logfmt(c),
        "has_ansi": ~is_empty(c) & has_ansi(c), "has_timestamp": ~is_empty(c) & has_timestamp(c), "flags": flags(c), "fingerprint": fingerprint(c),
    })

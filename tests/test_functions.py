"""Tables of (input, expected) for the column functions."""

import pytest
from pyspark.sql import functions as F

from logframe.functions import fields as fl
from logframe.functions import formatting as fm
from logframe.functions import metadata as md
from logframe.sources.lines import valid_source_name

ESC = "\x1b"


def check(spark, build, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, c string")
    got = [r[0] for r in rows.select("i", build(F.col("c")).alias("x")).orderBy("i").select("x").collect()]
    assert [(c[0], g) for c, g in zip(cases, got)] == [(c[0], c[1]) for c in cases]


def test_severity(spark):
    check(spark, md.severity, [
        ("2024 INFO x error", "info"), ("MYERROR errors warnings error5", "error"), ("WARNING: disk", "warn"), ("nothing", "unknown"), ("", "unknown"), ("   ", "unknown"),
        (f"{ESC}[31mERROR{ESC}[0m x", "error"), (f"ER{ESC}[1mROR info", "info"), (f"{ESC}[31mmyerror", "unknown"), ("_error_", "error"), ("fatal1", "fatal"),
        ('{"msg":"warn ack","level":"error"}', "warn"), (None, None),
    ])


def test_flags(spark):
    check(spark, md.flags, [
        ("", md.FLAG_EMPTY), (" \t", md.FLAG_EMPTY), ('{"a":1}', md.FLAG_JSON), ("[1]", 0), ('  {"level":"info"}', md.FLAG_JSON | 3), ("a=1 b=2", md.FLAG_LOGFMT),
        ("GET /x?a=1", 0), ("x a.b_c=1", md.FLAG_LOGFMT), ("a= b", 0), ("2024-01-01 error", md.FLAG_TIMESTAMP | 5), ("at 10:20:30", md.FLAG_TIMESTAMP),
        (f"{ESC}[1mx", md.FLAG_ANSI), ("x" * 40 + " 10:20:30", 0),
    ])


def test_template_bits(spark):
    f = spark.sql("SELECT 5 AS f").select(md.with_template_id(F.col("f"), F.lit(65535)).alias("t"))
    assert f.select(md.template_id(F.col("t")), md.severity_label(F.col("t"))).first() == (65535, "error")


def test_text_cleaning(spark):
    check(spark, md.strip_ansi, [(f"{ESC}[1;31ma{ESC}[0m", "a"), (f"{ESC}]8;;http://x{ESC}\\link{ESC}]8;;\x07", "link"), (f"{ESC}(Bx{ESC}=y", "xy"), ("plain", "plain")])
    check(spark, md.sanitize, [("a\x01b\tc\x07\x1bd\r", "ab\tc\x07\x1bd")])
    check(spark, md.truncate_line, [("a" * 500, "a" * 500), ("a" * 503, "a" * 500 + "…[+3 chars]"), ("a" * 499 + "日b", "a" * 499 + "…[+4 chars]"), ("a" + "é" * 250, "a" + "é" * 249 + "…[+2 chars]")])
    assert spark.sql("SELECT 1700000000999L AS ms").select(md.arrival_text(F.col("ms"))).first()[0] == "2023-11-14T22:13:20Z"


def test_source_names(spark):
    check(spark, valid_source_name, [("app", True), ("", False), (".hid", False), ("a/b", False), ("a\\b", False), ("a:b", False), ("a*", False), ("a?", False), ("x" * 255, True), ("é" * 128, False), ("a\x00", False)])


@pytest.mark.parametrize(("field", "cases"), [
    ("a", [('{"a":"x"}', "x"), ('{"a":1}', "1"), ('{"a":1.0}', "1.0"), ('{"a":1.50}', "1.5"), ('{"a":true}', "true"), ('{"a":null}', "null"), ("{}", None), ('{"a":{"c":1,"b":[1]}}', '{"b":[1],"c":1}'),
           ('{"a":1} x', None), ('{"a":1}] x', None), ('{"a":1}} x', None), ("{'a':1}", None), ("", None), ('{"a":1}{"a":2}', None), ("text", None), (None, None)]),
    ("a.b", [('{"a":{"b":"x"}}', "x"), ('{"a.b":"y"}', None), ('{"a":[1]}', None)]),
    ("a.1", [('{"a":[5,"six"]}', "six"), ('{"a":{"1":"key"}}', "key"), ('{"a":[5]}', None)]),
    ("0.a", [('[{"a":7}]', "7")]),
])
def test_json_field(spark, field, cases):
    check(spark, lambda c: fl.json_field(c, field), cases)


def test_json_valid_and_type(spark):
    check(spark, fl.valid_json, [("[1,2]", True), ("3", True), ("null", True), ("nul", False), ("{} {}", False), ('{"a":01}', False), ("", False)])
    check(spark, lambda c: fl.json_type(c, "a"), [('{"a":1}', "number"), ('{"a":1.5}', "number"), ('{"a":"1"}', "string"), ('{"a":[]}', "array"), ('{"a":{}}', "object"), ('{"a":false}', "bool"), ('{"a":null}', None), ("{}", None)])


def test_logfmt_lines_of_any_length(spark):
    """Long quoted values, many pairs and unclosed quotes neither end the JVM nor take quadratic time."""
    trace = 'at f(\\"x\\")\\n'
    long = {n: 'id=7 msg="' + trace * (n // len(trace)) + '" level=error' for n in (1_000, 100_000, 10_000_000)}
    open_ = 'level=warn msg="' + "a b=c \\" * 20_000
    pairs = " ".join(f"k{i % 7_000}=v{i}" for i in range(10_000))
    odd = "x=" + '"' * 100_000, "\\" * 100_000, 'a="' + "\\" * 100_001, " ".join('q="z"' for _ in range(10_000)), "=" * 100_000, "word " * 20_000
    df = spark.createDataFrame([(x,) for x in (*long.values(), open_, pairs, *odd)], "c string").withColumn("m", fl.logfmt_map(F.col("c")))
    got = df.selectExpr("m['level'] AS level", "length(m['msg']) AS msg", "size(m) AS n", "m['k2999'] AS twice", "m['k6999'] AS once").collect()
    assert [(r["level"], r["n"]) for r in got[:3]] == [("error", 3)] * 3
    assert [r["msg"] for r in got[:3]] == [n // len(trace) * (len(trace) - 3) for n in long]
    assert (got[3]["level"], got[3]["n"]) == ("warn", 2)
    assert (got[4]["n"], got[4]["twice"], got[4]["once"]) == (7_000, "v9999", "v6999")
    assert [r["n"] for r in got[5:]] == [1, 0, 1, 1, 0, 0]


def test_logfmt(spark):
    check(spark, fl.logfmt_map, [
        ('level=error msg="a \\"q\\" b" x=', {"level": "error", "msg": 'a "q" b', "x": ""}), ("bare a=1 bare2 b=2", {"a": "1", "b": "2"}), ("dup=1 dup=2", {"dup": "2"}),
        ("a=1 =x b=2", {"a": "1"}), ('a="b"c=d', {"a": "b", "c": "d"}), ('a="open end', {"a": "open end"}), ('a="t\\tn\\nq"', {"a": "t\tn\nq"}), ("", {}), ("a=b=c", {"a": "b=c"}), ("é=ü", {"é": "ü"}), ("x　y=1", {"y": "1"}),
    ])


def test_other_maps(spark):
    check(spark, lambda c: fl.regex_map(c, r"(?P<a>\w+)-(x)?(?P<b>\d+)"), [("foo-12 bar-3", {"a": "foo", "b": "12"}), ("none", None)])
    check(spark, fl.auto_fields, [('{"a":1,"b":{"c":2}}', {"a": "1", "b": '{"c":2}'}), ("a=1", {"a": "1"}), ("nothing", None), ("[1]", None)])
    check(spark, lambda c: fl.rest_fields(fl.logfmt_map(c), ["b"]), [("c=3 a=1 b=2", [("a", "1"), ("c", "3")])])
    with pytest.raises(ValueError, match="bad pattern"):
        fl.java_regex("(")


TIMES = [
    ("1700000000", 1700000000000), ("1700000000123", 1700000000123), ("170000000", None), ("2024-01-15T10:30:00Z", 1705314600000), ("2024-01-15 10:30:00", 1705314600000),
    ("2024-01-15T10:30:00.1239+02:00", 1705307400123), ("2024-01-15T10:30:00-0130", 1705320000000), ("2024-01-15T10:30:00+02", 1705307400000), ("2024-01-15T10:30:00 trailing", 1705314600000),
    ("2024-02-31 10:55:00", 1709376900000), ("2024-13-01T00:00:00", None), ("2024-01-32T00:00:00", None), ("2024-01-01T24:00:00", None), ("2024-01-01T00:00:60", 1704067260000), ("2024-01-01", None),
    (" 2024-01-01T00:00:00Z ", 1704067200000), ("2024-01-01T00:00:00.5", 1704067200500), ("x", None), ("", None),
]


def test_times(spark):
    check(spark, fl.parse_ts, TIMES)
    assert [fl.timestamp_ms(t) for t, _ in TIMES] == [ms for _, ms in TIMES]
    now = 1_000_000_000_000
    assert [fl.resolve_time(t, now) for t in ("now", "now-1h30m", "now+5s", "now-0s", "now-5", "now 5s", "nowish")] == [now, now - 5_400_000, now + 5000, None, None, None, None]


def test_formats(spark):
    check(spark, fm.fmt_duration, [("0.5", "500us"), ("12", "12ms"), ("12.34", "12.3ms"), ("1500", "1.5s"), ("2000", "2s"), ("60000", "1m"), ("90000", "1m 30s"), ("3600000", "1h"), ("5400000", "1h 30m"), ("x", None)])
    check(spark, lambda c: fm.fmt_duration(c, "ns"), [("1500000", "1.5ms"), ("900000", "900us")])
    check(spark, fm.fmt_bytes, [("512", "512 B"), ("1536", "1.5 KB"), ("1048576", "1.0 MB"), ("1099511627776", "1.0 TB"), ("-", None)])
    check(spark, lambda c: fm.fmt_count(c.cast("long")), [("0", "0"), ("999", "999"), ("1200", "1.2K"), ("60000000", "60M"), ("1300000000", "1.3Bn")])
    check(spark, lambda c: fm.fmt_size(c.cast("long")), [("10", "10B"), ("2411725", "2.3MB"), ("20480", "20KB")])
    check(spark, lambda c: fm.fmt_rate(c.cast("double")), [("2.5", "2.5 lines/s"), ("0.5", "30.0 lines/min"), ("0.001", "3.6 lines/h")])
    check(spark, fm.fmt_datetime, [("2024-01-15T10:30:00.5+02:00", "2024-01-15 08:30:00"), ("nope", None)])
    now = 1705314600000
    check(spark, lambda c: fm.fmt_datetime(c, "relative", now), [("2024-01-15T10:29:30Z", "30s ago"), ("2024-01-15T10:00:00Z", "30m ago"), ("2024-01-15T08:30:00Z", "2h ago"), ("2024-01-10T10:30:00Z", "5d ago"), ("2024-01-15T10:30:09Z", "in 9s")])
    check(spark, lambda c: fm.fit(c, width=3), [("abcd", "abc"), ("a", "a  ")])


def test_layouts(spark):
    layout = [{"field": "a"}, {"field": "b", "width": 4}, {"literal": "|"}, {"field": "n", "format": "bytes"}, {"field": "_rest", "format": "json"}]
    check(spark, lambda c: fm.layout_text(c, layout, "json"), [('{"a":"x","b":"yy","n":2048,"z":1}', 'x yy  |2.0 KB {"z":"1"}'), ('{"b":"y"}', "y   |"), ("{}", None), ("text", None)])
    check(spark, lambda c: fm.layout_first(c, [("json", fm.LAYOUT_JSON), ("logfmt", fm.LAYOUT_LOGFMT)]), [("ts=1 level=info msg=hi k=v", "1 info  hi k=v"), ('{"level":"warn","msg":"m"}', " warn  | m "), ("plain", None)])
    typed = [{"field": "a", "value_type": "string"}, {"field": "b"}]
    check(spark, lambda c: fm.layout_text(c, typed, "json"), [('{"a":1,"b":2}', "2"), ('{"a":"s","b":2}', "s 2")])
    check(spark, lambda c: c.rlike(fm.glob_regex("app-?.l*g")), [("app-1.log", True), ("app-12.log", False), ("app-1.lg", True)])


def test_labels(spark):
    check(spark, fm.severity_class, [("ERR", "error"), ("Warning", "warn"), ("odd", None)])
    check(spark, fm.status_class, [("200", "success"), ("503", "server_error"), ("x", None)])
    rules = [{"op": "gt", "value": "5", "label": "big"}, {"op": "regex", "value": "^a", "label": "a"}]
    check(spark, lambda c: fm.rule_label(c, F.create_map(F.lit("q"), c), rules), [("6", "big"), ("5", None), ("abc", "a"), ("nan", None)])


def test_a_time_without_zone_is_read_without_failing_casts(spark):
    # a failing cast throws inside and takes most of a row's time; a comma behind the time belongs to what follows
    rows = spark.range(1).select(F.lit("2024-01-15T10:30:00").alias("c"))
    plan = rows.select(fl.parse_ts(F.col("c")).alias("ms"))._jdf.queryExecution().analyzed().toString()
    assert "try_to_number" not in plan and plan.count("regexp_extract") == 0
    check(spark, fl.parse_ts, [("2024-01-15T10:30:00,5+02:00", 1705314600000), ("2024-01-15T10:30:00+1:30", None), ("2024-01-15T10:30:00Z+1,2", 1705314600000), ("2024-01-15T10:30:00\nx,y", 1705314600000)])

"""Predicates, aggregates, positions, merging and checks on small tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from logframe.functions import metadata as md
from logframe.operators import aggregate as ag
from logframe.operators import checks as ch
from logframe.operators import merge as mg
from logframe.operators import position as po
from logframe.operators import predicates as pr
from logframe.operators import query as qy
from logframe.operators.blocks import last_known, running

TS = dt.datetime(2024, 1, 1)


def lines(spark, texts, source="s"):
    return spark.createDataFrame([(source, i, t) for i, t in enumerate(texts)], "source string, line_no long, content string")


def hits(df):
    return sorted(r.line_no for r in df.select("line_no").collect())


JSON = ['{"level":"error","n":500,"t":"2024-01-15T10:00:00Z"}', '{"level":"warn","n":500.0}', '{"level":null,"n":"abc"}', '{"n":60}', "not json", '{"level":"errors","n":"nan"}', "[1]"]


@pytest.mark.parametrize(("filters", "want"), [
    ([], [0, 1, 2, 3, 5, 6]), ([("level", "eq", "error")], [0]), ([("level", "ne", "error")], [1, 2, 5]), ([("level", "eq", "null")], [2]), ([("level", "contains", "err")], [0, 5]),
    ([("level", "regex", "^err")], [0, 5]), ([("level", "not_regex", "^err")], [1, 2]), ([("n", "eq", "500")], [0]), ([("n", "gt", "100")], [0, 1, 2]), ([("n", "lt", "100")], [3]),
    ([("n", "gte", "500.0")], [0, 1, 2]), ([("n", "gt", "aaa")], [2, 5]), ([("t", "gte", "2024-01-15T09:59:59Z")], [0]), ([("t", "gt", "now-1d")], []), ([("n", "gt", "1000000000")], []),
    ([("level", "eq", "error"), ("n", "lt", "10")], []), ([("0", "eq", "1")], [6]),
])
def test_json_filters(spark, filters, want):
    spec = {"parser": "json", "filters": [{"field": f, "op": o, "value": v} for f, o, v in filters]}
    rows = lines(spark, JSON)
    assert hits(pr.where_spec(rows, spec, now_ms=1_800_000_000_000)) == want
    assert hits(pr.where_spec(md.with_metadata(rows), spec, now_ms=1_800_000_000_000)) == ([i for i in want if i != 6] if filters and filters[0][0] != "0" else want)


def test_other_specs(spark):
    rows = lines(spark, ["a=1 b=x y", 'a=2 b="x y"', "none", "c.d=5"])
    assert hits(pr.where_spec(rows, {"parser": "logfmt"})) == [0, 1, 2, 3]
    assert hits(pr.where_spec(rows, {"parser": "logfmt", "filters": [{"field": "c.d", "op": "eq", "value": "5"}]})) == [3]
    assert hits(pr.where_spec(rows, {"parser": "logfmt", "exclude": [{"field": "b", "pattern": "x"}]})) == [2, 3]
    assert hits(pr.where_spec(rows, {"parser": "raw"})) == [0, 1, 2, 3]
    assert hits(pr.where_spec(rows, {"parser": "raw", "exclude": [{"field": "b", "pattern": "x"}]})) == []
    assert hits(pr.where_spec(rows, F.col("content").contains("none"))) == [2]
    for bad in ({"parser": "xml"}, {"parser": "json", "filters": [{"field": "a", "op": "like", "value": "1"}]}, {"parser": "json", "filters": [{"field": "a", "op": "regex", "value": "("}]}):
        with pytest.raises(ValueError):
            pr.where_spec(rows, bad)


def test_time_bounds(spark):
    rows = lines(spark, ["a", "b", "c"]).withColumn("arrival_ts", F.when(F.col("line_no") < 2, F.lit(TS) + F.make_dt_interval(hours=F.col("line_no").cast("int"))))
    spec = lambda op, v: {"parser": "raw", "filters": [{"field": "@ts", "op": op, "value": v}]}
    assert hits(pr.where_spec(rows, spec("gte", "2024-01-01T01:00:00Z"))) == [1]
    assert hits(pr.where_spec(rows, spec("lt", "2024-01-01 01:00:00"))) == [0]
    for bad in (("eq", "2024-01-01T00:00:00"), ("gt", "soon")):
        with pytest.raises(ValueError):
            pr.where_spec(rows, spec(*bad))


def test_masks(spark):
    assert pr.candidate_mask({"parser": "json", "filters": [{"field": "level", "op": "eq", "value": "CRIT"}]}) == (md.FLAG_JSON | md.FLAG_EMPTY | 7, md.FLAG_JSON | 6)
    assert pr.candidate_mask({"parser": "raw"}) == (0, 0)
    rows = md.with_metadata(lines(spark, ['{"msg":"warn ack","level":"error"}', '{"level":"error"}']))
    spec = {"parser": "json", "filters": [{"field": "level", "op": "eq", "value": "error"}]}
    assert hits(pr.where_spec(rows, spec)) == [0, 1]
    assert hits(pr.where_spec(rows, spec, reference_mask=True)) == [1]
    assert hits(pr.scan_flags(rows, md.SEVERITY_MASK, 5, limit=1)) == [1]


def test_search(spark):
    rows = lines(spark, ["Straße ERROR", "error", "Éclair", "", "x"])
    assert hits(pr.search(rows, "error")) == [0, 1]
    assert hits(pr.search(rows, "éclair")) == [2]
    assert hits(pr.search(rows, "")) == [0, 1, 2, 3, 4]
    assert hits(rows.filter(pr.match_plain(F.col("content"), "éCLAIR", ascii_only=True))) == []
    assert hits(rows.filter(pr.match_plain(F.col("content"), "", ascii_only=True))) == []
    assert hits(pr.search(rows, r"^\w$", mode="regex")) == [4]
    assert hits(pr.search(rows, "ignored", query={"parser": "raw"})) == [0, 1, 2, 3, 4]
    assert hits(pr.line_range(rows, 1, 3)) == [1, 2]


def test_count_by(spark):
    rows = lines(spark, ['{"a":"x"}', '{"a":"x"}', '{"a":"y"}', '{"b":1}', "bad", '{"a":"y"}'])
    got = [tuple(r) for r in ag.count_by(rows, ["a"], members=1).collect()]
    assert got == [("x", 2, [0], 6), ("y", 2, [2], 6), ("<missing>", 1, [3], 6), ("<parse error>", 1, [4], 6)]
    assert [r.a for r in ag.count_by(rows, ["a"], top=2).collect()] == ["x", "y"]
    assert ag.count_by(rows.limit(0), ["a"]).collect() == []
    assert hits(ag.drill_down(rows, {"a": "<missing>"})) == [3]
    assert hits(ag.drill_down(rows, {"a": "y"})) == [2, 5]
    assert ag.count_by(rows, ["a", "q.r"], "json", members=2).filter("a = 'x'").first()["line_indices"] == [0, 1]
    assert tuple(ag.totals(rows, F.col("content") == "bad").first()) == (6, 1)


def test_running_blocks(spark):
    rows = spark.range(1000).select((F.col("id") % 2).cast("string").alias("source"), F.floor(F.col("id") / 2).alias("line_no"), (F.col("id") % 7).alias("v"))
    got = {(r.source, r.line_no): (r.b, r.i) for r in running(running(rows, F.col("v"), "b", size=9), F.col("v"), "i", inclusive=True, size=16).collect()}
    total = {"0": 0, "1": 0}
    for i in range(1000):
        s, v = str(i % 2), i % 7
        assert got[(s, i // 2)] == (total[s], total[s] + v)
        total[s] += v
    holes = rows.withColumn("v", F.when(F.col("line_no") % 50 == 3, F.col("v")))
    seen = {(r.source, r.line_no): r.k for r in last_known(holes, "v", "k", size=8).collect()}
    for s in "01":
        last = None
        for n in range(500):
            last = (2 * n + int(s)) % 7 if n % 50 == 3 else last
            assert seen[(s, n)] == last


def timed(spark):
    rows = [("a", i, ["error", "info", "warn"][i % 3], TS + dt.timedelta(seconds=i)) for i in range(250)]
    return spark.createDataFrame(rows, "source string, line_no long, content string, arrival_ts timestamp").withColumn("severity", md.severity(F.col("content")))


def test_statistics(spark):
    df = timed(spark)
    points = ag.checkpoints(df).orderBy("line_no").collect()
    assert [(p.line_no, p.n_error, p.n_info, p.n_warn) for p in points] == [(99, 34, 33, 33), (199, 67, 67, 66), (249, 84, 83, 83)]
    assert ag.ingest_rate(ag.checkpoints(df)).first()["lines_per_second"] == 1.0
    assert ag.ingest_rate(ag.checkpoints(df.filter("line_no < 50"))).first()["lines_per_second"] is None
    row = ag.stats(df).first()
    assert (row.lines, row.n_error, row.start_ts, row.end_ts) == (250, 84, TS, TS + dt.timedelta(seconds=249))
    assert ag.time_range(df.withColumn("arrival_ts", F.when(F.col("line_no") > 0, F.col("arrival_ts")))).first()["end_ts"] is None
    bars = [tuple(r) for r in ag.severity_bars(ag.severity_counts(df.filter("line_no < 1 or severity = 'info'"))).collect()]
    assert bars == [("a", "error", 1, 1), ("a", "info", 83, 10)]
    assert tuple(ag.search_summary(df, 10).first()) == (250, True)


def test_positions(spark):
    df = timed(spark)
    assert hits(po.get_lines(df, 248, 5)) == [248, 249] and not po.get_lines(df, 248, 5).first()["has_more"]
    assert hits(po.get_tail(df, 3)) == [247, 248, 249] and po.get_tail(df, 3).first()["has_more"]
    assert hits(po.get_tail(df, 2, since_line=10)) == [11, 12] and po.get_tail(df, 2, since_line=10).first()["has_more"]
    assert not po.get_tail(df, 5, since_line=244).first()["has_more"]
    assert [(r.line_no, r.role) for r in po.get_context(df, 0, 2, 1).orderBy("line_no").collect()] == [(0, "target"), (1, "after")]
    for bad in (lambda: po.get_context(df, 999), lambda: po.get_context(df, 1, before=51), lambda: po.get_lines(df, 0, 1001)):
        with pytest.raises(ValueError):
            bad()
    found = po.with_context(df.filter("line_no in (0, 2)"), df, 1).orderBy("line_no").collect()
    assert [(r.line_no, r.content, r.before, r.after) for r in found] == [(0, "error", [], ["info"]), (2, "warn", ["info"], ["error"])]
    errors = df.filter("severity = 'error'")
    assert [(r.line_no, r.display_no) for r in po.page(errors, 1, 2).orderBy("line_no").collect()] == [(3, 2), (6, 3)]
    assert po.nearest_match(df.filter("line_no in (10, 14)"), 12).first()["line_no"] == 10
    assert hits(po.first_matches(errors, 2)) == [0, 3]


def test_merge(spark):
    t = lambda s: None if s is None else TS + dt.timedelta(seconds=s)
    make = lambda name, xs: spark.createDataFrame([(name, i, name + str(i), t(x)) for i, x in enumerate(xs)], "source string, line_no long, content string, arrival_ts timestamp")
    a, b = make("a", [None, 1, None, 5]), make("b", [0, 1, 4])
    assert [r.content for r in mg.merge_sources([a, b]).collect()] == ["a0", "b0", "a1", "a2", "b1", "b2", "a3"]
    rows = mg.tag_sources([a, b])
    grown = mg.append_merge(mg.merge_sources(rows.filter("line_no < 2")), rows)
    assert [r.content for r in grown.collect()] == ["a0", "b0", "a1", "a2", "b1", "b2", "a3"]
    assert mg.merge_by_category(rows.withColumn("category", F.col("source"))).count() == 0
    assert mg.merge_by_category(rows.withColumn("category", F.lit("x"))).count() == 7


def stored(spark, texts):
    rows, at = [], 0
    for i, t in enumerate(texts):
        rows.append(("s", i, t, at, len(t), 0))
        at += len(t) + 1
    df = spark.createDataFrame(rows, "source string, line_no long, content string, byte_offset long, byte_length int, flags int")
    return df.withColumn("fingerprint", md.fingerprint(F.col("content")))


def test_checks(spark):
    texts = [f"line {i}" for i in range(50)]
    good = stored(spark, texts)
    sizes = spark.createDataFrame([("s", sum(len(t) + 1 for t in texts))], "name string, size_bytes long")
    assert ch.structural_violations(good, sizes, block=7).count() == 0
    assert [(r.line_no, r.problem) for r in ch.structural_violations(good.filter("line_no <> 14"), block=7).collect()] == [(15, "line number gap")]
    moved = good.withColumn("byte_offset", F.when(F.col("line_no") == 20, F.lit(3)).otherwise(F.col("byte_offset")))
    assert {r.line_no: r.problem for r in ch.structural_violations(moved, block=7).collect()} == {20: "offset does not rise", 21: "not at a line boundary"}
    cut = sizes.withColumn("size_bytes", F.lit(30).cast("long"))
    assert ch.structural_violations(good, cut).filter("problem = 'outside the file'").count() == 46
    assert ch.shrunk_sources(good, cut).count() == 1 and ch.shrunk_sources(good, sizes).count() == 0
    points = good.filter("line_no % 10 = 9")
    edited = stored(spark, [t if i < 25 else "x" + t for i, t in enumerate(texts)])
    assert tuple(ch.trusted_prefix(points, good).first()) == ("s", 49, True)
    assert tuple(ch.trusted_prefix(points, edited).first()) == ("s", 19, False)
    assert tuple(ch.trusted_prefix(points, edited.limit(0)).first()) == ("s", None, False)
    mended = ch.repair(good, edited, ch.trusted_prefix(points, edited))
    assert [r.content for r in mended.orderBy("line_no").collect()] == [r.content for r in edited.orderBy("line_no").collect()]


def test_run_query(spark):
    rows = lines(spark, ['{"l":"error","s":"a"}', "x" * 600, '{"l":"error","s":"b"}', '{"l":"info","s":"a"}', '{"l":"error","s":"a"}', "\x1b[31mred\x1b[0m"])
    spec = {"parser": "json", "filters": [{"field": "l", "op": "eq", "value": "error"}]}
    got = qy.run_query(rows, spec, max_results=2, context=1).collect()
    assert [(r.line_no, r.total_matches, r.truncated, len(r.before), len(r.after)) for r in got] == [(0, 3, True, 0, 1), (2, 3, True, 1, 1)]
    assert got[0].after[0].startswith("x" * 500 + "…[+100") and qy.run_query(rows, spec, context=1, full=True).first().after == ["x" * 600]
    counted = qy.run_query(rows, {**spec, "aggregate": {"type": "count_by", "fields": ["s"], "limit": 1}}).collect()
    assert [tuple(r) for r in counted] == [("a", 2, 3)]
    assert [tuple(r) for r in qy.run_query(rows, {**spec, "aggregate": {"type": "count_by", "fields": ["s"]}}).collect()] == [("a", 2, 3), ("b", 1, 3)]
    red = lambda **o: qy.run_query(rows, pattern="red", **o).first()
    assert red().content == "red" and red(raw=True).content == "\x1b[31mred\x1b[0m" and red(include_ts=True).arrival is None
    assert qy.run_query(md.with_metadata(rows).withColumn("arrival_ts", F.lit(TS)), spec, include_ts=True).first().arrival == "2024-01-01T00:00:00Z"
    assert qy.run_query(rows, pattern="nothing").collect() == []
    for bad in ({"parsr": "json"}, {"filters": [{"field": "a", "value": "1"}]}, {"filters": [{"field": "a", "op": "eq", "value": "1", "x": 1}]}, {"aggregate": {"type": "sum", "fields": ["a"]}}, {"aggregate": {"type": "count_by", "fields": []}}, {"exclude": ["a"]}):
        with pytest.raises(ValueError):
            qy.run_query(rows, bad)
    apart = {"parser": "raw", "ts_filters": [{"op": "gte", "value": "2024-01-02T00:00:00Z"}]}
    assert pr.where_spec(rows.withColumn("arrival_ts", F.lit(TS)), apart).count() == 0


def test_members_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ag, "BLOCK", 7)
    monkeypatch.setattr(ag, "FAN", 3)
    rows = spark.range(500).select(F.lit("s").alias("source"), F.col("id").alias("line_no"), F.concat(F.lit('{"a":"'), (F.col("id") % 60 == 0).cast("string"), F.lit('"}')).alias("content"))
    got = {r.a: (r["count"], r.line_indices) for r in ag.count_by(rows, ["a"], members=4).collect()}
    assert got == {"true": (9, [0, 60, 120, 180]), "false": (491, [1, 2, 3, 4])}


def test_plans_read_lines_once(spark, tmp_path):
    timed(spark).withColumn("content", F.lit('{"a":"x"}')).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    scans = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet")
    assert scans(ag.checkpoints(rows)) == 1 and scans(ag.stats(rows)) == 1 and scans(po.page(rows, 1, 2)) == 2
    assert scans(ag.count_by(rows, ["a"], members=2)) == 1
    flagged = pr.scan_flags(rows.withColumn("flags", md.flags(F.concat("content", F.lit(" marker")))), 1, 1)
    assert flagged._jdf.queryExecution().optimizedPlan().toString().count(" marker") <= 3  # the line's expression is not repeated for every mention


def scans(df):
    """File scans of a plan, without those that read no column."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"Relation \[", plan))


def test_plans_have_few_scans(spark, tmp_path):
    rows = lines(spark, [f"{'WARN' if i % 7 == 0 else 'INFO'} {i}" for i in range(500)])
    rows.withColumns({"arrival_ts": F.lit(TS), "source_ord": F.lit(0), "byte_offset": F.col("line_no") * 10, "byte_length": F.lit(9), "flags": F.lit(0), "merge_ts": F.lit(TS)}).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert scans(ch.structural_violations(t)) == 1
    assert scans(ag.count_by(t, ["x"], members=3).drop("total_matches")) == 1
    old, new = t.filter("line_no < 100").select("source", "source_ord", "line_no", "content", "arrival_ts", "merge_ts"), t.select("source", "source_ord", "line_no", "content", "arrival_ts")
    known = spark.createDataFrame([("s", 99, TS)], "source string, line_no long, merge_ts timestamp")
    assert scans(mg.append_merge(old, new, known=known)) == 3  # the old lines once, the new ones for their times and as they are
    found = qy.run_query(t, pattern="WARN", case=True, context=2, max_results=10)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and final.count("(content#") + final.count("Contains(content") <= 4
    got = found.orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == [7 * i for i in range(10)] and got[1]["before"] == ["INFO 5", "INFO 6"] and got[0]["before"] == [] and got[0]["lines_searched"] == 500


def test_rendered_lines(spark):
    rows = lines(spark, ['{"level":"error","msg":"something failed"}', "level=warn msg=hm", "plain text line", '{"other":1}'])
    layouts = [("json", [{"field": "level"}, {"literal": " - "}, {"field": "msg"}]), ("logfmt", [{"field": "msg"}])]
    got = {r["line_no"]: r["rendered"] for r in qy.readable(rows, layouts=layouts).collect()}
    assert got == {0: "error - something failed", 1: "hm", 2: None, 3: None}
    assert "rendered" not in qy.readable(rows).columns
    found = qy.run_query(rows, pattern="failed", layouts=layouts).first()
    assert found["rendered"] == "error - something failed" and found["lines_searched"] == 4 and found["content"].startswith("{")


def test_members_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(ag, "BLOCK", 10)
    monkeypatch.setattr(ag, "FAN", 3)
    rows = spark.range(20_000).select(F.concat(F.lit("s"), F.col("id") % 997).alias("source"), F.floor(F.col("id") / 997).alias("line_no"), F.lit('{"a":"x"}').alias("content"))
    got = ag.count_by(rows, ["a"], members=5, named=True).first()
    want = sorted((i // 997, f"s{i % 997}") for i in range(20_000))[:5]
    assert got["count"] == 20_000 and [(m["line_no"], m["source"]) for m in got["members"]] == want and got["line_indices"] == [n for n, _ in want]

"""Stored logs with blocks, captures with numbers, stored merged views, and generations of growing files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from logframe.functions import metadata as md
from logframe.operators import aggregate as ag
from logframe.operators import merge as mg
from logframe.operators import position as po
from logframe.operators.small import attach
from logframe.sources import indexed, merged, tail
from logframe.streaming import generations, live

TS = dt.datetime(2024, 1, 1)
LEVELS = ["ERROR boom", "WARN hm", "INFO fine", "plain text", '{"level":"debug"}', "level=trace x=1"]


def log_lines(spark, sizes, start=0):
    rows = [(s, i, f"{LEVELS[(i * 7 + len(s)) % 6]} {i}", TS + dt.timedelta(seconds=i)) for s, n in sizes.items() for i in range(start, n)]
    return spark.createDataFrame(rows, "source string, line_no long, content string, arrival_ts timestamp")


def files_of(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(*a.columns)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_append_after_append_is_one_build(spark, tmp_path):
    whole = log_lines(spark, {"a": 1050, "b": 730, "007": 90, "late": 0}).withColumn("byte_offset", F.col("line_no") * 30).withColumn("byte_length", F.lit(29))
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    indexed.append_log(whole, one)
    for n in (40, 100, 333, 333, 2000):
        indexed.append_log(whole.filter(F.col("line_no") < n), many)
    assert indexed.read_log(spark, many).count() == whole.count()
    same(indexed.read_log(spark, one), indexed.read_log(spark, many))
    same(indexed.read_blocks(spark, one), indexed.read_blocks(spark, many))
    named = whole.withColumns({"severity": md.severity(F.col("content")), "fingerprint": md.fingerprint(F.col("content"))})
    same(indexed.stored_stats(spark, many).drop("columns"), ag.stats(named).drop("columns"))
    points = ag.checkpoints(named)
    same(indexed.stored_checkpoints(spark, many).select(*points.columns), points)
    same(indexed.stored_rate(spark, many), ag.ingest_rate(points))
    assert po.get_lines(indexed.read_log(spark, many), 100, 5).count() == 10


def test_stored_statistics_read_no_lines(spark, tmp_path):
    out = str(tmp_path / "log")
    indexed.append_log(log_lines(spark, {"a": 500}), out)
    for df in (indexed.stored_stats(spark, out), indexed.stored_checkpoints(spark, out), indexed.stored_rate(spark, out)):
        assert all("/blocks" in f for f in df.inputFiles()) and df.inputFiles()


def test_an_append_that_stops_midway_leaves_no_trace(spark, tmp_path, monkeypatch):
    out, rows = str(tmp_path / "log"), log_lines(spark, {"a": 300, "b": 50})
    indexed.append_log(rows.filter("line_no < 120"), out)
    before = indexed.read_log(spark, out).count()

    def stop(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(indexed, "line_blocks", stop)  # after the lines, before the blocks
        with pytest.raises(RuntimeError):
            indexed.append_log(rows, out)
    assert os.path.isdir(f"{out}/lines/batch=1") and indexed.read_log(spark, out).count() == before
    indexed.append_log(rows, out)
    assert indexed.read_log(spark, out).count() == 350 == indexed.read_log(spark, out).select("source", "line_no").distinct().count()
    assert indexed.stored_stats(spark, out).agg(F.sum("lines")).first()[0] == 350
    with pytest.raises(ValueError, match="no stored log"):
        indexed.read_log(spark, str(tmp_path / "nothing"))


def test_capture_numbers_lines_once(spark, tmp_path, monkeypatch):
    data, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    data.mkdir()

    def offer(name, n, first):
        (data / name).write_text("".join(f"{s}|{LEVELS[i % 6]} {i}\n" for i in range(first, first + n) for s in ("a", "b")))

    def run():
        raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(data))
        stream = raw.select(F.regexp_extract("value", r"^(\w+)\|", 1).alias("source"), F.regexp_replace("value", r"^\w+\|", "").alias("content"))
        q = indexed.capture_log(stream, out, cp)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    offer("1.txt", 130, 0)
    run()
    offer("2.txt", 70, 130)
    write = indexed._write
    calls = []

    def die(lines, *args):
        if not calls:
            calls.append(1)
            lines.write.parquet(f"{out}/lines/batch=1")  # half of a batch, then a kill
            raise RuntimeError("killed")
        write(lines, *args)

    monkeypatch.setattr(indexed, "_write", die)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    offer("3.txt", 11, 200)
    run()
    got = indexed.read_log(spark, out)
    for s in ("a", "b"):
        rows = got.filter(F.col("source") == s).orderBy("line_no").collect()
        assert [r["line_no"] for r in rows] == list(range(211))
        assert [r["content"] for r in rows] == [f"{LEVELS[i % 6]} {i}" for i in range(211)]
        text = "".join(r["content"] + "\n" for r in rows).encode()
        assert all(text[r["byte_offset"] : r["byte_offset"] + r["byte_length"]].decode() == r["content"] for r in rows)
    assert po.page(got.filter("severity = 'error'"), 3, 2).count() == 4
    last = indexed.stored_checkpoints(spark, out).filter("source = 'a'").orderBy(F.desc("line_no")).first()
    assert last["line_no"] == 210 and last["n_error"] == got.filter("source = 'a' AND severity = 'error'").count()
    # a batch that was committed before the stop is not stored again
    commit = indexed._committed(spark, out)
    assert commit["capture"] == cp and commit["epoch"] == 2


def test_names_of_digits_stay_and_captures_take_turns(spark, tmp_path):
    out, data = str(tmp_path / "out"), tmp_path / "in"
    data.mkdir()
    indexed.append_log(log_lines(spark, {"007": 5, "08": 3}), out)
    assert {r["source"] for r in indexed.read_log(spark, out).select("source").distinct().collect()} == {"007", "08"}

    def run(cp):
        raw = spark.readStream.text(str(data)).select(F.lit("007").alias("source"), F.col("value").alias("content"))
        q = indexed.capture_log(raw, out, str(tmp_path / cp))
        q.processAllAvailable()
        q.stop()

    for i, cp in enumerate(("one", "two", "one")):
        (data / f"{i}.txt").write_text(f"line {i}\n")
        run(cp)
    # the last batch of the first capture was committed, but its stream does not know
    commits = sorted((tmp_path / "one" / "commits").iterdir())
    run("two")
    for f in (tmp_path / "one" / "commits").iterdir():
        if f.name.strip(".").startswith("1"):
            f.unlink()
    before = indexed.read_log(spark, out).count()
    run("one")
    assert commits and indexed.read_log(spark, out).count() == before
    rows = indexed.read_log(spark, out).filter("source = '007'").orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == list(range(11)) and sorted(r["content"] for r in rows[5:]) == ["line 0"] * 2 + ["line 1"] * 2 + ["line 2"] * 2


def test_merged_buckets_are_left_alone(spark, tmp_path):
    out, hour = str(tmp_path / "merged"), 3600
    rows = [(s, o, i, TS + dt.timedelta(seconds=i * 60 + o) if i % 5 else None) for o, s in enumerate(("a", "b", "c")) for i in range(600)]
    df = spark.createDataFrame(rows, "source string, source_ord int, line_no long, arrival_ts timestamp")
    first = merged.append_merged(df.filter("line_no < 300"), out, seconds=hour)
    assert first["rewritten"] == [] and len(first["appended"]) == 6  # five hours, and the epoch for what has no time yet
    before = files_of(f"{out}/lines")
    # all later: one bucket gets a further file or is rewritten, the rest is new
    second = merged.append_merged(df.filter("line_no < 420"), out, seconds=hour)
    after = files_of(f"{out}/lines")
    touched = {f"bucket={b}" for b in second["rewritten"]}
    assert all(after.get(f) == t for f, t in before.items() if f.split("/")[-2] not in touched) and len(second["rewritten"]) <= 1
    # one source lags behind: only the buckets of its lines are rewritten
    late = spark.createDataFrame([("d", 3, i, TS + dt.timedelta(seconds=i * 7)) for i in range(20)], df.schema)
    third = merged.append_merged(late, out, seconds=hour)
    assert third == {"appended": [], "rewritten": [int(TS.replace(tzinfo=dt.UTC).timestamp()) // hour]}
    merged.append_merged(df, out, seconds=hour)
    assert merged.append_merged(df, out, seconds=hour) == {"appended": [], "rewritten": []}
    got = merged.read_merged(spark, out).orderBy("bucket", "merge_ts", "source_ord", "line_no")
    want = mg.merge_sources(df.unionByName(late))
    assert [tuple(r) for r in got.select("source", "line_no", "merge_ts").collect()] == [tuple(r) for r in want.select("source", "line_no", "merge_ts").collect()]


def test_merged_append_after_a_stop(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "merged")
    rows = [("a", 0, i, TS + dt.timedelta(seconds=i * 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "source string, source_ord int, line_no long, arrival_ts timestamp")
    merged.append_merged(df.filter("line_no < 100"), out)
    # lines of a batch that never ended
    df.filter("line_no between 100 and 130").withColumns({"merge_ts": F.col("arrival_ts"), "bucket": F.floor(F.unix_seconds("arrival_ts") / 3600), "batch": F.lit(1).cast("long")}).write.mode("append").partitionBy("bucket").parquet(f"{out}/lines")
    assert merged.read_merged(spark, out).count() == 100
    merged.append_merged(df, out)
    assert merged.read_merged(spark, out).count() == 200 == merged.read_merged(spark, out).select("line_no").distinct().count()
    with pytest.raises(ValueError, match="no merged lines"):
        merged.read_merged(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("bound", [0, 10])
def test_small_tables_are_counted_then_told(spark, bound):
    lines = log_lines(spark, {"a": 300, "b": 20, "c": 5})
    small = lines.groupBy("source").agg(F.max("line_no").alias("top")).filter("source <> 'c'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = attach(lines, small, "left", bound=bound)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("BroadcastHashJoin" in plan) == (bound == 10) and ("__salt" in plan) == (bound == 0)
    assert {tuple(r) for r in joined.groupBy("source", "top").count().collect()} == {("a", 299, 300), ("b", 19, 20), ("c", None, 5)}
    assert sorted(joined.columns) == sorted([*lines.columns, "top"])


@pytest.fixture
def rocksdb(spark):
    generations.use_rocksdb(spark)
    yield
    spark.conf.unset(generations._PROVIDER)


def test_counts_start_anew_when_a_file_is_cut(spark, tmp_path, rocksdb):
    tail.register(spark)
    logs = tmp_path / "logs"
    logs.mkdir()

    def put(name, texts, mode="w"):
        with open(logs / name, mode) as f:
            f.writelines(f'{{"level":"{t}"}}\n' for t in texts)

    def run(build, sub, keys):
        stream = spark.readStream.format("log_tail").option("path", str(logs)).option("state", str(tmp_path / f"{sub}.state")).load()
        out = str(tmp_path / sub)
        q = build(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"{sub}.cp")).trigger(availableNow=True)
        q.foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).start().awaitTermination()
        return spark.read.parquet(out)

    def both():
        a = run(lambda s: generations.generation_count_by(s, ["level"]), "counts", ["level"])
        b = run(generations.generation_severity, "severities", ["severity"])
        return {r["level"]: r["count"] for r in generations.newest_counts(a, ["level"]).collect()}, {r["source"]: (r["n_error"], r["n_info"], r["n_warn"]) for r in generations.severity_table(b).collect()}

    put("x.log", ["error"] * 5 + ["info"] * 4)
    put("y.log", ["info"] * 3)
    assert both() == ({"error": 5, "info": 7}, {"x": (5, 4, 0), "y": (0, 3, 0)})
    put("x.log", ["info"], "a")
    assert both() == ({"error": 5, "info": 8}, {"x": (5, 5, 0), "y": (0, 3, 0)})
    put("x.log", ["warn"] * 2)  # cut off and begun anew
    put("y.log", ["error"], "a")
    assert both() == ({"error": 1, "info": 3, "warn": 2}, {"x": (0, 0, 2), "y": (1, 3, 0)})
    put("x.log", ["error"], "a")
    assert both() == ({"error": 2, "info": 3, "warn": 2}, {"x": (1, 0, 2), "y": (1, 3, 0)})


def test_newest_lines_of_a_stream(spark, tmp_path, rocksdb):
    rows = log_lines(spark, {"a": 30, "b": 10}).withColumn("generation", F.when(F.col("source") == "a", F.floor(F.col("line_no") / 10)).otherwise(0).cast("int"))
    for i in range(3):
        rows.filter(F.floor(F.col("line_no") / 10) == i).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "p*"))
    q = live.latest_generation(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(rows.schema).parquet(str(tmp_path / "out"))
    want = live.latest_generation(rows)
    assert got.filter("source = 'b'").count() == 10 and got.filter("generation = 2").count() == 10
    assert want.exceptAll(got).isEmpty()
    spark.conf.unset(generations._PROVIDER)
    with pytest.raises(ValueError, match="use_rocksdb"):
        live.latest_generation(stream)


def test_lines_are_numbered_in_no_window_over_a_source(spark, data):
    from logframe.plans import stored

    rows = stored._numbered_within(spark, data)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    keys = [w.split(" ")[0:2] for w in plan.split("windowspecdefinition(")[1:]]
    assert keys and not any(k[0].startswith("source") and k[1].startswith("line_no") for k in keys)
    ends = rows.groupBy("source").agg({"*": "count", "line_no": "max"}).collect()
    assert ends and all(r["count(1)"] == r["max(line_no)"] + 1 for r in ends)

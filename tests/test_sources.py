"""Files, log tables, the tailing source and streams: what a stream gives is what a batch gives."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from logframe.functions import metadata as md
from logframe.operators import aggregate as ag
from logframe.sources import lines as sl
from logframe.sources import tail
from logframe.streaming import live


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b.log").write_bytes(b"".join(b"row %d\r\n" % i if i % 3 else b"row %d\n" % i for i in range(500)) + b"no end")
    (tmp_path / "a.log").write_bytes("é\rx\n\n\x01ctl\n".encode() + b"bad \xff byte\n")
    (tmp_path / "c.txt").write_text("ignored\n")
    return tmp_path


def test_read_log_dir(spark, folder):
    whole = sl.read_log_dir(spark, str(folder)).orderBy("source", "line_no").collect()
    assert [(r.source, r.line_no, r.content, r.byte_offset) for r in whole[:4]] == [("a", 0, "éx", 0), ("a", 1, "", 5), ("a", 2, "ctl", 6), ("a", 3, "bad � byte", 11)]
    b = [r for r in whole if r.source == "b"]
    assert [r.content for r in b] == [f"row {i}" for i in range(500)] + ["no end"]
    data = (folder / "b.log").read_bytes()
    assert all(data[r.byte_offset : r.byte_offset + r.byte_length].decode() == r.content for r in b)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = sl.read_log_dir(spark, str(folder)).orderBy("source", "line_no")
        assert split.rdd.getNumPartitions() >= 1 and split.collect() == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sources(spark, folder, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.log").write_text("g\n")
    found = sl.list_sources(spark, str(folder), str(other))
    assert [(r.name, r.location) for r in found.collect()] == [("a", "project"), ("b", "project"), ("a", "global")]
    assert sorted((r.name, r.location) for r in sl.resolve_sources(found).collect()) == [("a", "project"), ("b", "project")]
    stored = spark.createDataFrame([("a", 0)], "source string, line_no long")
    assert [r.name for r in sl.missing_metadata(found, stored).collect()] == ["b"]


def test_log_table(spark, folder, tmp_path):
    out = str(tmp_path / "table")
    rows = sl.read_log_dir(spark, str(folder))
    sl.build_log_table(rows.filter("line_no < 100"), out)
    sl.append_log_table(rows, out)
    sl.append_log_table(rows, out)
    back = spark.read.parquet(out)
    assert back.count() == rows.count() and back.select("source", "line_no").distinct().count() == rows.count()
    assert "flags" in back.columns
    sl.write_results(back.select("line_no", "content"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == back.count()


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_tail_follows_and_restarts(spark, tmp_path):
    tail.register(spark)
    logs, name = tmp_path / "logs", "tailed"
    logs.mkdir()
    f = logs / "x.log"
    f.write_bytes(b"one\ntwo\r\npart")
    stream = spark.readStream.format("log_tail").option("path", str(logs)).option("rangeBytes", "5").load()
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        with f.open("ab") as h:
            h.write(b"ial\nlast\n")
        (logs / "y.log").write_text("other\n")
        q.processAllAvailable()
        f.write_bytes(b"new\n")
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.table(name).select("source", "generation", "byte_offset", "content").collect()))
    assert got == [("x", 0, 0, "one"), ("x", 0, 4, "two"), ("x", 0, 9, "partial"), ("x", 0, 17, "last"), ("x", 1, 0, "new"), ("y", 0, 0, "other")]
    newest = live.latest_generation(spark.table(name))
    assert sorted(r.content for r in newest.collect()) == ["new", "other"]


def test_tail_goes_on_after_a_stop(spark, tmp_path):
    tail.register(spark)
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    f = logs / "x.log"
    f.write_bytes(b"".join(b"line %d\n" % i for i in range(10)))

    def run():
        stream = spark.readStream.format("log_tail").option("path", str(logs)).option("maxBytesPerBatch", "20").option("state", str(tmp_path / "state.json")).load()
        drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start())
        return sorted((r.generation, int(r.content.split()[1])) for r in spark.read.schema(stream.schema).parquet(out).collect())

    assert run() == [(0, i) for i in range(10)]
    with f.open("ab") as h:
        h.write(b"".join(b"line %d\n" % i for i in range(10, 14)))
    assert run() == [(0, i) for i in range(14)]
    f.write_bytes(b"line 99\n")
    assert run() == [(0, i) for i in range(14)] + [(1, 99)]


TEXTS = ['{"level":"error","s":"a"}', '{"level":"info","s":"b"}', "plain warn", '{"level":"error","s":"a"}', "", '{"s":"c"}']


def files(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(3):
        (d / f"f{i}.log").write_text("\n".join(TEXTS[i * 2 : i * 2 + 2]) + "\n")
    return str(d)


def test_streams_equal_batches(spark, tmp_path):
    d = files(tmp_path)
    batch = sl.read_log_dir(spark, d, offsets=False)
    stream = live.stream_log_dir(spark, d)
    spec = {"parser": "json", "filters": [{"field": "level", "op": "eq", "value": "error"}]}
    drain(live.live_filter(stream, spec).writeStream.format("memory").queryName("t_filter").start())
    assert sorted(r.content for r in spark.table("t_filter").collect()) == [TEXTS[0], TEXTS[3]]
    drain(live.live_count_by(stream, ["s"], top=2).writeStream.format("memory").queryName("t_count").outputMode("complete").start())
    assert [tuple(r) for r in spark.table("t_count").collect()] == [tuple(r) for r in ag.count_by(batch, ["s"], top=2).select("s", "count").collect()]
    drain(live.live_severity(stream).writeStream.format("memory").queryName("t_sev").outputMode("complete").start())
    want = ag.severity_counts(batch.withColumn("severity", md.severity(F.col("content"))))
    assert sorted(map(tuple, spark.table("t_sev").collect())) == sorted(map(tuple, want.collect()))


def test_capture_resumes(spark, tmp_path):
    d, out, cp = files(tmp_path), str(tmp_path / "out"), str(tmp_path / "cp")
    drain(live.capture(live.stream_log_dir(spark, d), out, cp))
    with open(os.path.join(d, "f9.log"), "w") as h:
        h.write("late error\n")
    drain(live.capture(live.stream_log_dir(spark, d), out, cp))
    back = spark.read.parquet(out)
    assert back.count() == 7 and back.filter("arrival_ts is null").count() == 0
    assert back.filter("severity = 'error'").count() == 3


def test_live_rate(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(milliseconds=100 * i)) for i in range(20)]
    spark.createDataFrame(rows, "source string, arrival_ts timestamp").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("source string, arrival_ts timestamp").parquet(str(tmp_path / "p"))
    drain(live.live_rate(stream).writeStream.format("memory").queryName("t_rate").outputMode("complete").start())
    full = spark.table("t_rate").filter("lines = 20").first()
    assert round(full.lines_per_second, 6) == round(20 / 1.9, 6)


def test_stream_lines(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "x.txt").write_text("a\r\nb\n")
    stream = spark.readStream.option("lineSep", "\n").text(str(tmp_path / "v"))
    drain(live.stream_lines(stream, "pipe").writeStream.format("memory").queryName("t_pipe").start())
    assert sorted(map(tuple, spark.table("t_pipe").collect())) == [("pipe", "a"), ("pipe", "b")]


def test_tail_notices_replaced_files(spark, tmp_path):
    logs, state = tmp_path / "logs", str(tmp_path / "state")
    logs.mkdir()
    f = logs / "x.log"

    def step(reader, start):
        end = reader.latestOffset()
        rows = [(g, at, text) for p in reader.partitions(start, end) for _, g, at, _, text in reader.read(p)]
        reader.commit(end)
        return rows, end

    reader = tail.TailReader({"path": str(logs), "state": state})
    f.write_text("one\ntwo\n")
    rows, at = step(reader, reader.initialOffset())
    assert rows == [(0, 0, "one"), (0, 4, "two")]
    f.write_text("new1\nnew2\nnew3\n")  # cut off and grown past the old place between two looks
    rows, at = step(reader, at)
    assert rows == [(1, 0, "new1"), (1, 5, "new2"), (1, 10, "new3")]
    with f.open("a") as h:
        h.write("new4\n")
    rows, at = step(reader, at)
    assert rows == [(1, 15, "new4")]
    f.write_text("NEW1\nNEW2\nNEW3\nNEW4\n")  # the same size, other bytes
    again = tail.TailReader({"path": str(logs), "state": state})  # also by a reader that starts anew
    rows, at = step(again, at)
    assert [r[:2] for r in rows] == [(2, 0), (2, 5), (2, 10), (2, 15)]
    f.unlink()
    rows, at = step(again, at)
    assert rows == [] and "x.log" not in at["files"] and at["born"] == 3
    f.write_text("back\n")
    (logs / "y.log").write_text("other\n")
    rows, at = step(again, at)
    assert rows == [(3, 0, "back"), (3, 0, "other")]
    # offsets and states of two numbers a file are read, too
    old = {"files": '{"%s": [5, 3]}' % f}
    with f.open("a") as h:
        h.write("more\n")
    reader = tail.TailReader({"path": str(f)})
    reader.at = old
    assert step(reader, old)[0] == [(3, 5, "more")]

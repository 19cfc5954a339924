"""Queries over written tables and streams: text files, log tables, and streams run until their input ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logframe.functions import metadata as md
from logframe.operators.blocks import running
from logframe.plans import lines as ln
from logframe.plans.lines import SQL_MIXED, SQL_PARTS
from logframe.sources import indexed, merged, tail
from logframe.sources.lines import append_log_table, build_log_table, list_sources, read_lines, read_log_dir, write_results
from logframe.streaming import generations, live


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; removed when the session's JVM ends.

    Only a local master may leave that setting unset: then a temporary folder of this machine serves.
    """
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{(home or tempfile.gettempdir()).rstrip('/')}/logframe-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def log_files(spark: SparkSession, rows: DataFrame) -> str:
    """A new folder with one ``<source>.log`` for each source of ``rows``, its lines in order."""
    home = shared_folder(spark)
    ordered = rows.repartition("source").sortWithinPartitions("source", "line_no")
    ordered.select(F.col("source").alias("of"), "content").write.partitionBy("of").text(f"{home}/parts")
    paths, logs = spark._jvm.org.apache.hadoop.fs.Path, f"{home}/logs"
    files = paths(home).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(paths(logs))
    for folder in files.listStatus(paths(f"{home}/parts")):
        name = folder.getPath().getName()
        if name.startswith("of="):
            parts = [f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise ValueError(f"{len(parts)} files for {name[3:]}: unset spark.sql.files.maxRecordsPerFile")
            files.rename(parts[0], paths(f"{logs}/{name[3:]}.log"))
    return logs


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has given when its present input is used up, as a written table."""
    spark, home = stream.sparkSession, shared_folder(stream.sparkSession)
    out, write = f"{home}/out", "overwrite" if mode == "complete" else "append"
    kept = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/cp").trigger(availableNow=True)
    query = kept.foreachBatch(lambda batch, _: batch.write.mode(write).parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str, content: str) -> DataFrame:
    """The derived lines of :mod:`logframe.plans.lines` as a stream."""
    schema = ln.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return ln._shape(events, content)


def stream_filter(spark, sf_dir):
    spec = {"parser": "json", "filters": [{"field": "level", "op": "eq", "value": "error"}]}
    return drained(live.live_filter(event_stream(spark, sf_dir, ln._JSON), spec), "append").select("source", "line_no")


def stream_count_by(spark, sf_dir):
    return drained(live.live_count_by(event_stream(spark, sf_dir, ln._LOGFMT), ["level"], "logfmt"), "complete")


def stream_severity(spark, sf_dir):
    return drained(live.live_severity(event_stream(spark, sf_dir, ln._PLAIN)), "complete")


def stream_rate(spark, sf_dir):
    rates = drained(live.live_rate(event_stream(spark, sf_dir, ln._PLAIN), "2 hours", "1 hour"), "complete")
    return rates.select(F.col("window.start").alias("start"), "source", "lines", F.round("lines_per_second", 9).alias("lines_per_second"))


def log_table(spark, sf_dir):
    """A log table written in two steps; the second offers all lines again and adds the new ones only."""
    out, rows = shared_folder(spark), ln.mixed_lines(spark, sf_dir)
    build_log_table(rows.filter("line_no < 500"), out)
    append_log_table(rows, out)
    return spark.read.parquet(out).select(F.col("source").cast("string").alias("source"), "line_no", "severity", "is_json", "is_logfmt", "has_ansi")


def text_lines(spark, sf_dir):
    """Lines written as text files and read again: their number, bytes, and one number for each."""
    out = shared_folder(spark)
    ln.mixed_lines(spark, sf_dir).select(F.concat("content", F.lit("\r"))).write.text(out)
    back = read_lines(spark, out)
    by_file = back.groupBy("source").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.sum("byte_length").alias("bytes"), F.max(F.col("byte_offset") + F.col("byte_length")).alias("end"))
    gaps = F.sum((F.col("last") + 1 != F.col("n")).cast("int") + (F.col("end") != F.col("bytes") + 2 * F.col("n") - 2).cast("int"))
    return by_file.agg(F.sum("n").alias("lines"), F.sum("bytes").alias("bytes"), gaps.cast("long").alias("gaps"))


def log_dir(spark, sf_dir):
    lines = read_log_dir(spark, log_files(spark, ln.mixed_lines(spark, sf_dir)))
    return lines.select("source", "line_no", "content", "byte_offset", "byte_length")


def sources(spark, sf_dir):
    logs = log_files(spark, ln.mixed_lines(spark, sf_dir))
    return list_sources(spark, logs, logs).select("name", "size_bytes", "location")


def json_results(spark, sf_dir):
    """Rows written as JSON lines and read again."""
    out = shared_folder(spark)
    write_results(ln.mixed_lines(spark, sf_dir).select("source", "line_no", "content"), out)
    return spark.read.schema("source string, line_no long, content string").json(out)


def stream_values(spark, sf_dir):
    logs = log_files(spark, ln.mixed_lines(spark, sf_dir))
    return drained(live.stream_lines(spark.readStream.option("lineSep", "\n").text(logs), "pipe"), "append")


def stream_dir(spark, sf_dir):
    return drained(live.stream_log_dir(spark, log_files(spark, ln.mixed_lines(spark, sf_dir))), "append")


def stream_tail(spark, sf_dir):
    tail.register(spark)
    logs = log_files(spark, ln.mixed_lines(spark, sf_dir)).removeprefix("file:")
    stream = spark.readStream.format("log_tail").option("path", logs).option("rangeBytes", "100000").load()
    return drained(stream, "append").select("source", "generation", "byte_offset", "byte_length", "content")


def captured(spark, sf_dir):
    """Lines of a stream kept with their arrival time, in two runs of one capture."""
    home = shared_folder(spark)
    for _ in range(2):
        run = live.capture(event_stream(spark, sf_dir, ln._PLAIN).select("source", "content"), f"{home}/out", f"{home}/cp")
        run.processAllAvailable()
        run.stop()
    kept = spark.read.parquet(f"{home}/out")
    return kept.groupBy(F.col("source").cast("string").alias("source"), "severity").agg(F.count("*").alias("lines"), F.count("arrival_ts").alias("timed"))


def newest_generation(spark, sf_dir):
    """Of each source, only what was read after its file shrank: here once for svc0, twice for svc1, never for svc2."""
    rows = ln.mixed_lines(spark, sf_dir)
    shrank = F.when(F.col("source") == "svc0", F.col("line_no") >= 400).when(F.col("source") == "svc1", F.col("line_no") >= 300).otherwise(False).cast("int")
    again = F.when(F.col("source") == "svc1", F.col("line_no") >= 700).otherwise(False).cast("int")
    return live.latest_generation(rows.withColumn("generation", shrank + again)).select("source", "line_no", "generation")


def _numbered_within(spark, sf_dir):
    """Mixed lines numbered from 0 in each source: counted inside blocks of numbers, then over the blocks, so no task holds a source."""
    return running(ln.mixed_lines(spark, sf_dir), F.lit(1), "__before").withColumn("line_no", F.col("__before").cast("long")).drop("__before")


def _stored_log(spark, sf_dir):
    """A log stored by three appends, each of which offers all lines up to some number."""
    out, rows = shared_folder(spark), _numbered_within(spark, sf_dir)
    for n in (150, 333, None):
        indexed.append_log(rows if n is None else rows.filter(F.col("line_no") < n), out)
    return out


def stored_stats(spark, sf_dir):
    return indexed.stored_stats(spark, _stored_log(spark, sf_dir)).drop("columns").withColumn("lines_per_second", F.round("lines_per_second", 9))


def stored_checkpoints(spark, sf_dir):
    return indexed.stored_checkpoints(spark, _stored_log(spark, sf_dir)).select("source", "line_no", *indexed.COUNTS)


def captured_log(spark, sf_dir):
    """Lines of a stream stored in two runs of one capture: numbers without gaps, offsets that follow one another."""
    home = shared_folder(spark)
    for _ in range(2):
        run = indexed.capture_log(event_stream(spark, sf_dir, ln._PLAIN).select("source", "content"), f"{home}/log", f"{home}/cp")
        run.processAllAvailable()
        run.stop()
    kept = indexed.read_log(spark, f"{home}/log")
    ends = F.max(F.col("byte_offset") + F.col("byte_length") + 1)
    return kept.groupBy("source").agg(F.count("*").alias("lines"), F.count_distinct("line_no").alias("numbers"), F.max("line_no").alias("last"), F.sum(F.col("byte_length") + 1).alias("bytes"), ends.alias("end"))


def merged_table(spark, sf_dir):
    """A stored merged view that three appends made, each of which offers all lines up to some number."""
    out = shared_folder(spark)
    rows = ln.mixed_lines(spark, sf_dir).withColumns({"arrival_ts": F.when(F.col("line_no") % 5 != 0, F.col("arrival_ts")), "source_ord": F.substring("source", 4, 1).cast("int")})
    for n in (400, 900, None):
        merged.append_merged(rows if n is None else rows.filter(F.col("line_no") < n), out, seconds=86_400 * 4)
    return merged.read_merged(spark, out).select("source", "line_no", "merge_ts")


def _generations(spark, sf_dir):
    """Lines with the generation of :func:`newest_generation`, in four batches of a stream."""
    rows = ln.mixed_lines(spark, sf_dir)
    shrank = F.when(F.col("source") == "svc0", F.col("line_no") >= 400).when(F.col("source") == "svc1", F.col("line_no") >= 300).otherwise(False).cast("int")
    again = F.when(F.col("source") == "svc1", F.col("line_no") >= 700).otherwise(False).cast("int")
    home = shared_folder(spark)
    rows = rows.withColumn("generation", shrank + again)
    rows.repartitionByRange(4, "line_no").write.parquet(home)
    generations.use_rocksdb(spark)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(home)


def stream_generations(spark, sf_dir):
    """Running severity counts that start anew when a file shrank."""
    updates = drained(generations.generation_severity(_generations(spark, sf_dir)), "update")
    return generations.severity_table(updates)


def stream_generation_count_by(spark, sf_dir):
    """Running groups over all sources, each in its newest generation."""
    keyed = _generations(spark, sf_dir).withColumn("number", (F.col("line_no") % 4).cast("string"))
    return generations.newest_counts(drained(generations.running_counts(keyed, ["number"]), "update"), ["number"])


_LEVELS = ", ".join(f"count(*) FILTER (level = '{s}') AS n_{s}" for s in md.SEVERITIES)
_WITH = f"WITH {SQL_PARTS}"
_RANKED = f"{_WITH}, r AS (SELECT service AS source, row_number() OVER (PARTITION BY service ORDER BY line_no) - 1 AS line_no, arrival_ts, level, {SQL_MIXED} AS content FROM ev)"
_MERGED = "(SELECT service AS source, line_no, coalesce(last_value(CASE WHEN line_no % 5 <> 0 THEN arrival_ts END IGNORE NULLS) OVER (PARTITION BY service ORDER BY line_no), TIMESTAMP '1970-01-01') AS merge_ts FROM ev)"
_NEWEST = "(SELECT * FROM ev WHERE service = 'svc0' AND line_no >= 400 OR service = 'svc1' AND line_no >= 700 OR service = 'svc2')"
QUERIES = {
    "stream_filter": (stream_filter, f"{_WITH} SELECT service AS source, line_no FROM ev WHERE level = 'error'"),
    "stream_count_by": (stream_count_by, f"{_WITH} SELECT level, count(*) AS count FROM ev GROUP BY level"),
    "stream_severity": (stream_severity, f"{_WITH} SELECT service AS source, {_LEVELS} FROM ev GROUP BY service"),
    "stream_rate": (stream_rate, f"""{_WITH} SELECT start, source, count(*) AS lines,
        CASE WHEN epoch_us(max(arrival_ts)) - epoch_us(min(arrival_ts)) >= 500000 THEN round(count(*) / ((epoch_us(max(arrival_ts)) - epoch_us(min(arrival_ts))) / 1e6), 9) END AS lines_per_second
        FROM (SELECT service AS source, arrival_ts, date_trunc('hour', arrival_ts) - INTERVAL (h) HOUR AS start FROM ev, (VALUES (0), (1)) v(h)) GROUP BY start, source"""),
    "log_table": (log_table, f"""{_WITH} SELECT service AS source, line_no, level AS severity, line_no % 4 = 0 AS is_json, line_no % 4 = 1 AS is_logfmt, line_no % 4 = 3 AS has_ansi FROM ev"""),
    "text_lines": (text_lines, f"""{_WITH}, l AS (SELECT {SQL_MIXED} AS content FROM ev) SELECT count(*) AS lines, sum(octet_length(encode(content)))::BIGINT AS bytes, 0::BIGINT AS gaps FROM l"""),
    "log_dir": (log_dir, f"""{_WITH}, l AS (SELECT service AS source, line_no AS pos, {SQL_MIXED} AS content FROM ev), o AS (SELECT *, octet_length(encode(content)) AS n FROM l)
        SELECT source, (row_number() OVER w - 1)::BIGINT AS line_no, content, coalesce(sum(n + 1) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset, n::INTEGER AS byte_length
        FROM o WINDOW w AS (PARTITION BY source ORDER BY pos)"""),
    "list_sources": (sources, f"""{_WITH}, l AS (SELECT service AS name, {SQL_MIXED} AS content FROM ev), s AS (SELECT name, sum(octet_length(encode(content)) + 1)::BIGINT AS size_bytes FROM l GROUP BY name)
        SELECT name, size_bytes, location FROM s, (VALUES ('project'), ('global')) v(location)"""),
    "json_results": (json_results, f"{_WITH} SELECT service AS source, line_no, {SQL_MIXED} AS content FROM ev"),
    "stream_lines": (stream_values, f"{_WITH} SELECT 'pipe' AS source, {SQL_MIXED} AS content FROM ev"),
    "stream_log_dir": (stream_dir, f"{_WITH} SELECT service AS source, {SQL_MIXED} AS content FROM ev"),
    "log_tail": (stream_tail, f"""{_WITH}, l AS (SELECT service AS source, line_no AS pos, {SQL_MIXED} AS content FROM ev), o AS (SELECT *, octet_length(encode(content)) AS n FROM l)
        SELECT source, 0 AS generation, coalesce(sum(n + 1) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset, n::INTEGER AS byte_length, content FROM o"""),
    "capture": (captured, f"{_WITH} SELECT service AS source, level AS severity, count(*) AS lines, count(*) AS timed FROM ev GROUP BY ALL"),
    "stored_stats": (stored_stats, f"""{_RANKED}, p AS (SELECT source, line_no, arrival_ts, max(line_no) OVER (PARTITION BY source) AS last FROM r)
        SELECT source, count(*) AS lines, sum(octet_length(encode(content)) + 1)::BIGINT AS bytes, {_LEVELS}, arg_min(arrival_ts, line_no) AS start_ts, arg_max(arrival_ts, line_no) AS end_ts,
        (SELECT round(max(line_no - prev) / nullif(max(epoch_us(arrival_ts) - epoch_us(prev_ts)), 0) * 1e6, 9) FROM (SELECT a.line_no, a.arrival_ts, b.line_no AS prev, b.arrival_ts AS prev_ts FROM p a JOIN p b ON a.source = b.source
            WHERE a.source = r.source AND a.line_no = a.last AND b.line_no = a.last // 100 * 100 - 1)) AS lines_per_second FROM r GROUP BY source"""),
    "stored_checkpoints": (stored_checkpoints, f"""{_RANKED}, c AS (SELECT source, line_no, max(line_no) OVER (PARTITION BY source) AS last, {", ".join(f"count(*) FILTER (level = '{s}') OVER w AS n_{s}" for s in md.SEVERITIES)}
        FROM r WINDOW w AS (PARTITION BY source ORDER BY line_no ROWS UNBOUNDED PRECEDING))
        SELECT source, line_no, {", ".join(f"n_{s}" for s in md.SEVERITIES)} FROM c WHERE line_no % 100 = 99 OR line_no = last"""),
    "capture_log": (captured_log, f"""{_WITH}, l AS (SELECT service AS source, octet_length(encode(strftime(arrival_ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(level) || ' ' || service || ' ' || event_type || ' user ' || user_id)) + 1 AS n FROM ev)
        SELECT source, count(*) AS lines, count(*) AS numbers, count(*) - 1 AS last, sum(n)::BIGINT AS bytes, sum(n)::BIGINT AS end FROM l GROUP BY source"""),
    "merged_table": (merged_table, f"{_WITH} SELECT * FROM {_MERGED}"),
    "stream_generations": (stream_generations, f"{_WITH} SELECT service AS source, {_LEVELS} FROM {_NEWEST} GROUP BY service"),
    "stream_generation_count_by": (stream_generation_count_by, f"{_WITH} SELECT (line_no % 4)::VARCHAR AS number, count(*) AS count FROM {_NEWEST} GROUP BY ALL"),
    "latest_generation": (newest_generation, f"""{_WITH} SELECT service AS source, line_no, CASE service WHEN 'svc0' THEN 1 WHEN 'svc1' THEN 2 ELSE 0 END AS generation
        FROM ev WHERE service = 'svc0' AND line_no >= 400 OR service = 'svc1' AND line_no >= 700 OR service = 'svc2'"""),
}

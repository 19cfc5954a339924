"""Log lines derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: severity of each event type
LEVEL_OF = {"error": "error", "purchase": "warn", "view": "info", "click": "debug", "signup": "trace"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(events: DataFrame) -> DataFrame:
    level = F.create_map(*[F.lit(x) for p in LEVEL_OF.items() for x in p])[F.col("event_type")]
    return events.withColumns({
        "n": F.col("event_id").cast("string"), "level": level, "service": F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string")),
        "k": F.get_json_object("props", "$.k"), "u": F.col("user_id").cast("string"),
    })


_JSON = """concat('{"level":"', level, '","service":"', service, '","user":{"id":', u, '},"k":', k, ',"event":"', event_type, '"}')"""
_LOGFMT = """concat('level=', level, ' service=', service, ' user=', u, ' k=', k, ' event="', event_type, '"')"""
_STAMP = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
_PLAIN = f"concat({_STAMP}, ' ', upper(level), ' ', service, ' ', event_type, ' user ', u)"
_COLOUR = f"concat({_STAMP}, ' ', char(27), '[31m', upper(level), char(27), '[0m ', service, ' ', event_type, ' user ', u)"


def _shape(events: DataFrame, content: str) -> DataFrame:
    rows = _parts(events)
    return rows.select(F.col("service").alias("source"), F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("arrival_ts"), F.expr(content).alias("content"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(table(spark, sf_dir, "events"), _JSON)


def logfmt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(table(spark, sf_dir, "events"), _LOGFMT)


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, logfmt, plain and coloured lines in turn."""
    return _shape(table(spark, sf_dir, "events"), f"CASE event_id % 4 WHEN 0 THEN {_JSON} WHEN 1 THEN {_LOGFMT} WHEN 2 THEN {_PLAIN} ELSE {_COLOUR} END")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed lines of one source, so that line numbers have no gaps."""
    return mixed_lines(spark, sf_dir).withColumn("source", F.lit("app"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents``: source is the document's id, line_no counts inside it."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "content"))


# the same lines in DuckDB SQL
SQL_PARTS = f"""ev AS (SELECT event_id AS line_no, ts::TIMESTAMP AS arrival_ts, event_type, user_id, 'svc' || (user_id % 3) AS service,
    json_extract_string(props, '$.k') AS k, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEVEL_OF.items())} END AS level FROM events)"""
SQL_JSON = """'{"level":"' || level || '","service":"' || service || '","user":{"id":' || user_id || '},"k":' || k || ',"event":"' || event_type || '"}'"""
SQL_LOGFMT = """'level=' || level || ' service=' || service || ' user=' || user_id || ' k=' || k || ' event="' || event_type || '"'"""
_SQL_STAMP = "strftime(arrival_ts, '%Y-%m-%d %H:%M:%S')"
SQL_MIXED = f"""CASE line_no % 4 WHEN 0 THEN {SQL_JSON} WHEN 1 THEN {SQL_LOGFMT}
    WHEN 2 THEN {_SQL_STAMP} || ' ' || upper(level) || ' ' || service || ' ' || event_type || ' user ' || user_id
    ELSE {_SQL_STAMP} || ' ' || chr(27) || '[31m' || upper(level) || chr(27) || '[0m ' || service || ' ' || event_type || ' user ' || user_id END"""

"""Checks of stored log tables against the files they came from, and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logframe.operators.blocks import BLOCK
from logframe.operators.small import attach


def structural_violations(table: DataFrame, sources: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(source, line_no, problem) of every line that breaks the table's structure.

    Offsets must rise by the length of the line before and its line break (1 or 2 bytes);
    line numbers must run without a gap; columns must be filled; and lines must lie
    inside the file where ``sources`` (name, size_bytes) is given. Neighbours are compared
    inside blocks; the first line of a block is compared with the last of the block before.
    The table is read and dealt once; after that a block is one row, with what is wrong in it.
    """
    rows = table.select("source", "line_no", "byte_offset", "byte_length", (F.col("byte_offset").isNull() | F.col("byte_length").isNull() | F.col("flags").isNull()).alias("empty"))
    if sources is not None:
        sizes = sources.select(F.col("name").alias("source"), F.col("size_bytes").alias("__size"))
        rows = attach(rows, sizes, "left").withColumn("outside", F.col("__size").isNull() | (F.col("byte_offset") + F.col("byte_length") > F.col("__size"))).drop("__size")
    else:
        rows = rows.withColumn("outside", F.lit(False))
    line = F.struct("line_no", "byte_offset", "byte_length", "empty", "outside")
    near = Window.partitionBy("source", "__block").orderBy("line_no")
    seen = rows.select("source", F.floor(F.col("line_no") / block).alias("__block"), line.alias("line")).select("source", "__block", F.col("line.line_no").alias("line_no"), "line")
    seen = seen.withColumn("before", F.lag("line").over(near))
    bad = F.when(F.col("before").isNotNull(), _problem(F.col("line"), F.col("before")))
    # a block tells its first and last line, and what is wrong inside it; a last line travels to the next block's first
    blocks = seen.groupBy("source", "__block").agg(
        F.min("line").alias("first"), F.max("line").alias("last"), F.collect_list(F.when(bad.isNotNull(), F.struct("line_no", bad.alias("problem")))).alias("bad")
    )
    none = F.lit(None).cast(blocks.schema["first"].dataType)
    found = lambda c: c.cast("array<struct<line_no:bigint,problem:string>>").alias("bad")
    parts = F.explode(F.array(
        F.struct(F.col("__block").alias("at"), F.col("first"), none.alias("before"), found(F.col("bad"))),
        F.struct((F.col("__block") + 1).alias("at"), none.alias("first"), F.col("last").alias("before"), found(F.array())),
    )).alias("part")
    met = blocks.select("source", parts).select("source", "part.*").groupBy("source", "at").agg(
        F.max("first").alias("first"), F.max("before").alias("before"), F.flatten(F.collect_list("bad")).alias("bad")
    )
    edge = _problem(F.col("first"), F.col("before"))
    all_ = F.when(F.col("first").isNotNull() & edge.isNotNull(), F.concat("bad", F.array(F.struct(F.col("first.line_no").alias("line_no"), edge.alias("problem"))))).otherwise(F.col("bad"))
    return met.select("source", F.explode(all_).alias("x")).select("source", "x.line_no", "x.problem")


def _problem(line: Column, before: Column) -> Column:
    """What is wrong with a line behind the one before it (null at a source's beginning); null if nothing."""
    gap = line["byte_offset"] - before["byte_offset"] - before["byte_length"]
    return (
        F.when(line["empty"], "missing column value")
        .when(before.isNull() & (line["line_no"] != 0), "line number gap").when(before.isNull() & (line["byte_offset"] != 0), "first offset is not 0")
        .when(line["line_no"] != before["line_no"] + 1, "line number gap")
        .when(line["byte_offset"] <= before["byte_offset"], "offset does not rise").when(~gap.isin(1, 2), "not at a line boundary")
        .when(line["outside"], "outside the file")
    )


def trusted_prefix(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(source, trusted_line, complete): the last stored checkpoint whose line, offset and fingerprint are the file's.

    ``stored`` holds checkpoints, ``current`` fingerprinted lines, both (source, line_no,
    byte_offset, fingerprint). trusted_line is null where none matches: reject the table.
    """
    right = current.select("source", "line_no", F.col("byte_offset").alias("o"), F.col("fingerprint").alias("f"))
    same = stored.join(right, ["source", "line_no"], "left").withColumn("same", F.coalesce((F.col("byte_offset") == F.col("o")) & (F.col("fingerprint") == F.col("f")), F.lit(False)))
    found = same.groupBy("source").agg(F.max(F.when(F.col("same"), F.col("line_no"))).alias("trusted_line"), F.max("line_no").alias("last"))
    return found.select("source", "trusted_line", F.coalesce(F.col("trusted_line") == F.col("last"), F.lit(False)).alias("complete"))


def shrunk_sources(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, stored_bytes, size_bytes) where the file is smaller than the table says, or gone."""
    ends = stored.groupBy("source").agg(F.max(F.col("byte_offset") + F.col("byte_length")).alias("stored_bytes"))
    now = sources.select(F.col("name").alias("source"), "size_bytes")
    return ends.join(now, "source", "left").filter(F.col("size_bytes").isNull() | (F.col("size_bytes") < F.col("stored_bytes")))


def repair(stored: DataFrame, current: DataFrame, trusted: DataFrame) -> DataFrame:
    """``stored`` cut to each source's trusted prefix, with the file's lines after it; the columns of ``stored``."""
    limit = trusted.select("source", F.coalesce("trusted_line", F.lit(-1)).alias("__keep"))
    kept = attach(stored, limit).filter(F.col("line_no") <= F.col("__keep")).select(*stored.columns)
    rest = attach(current, limit, "left").filter(F.col("__keep").isNull() | (F.col("line_no") > F.col("__keep")))
    return kept.unionByName(rest.select(*[c for c in stored.columns if c in current.columns]), allowMissingColumns=True)

"""Joins of lines with tables of one row a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a small table that are broadcast; more are joined by a shuffle of salted lines.
BROADCAST, SALTS = 100_000, 16


def attach(lines: DataFrame, small: DataFrame, how: str = "inner", on: str = "source", bound: int | None = None) -> DataFrame:
    """``lines`` joined with ``small``, which has one row a source.

    The sources are counted, which reads that one column, and broadcast if they are few. Else both sides are
    shuffled, and a source with many lines is spread over ``SALTS`` parts, each with a copy of its small row.
    """
    few = small.select(on).count() <= (BROADCAST if bound is None else bound)
    # the key gets a name of its own: the small table often comes from the lines themselves
    small = small.select(F.col(on).alias("__on"), *[F.col(f"`{c}`") for c in small.columns if c != on])
    same = F.col(on) == F.col("__on")
    if few:
        return lines.join(F.broadcast(small), same, how).drop("__on")
    spread = F.xxhash64(*[F.col(f"`{f.name}`") for f in lines.schema.fields if f.dataType.simpleString() in ("bigint", "int", "string")])
    copies = small.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("__salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    return salted.join(copies, same & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__on", "__copy")

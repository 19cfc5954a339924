"""Running values over long ordered tables in two passes: inside blocks, then over the blocks.

No window ever covers a whole source: rows are worked on inside (source, block), and the
short table of blocks is itself cut into groups of ``FAN`` blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, FAN = 100_000, 10_000


def sums_before(blocks: DataFrame, names: list[str], by: str = "source", block: str = "block") -> DataFrame:
    """``blocks`` with ``<name>_before``: the sum of ``name`` over the source's earlier blocks.

    ``blocks`` is read once: groups of up to ``FAN`` blocks travel as arrays with their sums, the sums run over the
    groups, and inside a group over its blocks.
    """
    row = F.struct(F.col(block).alias("__at"), *[F.col(c) for c in blocks.columns])
    groups = blocks.groupBy(by, F.floor(F.col(block) / FAN).alias("__group")).agg(F.collect_list(row).alias("__rows"), *[F.sum(n).alias(f"__{n}") for n in names])
    earlier = Window.partitionBy(by).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(by, "__group", "__rows", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in names])
    rows = groups.select("__group", *[f"__{n}" for n in names], F.explode("__rows").alias("__row")).select("__group", *[f"__{n}" for n in names], "__row.*")
    inside = Window.partitionBy(by, "__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{n}_before": F.col(f"__{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names}
    return rows.withColumns(before).select(*blocks.columns, *before)


def running(df: DataFrame, value: Column, name: str, by: str = "source", order: str = "line_no", inclusive: bool = False, size: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before this one in its source (with this one if ``inclusive``)."""
    cut = df.withColumns({"__block": F.floor(F.col(order) / size), "__value": value})
    starts = sums_before(cut.groupBy(by, F.col("__block").alias("block")).agg(F.sum("__value").alias("v")), ["v"], by)
    starts = starts.select(F.col(by).alias("__by"), F.col("block").alias("__at"), F.col("v_before").alias("__start"))
    inside = Window.partitionBy(by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    joined = local.join(starts, local[by].eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__at")))
    return joined.withColumn(name, F.col("__start") + F.col("__inside")).drop("__block", "__value", "__inside", "__by", "__at", "__start")


def last_known(df: DataFrame, value: str, name: str, by: str = "source", order: str = "line_no", size: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the last value that is not null up to this row in its source."""
    cut = df.withColumn("__block", F.floor(F.col(order) / size))
    ends = cut.groupBy(by, "__block").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("end"))
    earlier = lambda *key: Window.partitionBy(by, *key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = ends.groupBy(by, F.floor(F.col("__block") / FAN).alias("__group")).agg(F.collect_list(F.struct("__block", "end")).alias("__rows"), F.max("end").alias("top"))
    groups = groups.select(by, "__group", "__rows", F.max("top").over(earlier("__group")).alias("top"))
    rows = groups.select(by, "__group", "top", F.explode("__rows").alias("__row")).select(by, "__group", "top", "__row.*")
    carried = rows.withColumn("carry", F.max("end").over(earlier("__group", "__block")))
    carried = carried.select(F.col(by).alias("__by"), F.col("__block").alias("__at"), F.coalesce("carry", "top")["v"].alias("__carry"))
    inside = Window.partitionBy(by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__newest", F.last(value, ignorenulls=True).over(inside))
    joined = local.join(carried, local[by].eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__at")))
    return joined.withColumn(name, F.coalesce("__newest", "__carry")).drop("__block", "__newest", "__by", "__at", "__carry")

"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def shared_home(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master may leave it unset: then a temporary folder of this machine serves.
    """
    home = spark.conf.get("spark.checkpoint.dir", None)
    if home:
        return home.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="logframe-")


class Scratch:
    """A new folder in the shared one for the tables of one run; removed when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.home = spark, f"{shared_home(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.home)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` as a written table (in a folder for each value of ``by``), which is read instead of its plan from here on."""
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.home}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.home}/{name}")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_home(df.sparkSession))
        # its own folder in there, removed when the session's JVM ends
        path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.checkpoint()


#: Keys that are broadcast after they were counted; more are joined by a shuffle with ``SALTS`` copies of each.
BROADCAST_KEYS, SALTS = 400_000, 16


def free_name(taken: list[str], stem: str) -> str:
    """A column name that is not taken."""
    return next(n for i in count() if (n := f"__{stem}{i}") not in taken)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, xxhash64 of text) is in the stored table ``gone`` (doc_id, text_key), each once."""
    a, b, salt = (free_name(docs.columns, n) for n in ("id", "key", "salt"))
    keys = gone.select(F.col("doc_id").alias(a), F.col("text_key").alias(b))
    same = docs["doc_id"].eqNullSafe(F.col(a)) & (F.xxhash64(docs["text"]) == F.col(b))
    if keys.count() <= BROADCAST_KEYS:
        return docs.join(F.broadcast(keys), same, "left_anti")
    # copies under one id (or none) would meet in one task: rows are spread by chance, keys stand in every part
    spread = docs.withColumn(salt, F.floor(F.rand(7) * SALTS).cast("int"))
    keys = keys.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = spread["doc_id"].eqNullSafe(keys[a]) & (F.xxhash64(spread["text"]) == keys[b]) & (spread[salt] == keys["part"])
    return spread.join(keys, same, "left_anti").select(*[spread[f"`{c}`"] for c in docs.columns])


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; keeps nullable integers exact, unlike pandas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Hand freed memory back at the end of a task: its worker lives on, idle or in tasks of other stages."""
    pa.default_memory_pool().release_unused()
    # glibc keeps what Python has freed; other C libraries have no such call
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """``schema`` followed by the fields of a DDL string."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])

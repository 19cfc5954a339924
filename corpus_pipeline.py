"""A training-corpus pipeline of five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before kept.
All but the last return the columns of ``documents``; their decisions take effect:
toxic documents go, one document of each near-duplicate group stays, documents with
benchmark passages go, secrets are replaced inside texts, and the rest is encoded.
``run`` writes each stage as Parquet into the folder of ``spark.checkpoint.dir`` and reads it back; a stage's
table is removed when the next one stands, the last when the session's JVM ends.

A null or empty text is scored by the toxicity model's start weight, belongs to the group of texts without words
(one of which stays), holds no passage and no secret, and has no tokens. Null ids are ids like any other, but never
name a group that has another. Of rows repeated whole one stays; rows under one id with different texts stay apart.
An empty table passes through every stage. The stages return the columns of ``documents`` that they are given.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logframe.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from logframe.llm.common import shared_home, table

VOCABULARY = "word_bpe_49k.json"
#: Jaccard similarity of five-word shingles from which documents are near duplicates, besides op7's 4 bits.
SIMILARITY = 0.8
#: A forest, learned weights and the tokenizer's rules are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, similarity=SIMILARITY)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, *secret_scan.fit(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = f"{shared_home(spark)}/corpus-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path(home))
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if last:
            files.delete(path(f"{home}/{last}"), True)
        last = name
    return docs

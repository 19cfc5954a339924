"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logframe.llm import bpe, chat, decontaminate, media, pii, prefix_trie, ranked_search, secret_scan, sharding, simhash, token_counts, token_index, toxicity
from logframe.llm.common import table

SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"), tile=True)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secret_scan.scan(documents, *secret_scan.fit(documents))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_test_conversation(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(chat.text_parts(rows)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_head_trie(table(spark, sf_dir, "conversations"))


def op12_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_toxicity": op2_toxicity,
        "op3_decontamination": op3_decontamination,
        "op4_media": op4_media,
        "op5_bpe": op5_bpe,
        "op6_secrets": op6_secrets,
        "op7_simhash": op7_simhash,
        "op8_chat": op8_chat,
        "op9_token_counts": op9_token_counts,
        "op10_pii": op10_pii,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_token_index": op12_token_index,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.oracle(SHARDS),
        "op3_decontamination": decontaminate.oracle(),
        "op8_chat": chat.oracle(),
        "op11_prefix_trie": prefix_trie.oracle(),
        "op13_ranked_search": ranked_search.oracle(),
    }

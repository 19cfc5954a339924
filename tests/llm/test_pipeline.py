"""The pipeline stage by stage against brute force, and the registered queries against their SQL."""

import os

import duckdb
import public_tokenizers
import pytest

from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from logframe.llm import queries as lq
from logframe.llm import toxicity
from tests.llm.test_near_copies import shingles
from tests.llm.test_operators import slow_fingerprint, slow_groups, slow_windows


def smallest_of_groups(texts):
    """The smallest id of each group of texts linked by 4 bits or by a similarity of 0.8 over five-word shingles."""
    root = {i: c for i, _, c in slow_groups([(i, slow_fingerprint(t)) for i, t in texts.items()])}
    sets = {i: shingles(texts[i]) for i in set(root.values()) | set(root)}
    ids = sorted(sets)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if top(a) != top(b) and texts[a].split() and texts[b].split() and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {top(i) for i in ids}


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    kept = {}
    for name, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, data).cache()
        kept[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["toxicity"]) == {i for i, s in scores.items() if s < 0.5}
    assert set(kept["near_duplicates"]) == smallest_of_groups(kept["toxicity"])
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, *_, hit in slow_windows(kept["near_duplicates"].items(), items) if not hit}
    assert set(kept["decontamination"]) == clean
    assert set(kept["secrets"]) == clean
    changed = [i for i in clean if kept["secrets"][i] != kept["decontamination"][i]]
    assert all("[SECRET]" in kept["secrets"][i] for i in changed)
    lib = Tokenizer.from_file(public_tokenizers.path(cp.VOCABULARY))
    last = cp.STAGES[4][1](spark, docs, data).collect()
    assert len(last) == len(clean)
    assert all(r.ids == lib.encode(kept["secrets"][r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in last)
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, data).select("doc_id", "n_tokens").collect()) == sorted((r.doc_id, r.n_tokens) for r in last)


def test_stages_on_awkward_tables(spark, odd, empty, data, tmp_path):
    for df in (odd, empty):
        docs = df
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, data)
        assert docs.count() <= df.count()


@pytest.mark.parametrize("name", sorted(lq.queries()))
def test_query(spark, data, name):
    df = lq.queries()[name](spark, data)
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    assert len(got) > 0 and name in entry.queries()
    if sql := lq.oracle_sql().get(name):
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
        picked = ",".join(f'"{c}"' for c in sorted(df.columns))
        assert got == sorted(con.execute(f"SELECT {picked} FROM ({sql})").fetchall(), key=repr)


def test_contract_columns(spark, data):
    want = {
        "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op2_toxicity": "doc_id held_out score predicted",
        "op3_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op4_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op5_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7_simhash": "doc_id fingerprint component_id", "op8_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
    }
    long = {"doc_id", "size", "text_crc32", "slot", "n_words", "n_hit", "n_items", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "n_tokens", "component_id", "conv_id", "n_turns", "loss_chars", "formatted_chars"}
    for name, columns in want.items():
        df = lq.queries()[name](spark, data)
        assert set(columns.split()) <= set(df.columns), name
        assert all(t == "bigint" for c, t in df.dtypes if c in long), (name, df.dtypes)


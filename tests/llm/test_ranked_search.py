import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from logframe.llm import ranked_search
from logframe.llm.common import Scratch
from tests.llm.conftest import clashing

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_ranks(docs, items, top=50):
    """(item_id, rank, doc_id, score) by scoring everything."""
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = []
    for i, own in asked.items():
        scored = []
        for d, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def ranks(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_search_of_a_table(spark, data, documents):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    want = slow_ranks(pairs(documents, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert want and ranks(ranked_search.search(documents, items)) == want
    # few seeds, few items at once, a short list
    want = slow_ranks(pairs(documents, "doc_id", "text"), pairs(items, "item_id", "text"), 3)
    assert ranks(ranked_search.search(documents.repartition(5), items, top=3, seed=5, pairs=100)) == want


def test_search_of_odd_documents(spark, odd, empty):
    items = [(1, "Plain words, long-text?"), (2, None), (3, ""), (4, "ÜNÏ çödé 日本語 \U0001f600"), (None, "row"), (5, "in nothing"), (1, "another"), (6, "zzz"), (7, "word1 word2 " * 50_000)]
    df = spark.createDataFrame(items, ITEMS)
    want = slow_ranks(pairs(odd, "doc_id", "text"), items)
    assert len(want) > 10 and ranks(ranked_search.search(clashing(odd), clashing(df))) == want
    assert ranked_search.search(empty, df).count() == 0
    assert ranked_search.search(odd, df.limit(0)).count() == 0


def test_ties_go_to_the_smaller_id_across_tasks(spark):
    docs = [(i, "rare common") for i in range(400, 0, -1)] + [(i, "common") for i in range(1000, 1400)] + [(None, "rare common")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(1, "rare"), (2, "common")]
    assert ranks(ranked_search.search(df, spark.createDataFrame(items, ITEMS), seed=10)) == slow_ranks(docs, items)


def test_pruning_keeps_every_row_that_may_enter(spark):
    rng = np.random.default_rng(7)
    size = 300
    for _ in range(20):
        rows = []
        for d in range(2500):
            at = np.unique(rng.zipf(1.3, rng.integers(1, 40)) % size).astype(np.int32)
            rows.append((d, int(rng.integers(1, 500)), at.tobytes(), rng.integers(1, 9, len(at)).astype(np.int32).tobytes()))
        df = np.bincount(np.concatenate([np.frombuffer(r[2], dtype=np.int32) for r in rows]), minlength=size)
        weights = np.array([ranked_search.weight(2500, int(n)) for n in df], dtype=np.int64)
        v = ranked_search.Vectors.of(rows).weigh(weights, 2500, sum(r[1] for r in rows))
        queries = [ranked_search.Query(np.unique(rng.integers(0, size, 12)), weights, 1) for _ in range(5)]
        offered, scored = ranked_search.search_block(v, queries, weights, 10)
        assert scored < offered
        dense = np.zeros((2500, size), dtype=np.int64)
        dense[np.repeat(np.arange(2500), np.diff(v.begin)), v.at] = v.impact
        for q in queries:
            exact = dense[:, q.at] @ q.weight
            want = sorted(((int(s), -d) for d, s in enumerate(exact) if s > 0), reverse=True)[:10]
            assert sorted([(s, -d) for s, _, d in q.best], reverse=True) == want


def test_weights_of_terms_in_every_document():
    assert ranked_search.weight(10, 10) == math.floor(1000 * math.log(22 / 21)) and ranked_search.weight(10, 0) == math.floor(1000 * math.log(22))


@pytest.mark.parametrize("text", ["", "A-b_c'd.é", "x" * 100_000, "\x7f\x80 \x85 ", "İstanbul ǅ"])
def test_terms_are_those_of_the_pattern(text):
    assert [t.decode() for t in ranked_search.terms(text.encode())] == words(text)


def test_items_come_in_blocks(spark):
    df = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(i))) for i in range(10)], ITEMS)
    blocks = list(ranked_search.item_blocks(df, 12))
    assert [i for b in blocks for i, _ in b] == list(range(1, 10)) and len(blocks) > 2
    assert Scratch(spark, "x").home != Scratch(spark, "x").home

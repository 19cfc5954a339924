"""The near-duplicate stage on copies that differ by more bits than the op7 query links."""

import random

import numpy as np

import corpus_pipeline as cp
from logframe.llm import components, simhash
from tests.llm.conftest import SCHEMA


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_no_pair_of_similar_texts_is_kept(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(3):
            texts.append(" ".join(word() if i % 60 == 7 else w for i, w in enumerate(base)))  # 10 of 116 shingles change
    df = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], SCHEMA)
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    bits = [(simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])) & (2**64 - 1) for a, b in pairs]
    assert sum(x.bit_count() > simhash.DISTANCE for x in bits) > len(pairs) // 2  # the 4-bit rule alone leaves most of them
    kept = {r.doc_id for r in cp.without_near_duplicates(spark, df, "").collect()}
    assert kept == {i for i in range(len(texts)) if i % 4 == 0} and not [p for p in pairs if kept >= set(p)]


def brute(texts, similarity=0.8):
    """Classes of texts (lists of indices) by chains of similar pairs."""
    sets, left, out = [shingles(t) for t in texts], set(range(len(texts))), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
            left -= near
            todo += near
        out.append(frozenset(group))
    return set(out)


def classes(spark, given, **more):
    """The same by the links, with cut clusters."""
    df = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(given)], SCHEMA)
    rows = simhash.fingerprints(df, banded=True)
    similar = simhash.Similar(df, rows, 0.8, **more)
    first = similar.links()
    found = components.connected(first)
    rest = similar.rest(found)
    n_first, n_rest = first.count(), rest.count() if rest is not None else 0
    if n_rest:
        found = components.connected(first.union(rest))
    roots = {r.node: r.root for r in found.collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(roots.get(r.fp, r.fp), set()).add(r.doc_id)
    return set(map(frozenset, groups.values())), n_first, n_rest


def test_clusters_in_parts(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 200, 5)]
    assert classes(spark, texts * 2, texts=7)[0] == brute(texts * 2) == {frozenset(range(80))}
    assert classes(spark, texts, size=1500)[0] == {frozenset(range(40))}


def test_what_parts_leave_is_compared(spark):
    # a chain: each text is like its neighbours only, so parts of three leave most of its links to the rest
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[10 * i : 10 * i + 120]) for i in range(24)]
    other = [" ".join(f"o{i}" for i in range(60)), " ".join(words[:60])]
    want = brute([*chain, *other])
    got, first, rest = classes(spark, [*chain, *other], texts=3)
    assert got == want and rest > 0 and max(map(len, want)) == 24
    assert classes(spark, [*chain, *other])[0] == want


def test_similarity_is_exact():
    sets = [np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64), np.arange(12, 112, dtype=np.uint64)]
    assert simhash._spanning([sets[0], sets[1]], 0.8) == [(0, 1)]  # 90 of 110
    assert simhash._spanning([sets[0], sets[2]], 0.8) == []  # 88 of 112
    assert simhash._spanning([sets[0], sets[2], sets[1]], 0.8) == [(0, 2), (2, 1)]
    assert simhash._bridges([sets[0], sets[1], sets[2]], [1, 2, 2], [1, 0, 0], 0.8) == [(0, 1)]

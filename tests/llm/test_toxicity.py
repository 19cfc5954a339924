"""The clause grammar against a naive reading of its rules, and what it learns against held-out labels."""

import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logframe.llm import toxicity as tx
from logframe.llm.transducers import ANY, Transducer, compose
from tests.llm.conftest import clashing

PARTS = [tx.target(), tx.modifier(tx.NEGATION, tx.NEGATED, tx.AIMED), tx.modifier(tx.REPORT, tx.REPORTED, tx.AIMED + tx.NEGATED)]
WEIGHTS = dict(zip(tx.PATTERNS, (1.0, 2.0, 0.25, 0.5, 4.0), strict=True))


def test_composition_is_one_after_the_other():
    machines = [*PARTS, tx.writer(tx.INSULT, WEIGHTS), tx.writer(tx.THREAT, WEIGHTS)]
    whole, rng = tx.grammar(WEIGHTS), random.Random(4)
    assert len({s for s, _ in whole.arcs}) <= 2 * (tx.REACH + 1) ** 2
    for _ in range(2000):
        given = [rng.choice([*tx.SYMBOLS, tx.INSULT + tx.AIMED, tx.THREAT + tx.AIMED]) for _ in range(rng.randint(0, 14))]
        symbols, total = given, 0.0
        for m in machines:
            symbols, weight = m.run(symbols)
            total += weight
        assert whole.run(given) == (symbols, total)


def test_transducers():
    flip = Transducer(0, {(0, "a"): (1, "b", 1.0), (1, ANY): (0, ANY, 0.5)})
    assert flip.run("aab") == (["b", "a", "b"], 1.5)
    twice = compose(flip, flip, "abc")
    assert twice.run("aac") == (flip.run(flip.run("aac")[0])[0], flip.run("aac")[1] + flip.run(flip.run("aac")[0])[1])


def naive(text, model):
    """(pattern, word) matches and number of words, by the rules as they are told."""
    stems, found, n = dict(model.stems), {}, 0
    for clause in re.split(r"[.!?;:|\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        n += len(words)
        if not words:
            continue
        threat = [any(w == t + e for t in tx.THREATS for e in tx.ENDINGS) for w in words]
        plain = [not t and w not in tx.TARGETS | tx.NEGATIONS | tx.REPORTS for w, t in zip(words, threat)]
        stem = [max((w[:k] for k in range(1, len(w) + 1) if w[:k] in stems), key=len, default=None) if p else None for w, p in zip(words, plain)]
        aimed = any(w in tx.TARGETS and not t for w, t in zip(words, threat))
        for i, w in enumerate(words):
            before = [x for x, t in zip(words[max(0, i - tx.REACH) : i], threat[max(0, i - tx.REACH) : i]) if not t]
            negated, reported = any(x in tx.NEGATIONS for x in before), any(x in tx.REPORTS - tx.NEGATIONS - tx.TARGETS for x in before)
            if stem[i]:
                pattern = "negated" if negated else "reported" if reported else "aimed" if aimed else "plain"
                found[w, pattern] = stems[stem[i]]
            elif threat[i] and aimed and not negated and not reported:
                found[w, "menace"] = 0.0
    return found, n


def naive_score(text, model):
    found, n = naive(text, model)
    w = dict(zip(("start", *tx.PATTERNS, "stem", "words"), model.weights, strict=True))
    total = w["start"] + sum(w[p] + w["stem"] * v for (_, p), v in found.items()) + w["words"] * math.log2(1 + n)
    return 1 / (1 + math.exp(-total))


def test_clauses():
    g = tx.ClauseGrammar(tx.Model((("vequ", 2.0), *((s, 4.0) for s in sorted(tx.INSULTS))), tuple(tx.PRIOR)))
    cases = {
        "the idiot.": ["plain"], "you are an idiot": ["aimed"], "idiot, that is you": ["aimed"], "you are not an idiot": ["negated"], "they said idiot": ["reported"], "I will hurt you": ["menace"], "I am killing you": ["menace"],
        "I will not hurt you": [], "hurting is bad": [], "they said nothing and I will kill you": ["menace"], "he said I will kill you": [], "word vequor. clean clause\nvequx": ["plain", "plain"], "idiots": ["plain"], "idi": [], "": [],
        "scum! " * 9: ["plain"], "stupid$$$ word%%%": ["plain"], "not here. idiot": ["plain"], "she claimed this and that idiot": ["reported"],
    }
    assert {t: [p for _, p in g.matches(t)[0]] for t in cases} == cases
    assert g.matches(None) == ({}, 0) and g.features("the idiot") == [1.0, 0, 0, 0, 0, 4.0, round(math.log2(3), 6)]
    assert 0 <= g.score(None) < 0.5 < g.score("you idiot, you moron, I will kill you") <= 1


def test_scores_by_a_naive_interpreter(documents, spark, data):
    model = tx.fit(documents, spark.read.parquet(f"{data}/labels.parquet"))
    rng = random.Random(9)
    words = [*sorted(tx.INSULTS)[:4], "kill", "hurting", "you", "they", "not", "nie", "said", "dit", "tree", "blue", "."]
    made = [(10**6 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    both = documents.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in both.collect()}
    for r in tx.score(both, model).collect():
        assert abs(r.score - naive_score(texts[r.doc_id], model)) < 1e-6, texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)


def test_fit(spark, documents, odd, empty, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = tx.fit(documents, labels)
    flipped = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tx.fit(documents, flipped) == model  # held-out labels are never read
    for df in (odd, clashing(odd)):
        assert tx.score(df, model).count() == odd.count()
        assert tx.keep_clean(df, model).columns == df.columns
    assert tx.score(empty, model).collect() == [] and tx.keep_clean(empty, model).collect() == []
    assert tx.fit(documents, labels.limit(0)).weights == tuple(tx.PRIOR)
    assert tx.fit(empty, labels).weights == tuple(tx.PRIOR)
    doubled = documents.union(documents.withColumn("text", F.concat("text", F.lit(" z"))))
    assert tx.fit(doubled, labels).stems


def test_stems(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(600):
        words = [word() for _ in range(30)]
        if i % 6 == 0:
            words[rng.randrange(30)] = "zorq" + word()
            words[rng.randrange(30)] = "zorq" + word()
        if i % 50 == 1:
            words[3] = "zorq" + word()
        rows.append((int(i % 6 == 0), " ".join(words)))
    stems, toxic, clean = tx.learn_stems(spark.createDataFrame(rows, "label int, text string"))
    learned = {s: w for s, w in stems if s not in tx.INSULTS}
    assert (toxic, clean) == (100, 500) and list(learned) in (["zor"], ["zorq"]) and 2 < min(learned.values()) < 5


def test_held_out_documents(spark):
    sf = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), "sf0.1")
    if not os.path.isdir(sf):
        pytest.skip("no larger tables")
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = tx.score(documents, tx.fit(documents, labels)).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hits = sum(r.toxic and r.predicted for r in got)
    assert hits >= 0.9 * sum(r.toxic for r in got) and hits >= 0.95 * sum(r.predicted for r in got)

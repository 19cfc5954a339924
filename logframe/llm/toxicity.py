"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps each word of a clause to a symbol: insult (stems learned from
labels, each with its weight, besides a public list), threat (verb stems with their
inflections), target, negation, report, other. Five transducers over these symbols are
composed into one (``logframe.llm.transducers``):

* target: an insult or threat in a clause with a target is aimed. It reads the clause from
  the right first, then from the left, so a target on either side counts;
* negation and report: what follows one within ``REACH`` words is negated or reported;
* insult: writes the pattern negated, reported, aimed or plain;
* threat: writes the pattern menace for an aimed threat that is neither negated nor reported.

So a word counts only through the clause that holds it. The weight of a text is the sum of
the arcs of its matches, that is of the patterns' and the stems' weights, over its distinct
(word, pattern) pairs: repeating a match adds nothing. To it come a start weight and one
for the logarithm of the number of words; the logistic function gives the score. All these
weights are fitted to labels by a ridge logistic regression.

Learning uses labelled rows only where crc32(doc_id as text) mod 5 is not 0, and of these
at most ``LABELLED`` documents, those with the smallest hash. Whole texts are scored. Null
and empty texts have no clauses and get the start weight's score. Conflicting labels of one
document count as their maximum; of several texts under one id each is learned from (at most
``LABELLED`` texts in all, those with the smallest hash). Without
any label (or with one class only) the built-in weights stand. Repeated rows get equal scores;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import durable, release, with_fields
from logframe.llm.transducers import ANY, Transducer, compose

#: Bound on the labelled documents that the weights and stems are learned from.
LABELLED = 20_000
#: Characters of a stem.
SHORTEST, LONGEST = 3, 16
#: A stem is learned from at least so many toxic documents, and where chance would give
#: fewer than CHANCE such stems among all.
LEAST_DOCUMENTS, CHANCE = 4, 1e-2
HOLD_OUT = 5
#: Stems that a task holds before it hands them on, and stems of toxic documents that are broadcast.
FLUSH, BROADCAST_STEMS = 50_000, 500_000

# fixed values: public lists of function words, threats with their endings, and plain insults
TARGETS = frozenset("you your yours yourself he him his she her they them their we us everyone somebody du dich dir ihr euch tu te toi vous tú usted vosotros".split())
NEGATIONS = frozenset("not no never isn aren wasn don doesn didn nicht kein keine nie pas jamais ne nunca jamás".split())
REPORTS = frozenset("said says say quoted quote claimed wrote called reported sagte dit dijo".split())
THREATS = frozenset("kill hurt destroy beat burn shoot stab strangl murder töt umbring tuer mat".split())
ENDINGS = frozenset(" s e d es ed en er ing t st te ten et ai ons ez é ée ar aré ará o".split(" "))
INSULTS = frozenset(
    "idiot moron imbecile cretin dunce scum loser coward liar bastard lowlife subhuman stupid worthless pathetic disgusting trash garbage filth clown"
    " trottel versager dummkopf imbécile crétin débile imbécil estúpido basura".split()
)
# end of fixed values

LONGEST_THREAT = max(map(len, THREATS)) + max(map(len, ENDINGS))
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "other", "insult", "threat", "target", "negation", "report"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)
#: Marks that the transducers put behind a symbol.
AIMED, NEGATED, REPORTED = ">", "-", "\""
PATTERNS = ("plain", "aimed", "negated", "reported", "menace")
#: Weight of a public insult that labels say nothing of, and prior weights in log odds:
#: start, each pattern, stems (a factor), logarithm of the number of words.
PUBLIC = 4.0
PRIOR = np.array([-3.0, 0.5, 1.0, -1.5, -1.5, 2.5, 0.8, 0.0])
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:|\n]+")
#: How many words a negation or a report reaches.
REACH = 4


def _marked(marks: str) -> list[str]:
    """Insult and threat with every subset of ``marks``, in this order of the marks."""
    out = [INSULT, THREAT]
    for mark in marks:
        out += [s + mark for s in out]
    return out


def target() -> Transducer:
    """Marks insults and threats behind a target, in reading order."""
    aim = {(1, s): (1, s if s.endswith(AIMED) else s + AIMED, 0.0) for s in _marked(AIMED)}
    return Transducer(0, {(0, TARGET): (1, ANY, 0.0), **aim})


def modifier(word: str, mark: str, before: str) -> Transducer:
    """Marks insults and threats at most ``REACH`` words behind ``word``; the state is how many it still reaches."""
    arcs = {(n, word): (REACH, ANY, 0.0) for n in range(REACH + 1)}
    for n in range(1, REACH + 1):
        arcs[n, ANY] = (n - 1, ANY, 0.0)
        arcs |= {(n, s): (n - 1, s + mark, 0.0) for s in _marked(before)}
    return Transducer(0, arcs)


def pattern_of(symbol: str) -> str | None:
    """The pattern of a marked symbol; None for what is no match."""
    if symbol.startswith(INSULT):
        return "negated" if NEGATED in symbol else "reported" if REPORTED in symbol else "aimed" if AIMED in symbol else "plain"
    return "menace" if symbol == THREAT + AIMED else None


def writer(kind: str, weights: dict[str, float]) -> Transducer:
    """Writes the patterns of a kind, with their weights."""
    marked = [s for s in _marked(AIMED + NEGATED + REPORTED) if s.startswith(kind) and pattern_of(s)]
    return Transducer(0, {(0, s): (0, pattern_of(s), weights[pattern_of(s)]) for s in marked})


def grammar(weights: dict[str, float]) -> Transducer:
    """The composed transducer; it reads a clause whose insults and threats are marked from the right."""
    made, alphabet = target(), [*SYMBOLS, INSULT + AIMED, THREAT + AIMED]
    for part in (modifier(NEGATION, NEGATED, AIMED), modifier(REPORT, REPORTED, AIMED + NEGATED), writer(INSULT, weights), writer(THREAT, weights)):
        made = compose(made, part, alphabet)
    return made


@dataclass(frozen=True)
class Model:
    """Stems with their weights, and the fitted weights in the order of PRIOR."""

    stems: tuple[tuple[str, float], ...]
    weights: tuple[float, ...]


class ClauseGrammar:
    """The lexical transducer and the composed grammar of one model."""

    def __init__(self, model: Model):
        self.stems, self.weights = dict(model.stems), model.weights
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.heads = frozenset(s[:SHORTEST] for s in [*self.stems, *THREATS])
        self.machine = grammar(dict(zip(PATTERNS, model.weights[1 : 1 + len(PATTERNS)], strict=True)))
        self.from_right = target()

    def symbol(self, word: str) -> tuple[str, float]:
        """The word's symbol and weight."""
        if len(word) <= LONGEST_THREAT and any(word[:n] in THREATS and word[n:] in ENDINGS for n in range(SHORTEST, len(word) + 1)):
            return THREAT, 0.0
        for known, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            if word in known:
                return symbol, 0.0
        if word[:SHORTEST] in self.heads:
            for n in self.lengths:
                if (weight := self.stems.get(word[:n])) is not None:
                    return INSULT, weight
        return OTHER, 0.0

    def clause(self, words: list[str]) -> list[tuple[str, str, float, float]]:
        """(word, pattern, weight of the pattern's arcs, weight of the stem's) of each match."""
        read = [self.symbol(w) for w in words]
        if not any(s in (INSULT, THREAT) for s, _ in read):
            return []
        symbols, _ = self.from_right.run(s for s, _ in reversed(read))
        state, out = self.machine.start, []
        for word, symbol, (_, weight) in zip(words, reversed(symbols), read, strict=True):
            state, written, arc = self.machine.step(state, symbol)
            if written in PATTERNS:
                out.append((word, written, arc, weight))
        return out

    def matches(self, text: str | None) -> tuple[dict[tuple[str, str], tuple[float, float]], int]:
        """Distinct (word, pattern) matches with their weights, and the number of words, of a whole text."""
        found, heads, lowered, n = {}, self.heads, (text or "").lower(), 0
        for clause in CLAUSE_END.split(lowered):
            words = WORD.findall(clause)
            n += len(words)
            if any(w[:SHORTEST] in heads for w in words):
                for word, pattern, arc, weight in self.clause(words):
                    found[word, pattern] = arc, weight
        return found, n

    def features(self, text: str | None) -> list[float]:
        """Distinct matches by pattern, the sum of their stems' weights, and log2(1 + words)."""
        found, n = self.matches(text)
        counts = [float(sum(p == q for _, q in found)) for p in PATTERNS]
        return [*counts, round(sum(w for _, w in found.values()), 6), round(math.log2(1 + n), 6)]

    def score(self, text: str | None) -> float:
        """From 0 to 1: the logistic function of the path's weight."""
        found, n = self.matches(text)
        start, stem, length = self.weights[0], *self.weights[-2:]
        total = start + length * round(math.log2(1 + n), 6) + sum(arc + stem * w for arc, w in found.values())
        return round(1 / (1 + math.exp(-max(-500.0, min(500.0, total)))), 9)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(label, text) of the training rows: at most ``bound`` labelled documents outside the hold-out, and as many texts.

    Rows that repeat an id with its text are one; of an id's several texts each is a row. Both bounds take the smallest hashes.
    """
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(bound)
    )
    # at most ``bound`` rows of two numbers; copies under one id are merged before the shuffle
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    texts = durable(found.groupBy("doc_id", F.xxhash64("text").alias("k")).agg(F.first("label").alias("label"), F.first("text").alias("text")))
    if texts.count() <= bound:  # as a rule: no id has several texts
        return texts.select("label", "text")
    keys = texts.select("doc_id", "k").orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k").limit(bound)
    return texts.join(F.broadcast(keys), ["doc_id", "k"]).select("label", "text")


def _evidence(t: Column, c: Column, rate: float) -> Column:
    """How far a stem's share of toxic documents is above the rate of all, in nats of a binomial tail's bound."""
    n = t + c
    part = lambda k, r: F.when(k > 0, k * F.log(k / n / r)).otherwise(0.0)
    return F.when(t / n > rate, part(t, rate) + part(c, 1 - rate)).otherwise(0.0)


def learn_stems(rows: DataFrame) -> tuple[tuple[tuple[str, float], ...], int, int]:
    """Word beginnings that mark toxic documents with their log odds, and the numbers of toxic and clean rows.

    All that pass the test of significance are kept, the most telling of those that begin
    alike; the labelled documents bound their number.
    """
    totals = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    toxic, clean = int(totals[0]), int(totals[1] - totals[0])
    public = tuple((s, PUBLIC) for s in sorted(INSULTS))
    if not toxic or not clean:
        return public, toxic, clean

    def beginnings(batches):
        labels, stems, places = [], [], []

        def made():
            arrays = [pa.array(labels, pa.int32()), pa.array(stems, pa.string()), pa.array(places, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["label", "stem", "place"])

        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1), strict=True):
                words = ["", *WORD.findall((text.as_py() or "").lower()), ""]
                found: dict[str, int] = {}
                for i in range(1, len(words) - 1):
                    for n in range(SHORTEST, min(len(words[i]), LONGEST) + 1):
                        found.setdefault(words[i][:n], i)
                stems += found
                labels += [label.as_py()] * len(found)
                places += [xxhash.xxh64_intdigest(" ".join(words[i - 1 : i + 2])) >> 1 for i in found.values()]
                if len(stems) >= FLUSH:  # a few texts at a time stand in memory
                    yield made()
                    labels, stems, places = [], [], []
        yield made()
        labels, stems, places = [], [], []
        release()

    # copies of a document show a stem first in the same place, between the same words: they are one piece of evidence
    def places(label: int) -> DataFrame:
        return rows.filter(F.col("label") == label).select("label", "text").mapInArrow(beginnings, "label int, stem string, place long")

    spark, own = rows.sparkSession, sorted(INSULTS)
    t = places(1).distinct().groupBy("stem").agg(F.count("*").alias("t"))
    t = durable(t.filter((F.col("t") >= LEAST_DOCUMENTS) | F.col("stem").isin(*own)))
    listed = spark.createDataFrame([(s,) for s in own], "stem string").join(t, "stem", "left").select("stem", F.coalesce("t", F.lit(0)).alias("t"))
    known = t.filter(~F.col("stem").isin(*own)).union(listed)
    # of the clean documents only the stems that toxic ones have are shuffled
    stems = known.select("stem")
    c = places(0).join(F.broadcast(stems) if known.count() <= BROADCAST_STEMS else stems, "stem", "left_semi").distinct().groupBy("stem").agg(F.count("*").alias("c"))
    counts = durable(known.join(c, "stem", "left").select("stem", "t", F.coalesce("c", F.lit(0)).alias("c")).filter("t + c > 0"))
    rate, tests = toxic / (toxic + clean), max(1, counts.count())
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    told = counts.withColumns({"evidence": _evidence(F.col("t"), F.col("c"), rate), "odds": F.round(odds, 6)})
    known = {r["stem"]: r["odds"] for r in told.filter(F.col("stem").isin(*sorted(INSULTS)) & (F.col("t") + F.col("c") >= LEAST_DOCUMENTS)).collect()}
    best = told.filter((F.col("t") >= LEAST_DOCUMENTS) & (F.col("evidence") > math.log(tests / CHANCE))).orderBy(F.desc("evidence"), F.desc(F.length("stem")), "stem").collect()
    stems = {s: known.get(s, PUBLIC) for s in INSULTS if known.get(s, PUBLIC) > 0}
    begun = {s[:n] for s in stems for n in range(SHORTEST, len(s))}
    for r in best:
        stem = r["stem"]
        if stem in begun or any(stem[:n] in stems for n in range(SHORTEST, len(stem) + 1)):
            continue  # a more telling one, or a public one, begins alike
        stems[stem] = r["odds"]
        begun |= {stem[:n] for n in range(SHORTEST, len(stem))}
    return tuple(sorted(stems.items())), toxic, clean


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """Stems, then weights from the table of distinct feature vectors with their numbers: at most ``bound`` reach the driver.

    There are no more than training rows, which ``bound`` bounds.
    """
    rows = labelled_rows(docs, labels, bound)
    stems, toxic, clean = learn_stems(rows)
    prior = Model(stems, tuple(PRIOR.tolist()))
    if not toxic or not clean:
        return prior
    cells = with_features(rows, prior, ["label"]).groupBy("label", "features").count().orderBy("label", "features").collect()
    x = np.column_stack([np.ones(len(cells)), np.array([c["features"] for c in cells])])
    y, n = np.array([c["label"] for c in cells], dtype=np.float64), np.array([c["count"] for c in cells], dtype=np.float64)
    w = PRIOR.copy()
    start, ridge = w.copy(), np.full(len(w), 0.5)
    ridge[0] = 0.01
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (n * (y - p)) - ridge * (w - start)
        step = np.linalg.solve((x.T * (n * np.maximum(p * (1 - p), 1e-9))) @ x + np.diag(ridge), gradient)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return Model(stems, tuple(float(v) for v in np.round(w, 9)))


def with_features(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``features`` array<double>."""
    at, schema = len(keep), with_fields(rows.select(*keep).schema, "features array<double>")

    def run(batches):
        reader = ClauseGrammar(model)
        for batch in batches:
            features = pa.array([reader.features(t.as_py()) for t in batch.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], features], names=[*keep, "features"])
        release()

    return rows.select(*keep, "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        reader = ClauseGrammar(model)
        for batch in batches:
            scores = pa.array([reader.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])
        release()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents scored 0.5 or more; the text never leaves its task."""
    where = docs.columns.index("text")

    def run(batches):
        reader = ClauseGrammar(model)
        for batch in batches:
            yield batch.filter(pa.array([reader.score(t.as_py()) < 0.5 for t in batch.column(where)], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)

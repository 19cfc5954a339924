"""Ranked lexical search: the documents with the largest inner products with each item, by buckets of equal length.

A document is a vector of term impacts, an item a vector of term weights; the score is their inner product, in
whole numbers. As in LEMP, vectors are ordered by length and cut into buckets. An item skips a bucket when the product
of lengths (Cauchy-Schwarz), or the item's product with the bucket's largest coordinates, stays below the item's
threshold, the score of its best rows so far. Inside a bucket the item's coordinates are multiplied out a few at a
time, the heaviest first, and the rest is bounded by the lengths that are left and by the largest coordinates; the few
rows that may still reach the threshold are scored exactly, in integers. Both vectors carry the square root of the weight (impact * sqrt(w), sqrt(w)), which leaves the
product as it is and makes the lengths of common terms small. Bounds are widened by more than the error of doubles.

The thresholds start from the longest vectors of the whole corpus: a histogram of lengths finds at least ``SEED`` of
them, and their scores are the lower bounds that every task begins with. Nothing of a document is shuffled: each task
orders its own vectors, block by block, and only its best rows of each item leave it. Items are searched in blocks of
bounded size, so what is sent to tasks is bounded; the documents are read once, the vectors of a block's terms kept as
a table in the shared folder.

A null text has no terms and is no document of N; neither is a text without terms. Rows that repeat a doc_id are
documents of their own. Rows that repeat an item_id are one item with the terms of all its texts; a null item_id is an
id like others. Equal scores are ordered by doc_id, null first. Items without terms or without documents of a score
above 0 have no rows; an empty table of documents or items gives none. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logframe.llm.common import Scratch, release

TOP = 50
#: Documents at least whose scores give the first thresholds.
SEED = 4096
#: Vectors of a bucket, coordinates of a bucket, and coordinates that a task orders at once.
BUCKET, COORDINATES, BLOCK = 1024, 1 << 20, 2 << 20
#: Distinct (item, term) pairs that are searched at once, and sent to tasks.
PAIRS = 200_000
#: Coordinates of an item that are multiplied out between two bounds, and the part of a bucket that is few enough to be scored.
FOCUS, ENOUGH = 8, 16
#: Buckets of the histogram of lengths in each doubling.
STEPS = 8
SLACK = 1 + 1e-9

#: Lower-cases A-Z and turns every other ASCII character but digits and a-z into a blank; bytes of longer characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_blocks(items: DataFrame, pairs: int = PAIRS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their distinct terms, in blocks of at most ``pairs`` terms (an item is not cut)."""

    def run(batches):
        for batch in batches:
            found = [(i, t) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms(x or b""))]
            if found:
                ids, words = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())], names=["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "item_id long, term binary")
    block, held = [], 0
    grouped = rows.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms")).orderBy("item_id")
    for row in grouped.toLocalIterator():
        block.append((row["item_id"], [bytes(t) for t in row["terms"]]))
        held += len(row["terms"])
        if held >= pairs:
            yield block
            block, held = [], 0
    if block:
        yield block


class Vectors:
    """Rows of sparse vectors in flat arrays: of row r the coordinates begin[r] to begin[r + 1]."""

    def __init__(self, doc: list, n: np.ndarray, begin: np.ndarray, at: np.ndarray, tf: np.ndarray):
        self.doc, self.n, self.begin, self.at, self.tf = doc, n, begin, at, tf
        self.impact = self.length = None

    @classmethod
    def blocks(cls, batches, most: int = BLOCK) -> Iterator[Vectors]:
        """The stored rows (doc_id, n, at, tf) in blocks of about ``most`` coordinates."""
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[2]) // 4
                if size >= most:
                    yield cls.of(held)
                    held, size = [], 0
        if held:
            yield cls.of(held)

    @classmethod
    def of(cls, rows: list[tuple]) -> Vectors:
        doc, n, at, tf = zip(*rows, strict=True)
        begin = np.concatenate(([0], np.cumsum([len(a) // 4 for a in at]))).astype(np.int64)
        return cls(list(doc), np.array(n, dtype=np.int64), begin, np.frombuffer(b"".join(at), dtype=np.int32), np.frombuffer(b"".join(tf), dtype=np.int32))

    def weigh(self, weights: np.ndarray, n_docs: int, n_terms: int) -> Vectors:
        """Impacts of the coordinates and the length of every vector."""
        m = np.array([50 + (50 * int(n) * n_docs) // n_terms for n in self.n], dtype=np.int64)
        count = np.diff(self.begin)
        tf = self.tf.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, count))
        square, filled = np.zeros(len(count)), count > 0
        if len(tf):
            square[filled] = np.add.reduceat(self.impact.astype(np.float64) ** 2 * weights[self.at], self.begin[:-1][filled])
        self.length = np.sqrt(square)
        return self

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row's place in ``rows``, coordinate's place) of all coordinates of some rows."""
        count = self.begin[rows + 1] - self.begin[rows]
        own = np.repeat(np.arange(len(rows)), count)
        skip = np.concatenate(([0], np.cumsum(count)[:-1])) if len(rows) else np.zeros(0, dtype=np.int64)
        return own, np.arange(count.sum()) - np.repeat(skip, count) + np.repeat(self.begin[rows], count)


class Bucket:
    """Vectors of like length, by coordinate."""

    def __init__(self, vectors: Vectors, rows: np.ndarray, weights: np.ndarray):
        self.vectors, self.rows, self.length = vectors, rows, vectors.length[rows]
        self.longest = float(self.length.max())
        own, place = vectors.take(rows)
        at = vectors.at[place]
        order = np.argsort(at, kind="stable")
        self.at, self.own, self.impact = at[order], own[order], vectors.impact[place][order]
        self.known, first = np.unique(self.at, return_index=True)
        self.edge = np.append(first, len(self.at))
        self.top = np.maximum.reduceat(self.impact, first) * np.sqrt(weights[self.known]) if len(first) else np.zeros(0)

    def columns(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the coordinates ``wanted`` occur here, and their places among ``known``."""
        place = np.searchsorted(self.known, wanted)
        there = place < len(self.known)
        there[there] = self.known[place[there]] == wanted[there]
        return np.flatnonzero(there), place[there]

    def survivors(self, query: Query, threshold: int) -> np.ndarray:
        """Places of the rows whose product with the query may reach the threshold."""
        none = np.zeros(0, dtype=np.int64)
        if query.length * self.longest * SLACK < threshold:
            return none
        mine, there = self.columns(query.at)
        root = query.root[mine]
        most = root * self.top[there]
        if not len(mine) or most.sum() * SLACK < threshold:
            return none
        # heaviest coordinates first; after each few the rest is bounded by what is left of both lengths and by the largest coordinates
        order = np.argsort(-most, kind="stable")
        most_left = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)
        root_left = np.sqrt(np.append(np.cumsum((root[order] ** 2)[::-1])[::-1], 0.0))
        product, square = np.zeros(len(self.rows)), np.zeros(len(self.rows))
        for begin in range(0, len(order), FOCUS):
            for k in order[begin : begin + FOCUS]:
                column = slice(self.edge[there[k]], self.edge[there[k] + 1])
                d = self.impact[column] * root[k]
                product[self.own[column]] += d * root[k]
                square[self.own[column]] += d * d
            done = min(begin + FOCUS, len(order))
            left = root_left[done] * np.sqrt(np.maximum(self.length**2 * SLACK - square, 0.0))
            alive = np.flatnonzero((product + np.minimum(left, most_left[done])) * SLACK >= threshold)
            if len(alive) <= len(self.rows) // ENOUGH:
                break
        return alive

    def scores(self, query: Query, survivors: np.ndarray) -> np.ndarray:
        """Exact scores of some rows, read by row."""
        own, place = self.vectors.take(self.rows[survivors])
        at = self.vectors.at[place]
        k = np.minimum(np.searchsorted(query.at, at), len(query.at) - 1)
        mine = query.at[k] == at
        total = np.zeros(len(survivors), dtype=np.int64)
        np.add.at(total, own[mine], self.vectors.impact[place[mine]] * query.weight[k[mine]])
        return total


class Query:
    """An item's vector, its threshold and its best rows in a task."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, threshold: int):
        self.at, self.weight = at, weights[at]
        self.root = np.sqrt(self.weight.astype(np.float64))
        self.length = float(np.sqrt(self.weight.sum()))
        self.start, self.best = max(threshold, 1), []

    def threshold(self, top: int) -> int:
        return max(self.start, self.best[0][0]) if len(self.best) == top else self.start

    def offer(self, score: int, doc: int | None, top: int) -> None:
        # of equal scores the larger id goes first; null is the smallest id
        entry = (score, -doc if doc is not None else math.inf, doc)
        if len(self.best) < top:
            heapq.heappush(self.best, entry)
        elif entry[:2] > self.best[0][:2]:
            heapq.heapreplace(self.best, entry)


def search_block(vectors: Vectors, queries: list[Query], weights: np.ndarray, top: int, rows: np.ndarray | None = None) -> tuple[int, int]:
    """Offer the block's rows to the queries, longest first; how many (query, row) pairs were there and were scored."""
    rows = np.argsort(-vectors.length, kind="stable") if rows is None else rows[np.argsort(-vectors.length[rows], kind="stable")]
    sizes = np.cumsum(vectors.begin[rows + 1] - vectors.begin[rows])
    begin, pairs, scored = 0, 0, 0
    while begin < len(rows):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, min(begin + BUCKET, int(np.searchsorted(sizes, before + COORDINATES))))
        bucket = Bucket(vectors, rows[begin:end], weights)
        for q in queries:
            found = bucket.survivors(q, q.threshold(top))
            pairs, scored = pairs + end - begin, scored + len(found)
            if len(found):
                exact, least = bucket.scores(q, found), q.threshold(top)
                for r, s in zip(found[exact >= least], exact[exact >= least], strict=True):
                    q.offer(int(s), vectors.doc[bucket.rows[r]], top)
        begin = end
    return pairs, scored


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf) of every text with terms; at and tf are int32 arrays of the known terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        place = known.value
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms(text.as_py() or b"")
                if found:
                    own = sorted((place[t], c) for t, c in Counter(found).items() if t in place)
                    flat = np.array(own, dtype=np.int32).reshape(-1, 2)
                    out.append((doc.as_py(), len(found), flat[:, 0].tobytes(), flat[:, 1].tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n", "at", "tf"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, at binary, tf binary")


def _document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each known term is; tasks count before anything is shuffled."""

    def run(batches):
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int32)
            df += np.bincount(at, minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["at", "df"])

    out = np.zeros(size, dtype=np.int64)
    for row in vectors.select("at").mapInArrow(run, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
        out[row["at"]] = row["df"]
    return out


def _step(length: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(np.maximum(length, 1.0))).astype(np.int64)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, seed: int = SEED, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank int, doc_id, score long: the ``top`` best documents of each item."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "search")
    found = [part for k, block in enumerate(item_blocks(items, pairs)) if (part := _search(docs, block, scratch, k, top, seed)) is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], scratch: Scratch, k: int, top: int, seed: int) -> DataFrame | None:
    """The best rows (item_id, doc_id, score) of each task for the items of one block."""
    sc = docs.sparkSession.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    vectors = scratch.keep(_vectors(docs, vocabulary), f"vectors{k}")
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not vocabulary:
        return None
    df = _document_frequencies(vectors, len(vocabulary))
    weights = np.array([weight(n_docs, int(d)) for d in df], dtype=np.int64)
    wanted = [np.array([vocabulary[t] for t in own], dtype=np.int64) for _, own in block]
    held = sc.broadcast((weights, wanted))

    def lengths(batches):
        weights, _ = held.value
        counts: Counter = Counter()
        for v in Vectors.blocks(batches):
            counts.update(_step(v.weigh(weights, n_docs, n_terms).length).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["step", "n"])

    def best(least_step: int | None, thresholds):
        def run(batches):
            weights, wanted = held.value
            queries = [Query(at, weights, t) for at, t in zip(wanted, thresholds.value if thresholds else [1] * len(wanted), strict=True)]
            for v in Vectors.blocks(batches):
                v.weigh(weights, n_docs, n_terms)
                search_block(v, queries, weights, top, None if least_step is None else np.flatnonzero(_step(v.length) >= least_step))
            for i, q in enumerate(queries):
                if q.best:
                    score, _, doc = zip(*q.best, strict=True)
                    arrays = [pa.array([i] * len(doc), pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])
            release()

        return vectors.mapInArrow(run, "item int, doc_id long, score long")

    # the longest vectors of the corpus give every item's first threshold; a histogram has few rows
    steps = vectors.mapInArrow(lengths, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    least, seen = None, 0
    for row in steps:
        least, seen = row["step"], seen + row["n"]
        if seen >= seed:
            break
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    floor = best(least, None).select("item", "score").withColumn("rank", rank).filter(F.col("rank") == top).select("item", "score").collect()
    known = {r["item"]: r["score"] for r in floor}
    thresholds = sc.broadcast([known.get(i, 1) for i in range(len(block))])
    names = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
    return best(None, thresholds).join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def oracle(documents: str = "documents", benchmark: str = "benchmark", top: int = TOP) -> str:
    """DuckDB SQL for :func:`search`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda c: f"regexp_extract_all(translate({c}, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS t FROM {documents}),
        k AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
        q AS (SELECT DISTINCT item_id, unnest({words("text")}) AS term FROM {benchmark}),
        p AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
        tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY r, term),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, k GROUP BY term),
        s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::BIGINT AS score
            FROM tf JOIN w USING (term) JOIN q USING (term), k GROUP BY item_id, r),
        o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM o WHERE rank <= {top}"""

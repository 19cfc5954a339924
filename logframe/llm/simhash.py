"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into segments. Two fingerprints within ``distance``
bits agree up to a small radius in at least one segment, so each fingerprint looks up
the Hamming ball of that radius around each of its segments in a table of all segments,
and the complete distance decides. Equal fingerprints are one node from the start.

With a ``similarity`` (the pipeline's stage), texts are linked as well where the Jaccard
similarity of their shingles of one word more is at least that. MinHash bands find the
candidates: a pair at 0.8 meets in one of 20 bands of 4 with probability 0.99997. The
shingle sets themselves decide.

Texts without words, empty and null ones have fingerprint zero. Null keys take part but
never name a component unless it has no other key. Repeated rows give repeated results.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from logframe.llm.common import BROADCAST_KEYS, durable, free_name, map_arrow, release, without
from logframe.llm.components import connected

SHINGLE_WORDS, SEED, DISTANCE = 4, 42, 4
#: Fingerprints that one task holds of one bucket; larger buckets are cut into pairs of chunks of this size.
CHUNK = 8192
#: Most frequent fingerprints whose components are broadcast.
HEAVY = 1000
#: From how many members a bucket's links are found as a spanning forest.
DENSE = 32
#: (offset, bits, radius) of each segment. The radii r satisfy sum(r + 1) > distance.
SEGMENTS_SMALL = ((0, 22, 0), (22, 21, 1), (43, 21, 1))
SEGMENTS_LARGE = ((0, 32, 2), (32, 32, 1))
LARGE = 1 << 28
#: MinHash bands and the values in each; texts and shingles that one task compares.
BANDS, BAND_VALUES, TEXTS, SHINGLES = 20, 4, 4096, 1 << 20
#: Copies of a band's table of smallest texts, against bands that very many texts share; cut clusters or buckets that are broadcast.
SALTS, BROADCAST_CLUSTERS = 16, 200_000
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """A hash of each word shingle of one text, in order; of the whole text where it is shorter."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    last = ends[-1:] if len(parts) < words else ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 8192):
        block = hashes[i : i + 8192].astype(">u8")
        ones += np.unpackbits(block.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of one text, as a signed 64-bit integer."""
    return _majority(shingle_hashes(text, words, seed))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles of one word more: each is two adjacent ones. A text of one shingle keeps it."""
    h = hashes
    return np.unique(_mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h)


def bands(shingles: np.ndarray) -> list[int]:
    """One value for each MinHash band, as signed 64-bit integers; none for no shingles."""
    if not len(shingles):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[i : i + 1024, None] * _FACTORS).min(axis=0))
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_VALUES).T:
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + column)
    return value.view(np.int64).tolist()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", banded: bool = False) -> DataFrame:
    """(doc_id, text_key, fp) for every row; text_key is a hash of the text itself. ``banded`` adds bands and n_shingles."""
    import pyarrow as pa

    def one(text: str | None) -> tuple:
        hashes = shingle_hashes(text)
        if not banded:
            return (_majority(hashes),)
        shingles = shingle_set(hashes)
        return _majority(hashes), bands(shingles), len(shingles)

    def run(batch):
        made = zip(*(one(t.as_py()) for t in batch.column(2)), strict=True)
        arrays = [pa.array(c, k) for c, k in zip(made, (pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "text_key", "fp", "bands", "n_shingles"][: 2 + len(arrays)])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, text_key long, fp long" + (", bands array<long>, n_shingles long" if banded else ""))


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in flips) for r in range(1, radius + 1) for flips in combinations(range(bits), r)]


def _probes(fps: DataFrame, segments) -> DataFrame:
    """(seg, value, own, fp): each segment's own value, and the larger values of its ball.

    A pair whose segments differ is met once, from the smaller value.
    """
    def of(seg: int, offset: int, bits: int, radius: int) -> list:
        value = F.shiftrightunsigned("fp", offset).bitwiseAND((1 << bits) - 1)
        entry = lambda x, own: F.struct(F.lit(seg).alias("seg"), x.alias("value"), F.lit(own).alias("own"))
        if not radius:
            return [F.array(entry(value, 1))]
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(bits, radius)])
        near = F.filter(F.transform(masks, lambda m: value.bitwiseXOR(m)), lambda x: x > value)
        return [F.array(entry(value, 1)), F.transform(near, lambda x: entry(x, 0))]

    keys = [k for seg, cut in enumerate(segments) for k in of(seg, *cut)]
    return fps.select("fp", F.explode(F.concat(*keys)).alias("k")).select("k.seg", "k.value", "k.own", "fp")


def _forest(fp: np.ndarray, own: np.ndarray, distance: int) -> tuple[list, list]:
    """Edges of a spanning forest of one bucket's links; a link needs a member whose own segment this is."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= distance
            if not own[at]:
                near &= own[left].astype(bool)
            found = left[near]
            if len(found):
                left = left[~near]
                a.append(np.full(len(found), fp[at]))
                b.append(fp[found])
                stack.extend(found)
    return a, b


def _bucket_links(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links in whole buckets, given sorted by bucket with the owners first."""
    fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    own = pdf["own"].to_numpy()
    fresh = np.zeros(len(pdf), dtype=bool)
    fresh[0] = True
    for c in ("seg", "value", "pair"):
        x = pdf[c].to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    bucket = np.cumsum(fresh) - 1
    sizes = np.bincount(bucket)
    small = sizes[bucket] <= DENSE
    a, b = [], []
    for d in range(1, min(DENSE, int(sizes.max()))):
        i = np.flatnonzero((bucket[:-d] == bucket[d:]) & small[d:] & (own[:-d] == 1))
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
        a.append(fp[i])
        b.append(fp[i + d])
    begins = np.flatnonzero(fresh)
    for g in np.flatnonzero(sizes > DENSE):
        x, y = _forest(fp[begins[g] : begins[g] + sizes[g]], own[begins[g] : begins[g] + sizes[g]], distance)
        a += x
        b += y
    join = lambda parts: (np.concatenate(parts) if parts else np.zeros(0, np.uint64)).astype(np.uint64).view(np.int64)
    return pd.DataFrame({"a": join(a), "b": join(b)})


def links(fps: DataFrame, distance: int = DISTANCE, segments=None, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints reachable through links of at most ``distance`` bits.

    Small buckets give all their links, dense ones a spanning forest of them, so no
    bucket emits all its pairs. A bucket above ``chunk`` members is cut into pairs of
    chunks, each a task of its own: every pair of members meets in one of them.
    """
    segments = segments or (SEGMENTS_LARGE if fps.count() > LARGE else SEGMENTS_SMALL)
    if sum(r + 1 for _, _, r in segments) <= distance:
        raise ValueError("the segments' radii are too small for this distance")
    probes = _probes(fps, segments)
    # only buckets above a chunk need their size; it is counted with partial sums, so no task ever holds a bucket
    large = durable(probes.groupBy("seg", "value").count().filter(F.col("count") > chunk).select(F.col("seg").alias("__seg"), F.col("value").alias("__value"), F.ceil(F.col("count") / chunk).cast("int").alias("k")))
    n_large, pairs = large.count(), F.array(F.lit(0).cast("long"))
    if n_large:
        near = F.broadcast(large) if n_large <= BROADCAST_CLUSTERS else large
        probes = probes.join(near, (F.col("seg") == F.col("__seg")) & (F.col("value") == F.col("__value")), "left")
        k = F.col("k")
        mine = F.pmod(F.xxhash64("fp"), k).cast("int")
        pairs = F.when(k.isNull(), pairs).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda x: (F.least(x, mine) * k + F.greatest(x, mine)).cast("long")))
    dealt = probes.select("seg", "value", "own", "fp", F.explode(pairs).alias("pair"))
    ordered = dealt.repartition("seg", "value", "pair").sortWithinPartitions("seg", "value", "pair", F.desc("own"), "fp")

    return ordered.mapInPandas(_whole_buckets(["seg", "value", "pair"], lambda pdf: _bucket_links(pdf, distance)), "a long, b long").distinct()


def _whole_buckets(names: list[str], fn):
    """A function of batches sorted by bucket that gives ``fn`` whole buckets, whatever the batches' borders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[names].to_numpy()
            inside = (keys == keys[-1]).all(axis=1)
            cut = len(batch) - int(inside.sum())  # the last bucket may go on in the next batch
            if cut:
                yield fn(pd.concat([*held, batch[:cut]], ignore_index=True))
                held = [batch[cut:]]
            elif held and not (held[-1][names].to_numpy()[-1] == keys[-1]).all():
                yield fn(pd.concat(held, ignore_index=True))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return run


class _Sets:
    """Shingle sets of one task, for counting what one of them shares with the others."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.marked = np.zeros(int(self.ids.max()) + 1, dtype=np.int32)

    def near(self, at: int, similarity: float) -> np.ndarray:
        """Whether each set has at least this Jaccard similarity with the set ``at``."""
        own = self.ids[self.begins[at] : self.begins[at] + self.sizes[at]]
        self.marked[own] = 1
        both = np.add.reduceat(self.marked[self.ids], self.begins)
        self.marked[own] = 0
        return both >= similarity * (self.sizes + self.sizes[at] - both) - 1e-9


def _spanning(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs whose similarity is at least ``similarity``."""
    known, left, stack, out = _Sets(sets), np.ones(len(sets), dtype=bool), [], []
    for first in range(len(sets)):
        if left[first]:
            left[first], stack = False, [first]
        while stack and left.any():
            at = stack.pop()
            found = np.flatnonzero(known.near(at, similarity) & left)
            left[found] = False
            out += [(at, int(x)) for x in found]
            stack.extend(found.tolist())
    return out


def _bridges(sets: list[np.ndarray], parts: list[int], sides: list[int], similarity: float) -> list[tuple[int, int]]:
    """Edges from sets of side 1 to sets of other parts."""
    known, part, out = _Sets(sets), np.array(parts), []
    for at in np.flatnonzero(np.array(sides) == 1):
        for x in np.flatnonzero(known.near(at, similarity) & (part != part[at])):
            out.append((int(at), int(x)))
            part[part == part[x]] = part[at]  # now one part
    return out


def _in_groups(rows: DataFrame, keys: list[str], edges) -> DataFrame:
    """Edges (a, b) between fingerprints; ``edges`` gives index pairs for the columns fp, shingles, ... of one group of ``keys``."""
    import pyarrow as pa

    n = len(keys)
    columns = [c for c in rows.columns if c not in keys]

    def run(batches):
        now, held = None, []

        def done():
            found = edges(*[list(c) for c in zip(*held, strict=True)][1:]) if len(held) > 1 else []
            pairs = {(held[x][0], held[y][0]) for x, y in found if held[x][0] != held[y][0]}
            a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                group = tuple(x.as_py() for x in row[:n])
                if group != now:
                    if held:
                        yield done()
                    now, held = group, []
                fp, shingles, *more = (x.as_py() for x in row[n:])
                held.append((fp, np.frombuffer(shingles, np.uint64), *more))
        if held:
            yield done()
        held = []
        release()

    ordered = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, "fp")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _with_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``wanted`` (doc_id, text_key, ...) with ``shingles``, from the texts, each once."""
    import pyarrow as pa

    more = [c for c in wanted.columns if c not in ("doc_id", "text_key")]
    named = wanted.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), *more)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    source = source.join(named, source["doc_id"].eqNullSafe(F.col("__id")) & (source["text_key"] == F.col("__key"))).select("text_key", *more, "text")

    def sets(batch):
        made = pa.array((shingle_set(shingle_hashes(t.as_py())).tobytes() for t in batch.column(batch.num_columns - 1)), pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=["text_key", *more, "shingles"])

    schema = StructType([source.schema["text_key"], *[source.schema[c] for c in more], StructField("shingles", BinaryType())])
    return map_arrow(source, sets, schema).dropDuplicates(["text_key"])


def _parts(count: Column, shingles: Column, texts: int, size: int) -> Column:
    """Into how many parts so many texts with so many shingles are cut."""
    return F.greatest(F.ceil(count / texts), F.ceil(shingles / size), F.lit(1)).cast("int")


class Similar:
    """Links between texts whose five-word shingle sets have at least a Jaccard similarity.

    ``rows`` are banded fingerprints. Texts that share a MinHash band are candidates; each
    distinct text counts once. Candidates that hang together form a cluster. A cluster of
    up to ``texts`` texts (and ``size`` shingles) is one task, which gives a spanning forest
    of its links. A larger one is cut twice, by two hashes, so that what is alike hangs
    together after both; ``rest`` then compares what shares a band and still does not.
    """

    def __init__(self, docs: DataFrame, rows: DataFrame, similarity: float, key: str = "doc_id", text: str = "text", texts: int = TEXTS, size: int = SHINGLES):
        self.docs, self.similarity, self.key, self.text, self.texts, self.size = docs, similarity, key, text, texts, size
        known = rows.filter("n_shingles > 0").groupBy("text_key").agg(*[F.min_by(c, F.coalesce("doc_id", F.lit(1 << 62))).alias(c) for c in ("doc_id", "fp", "n_shingles", "bands")])
        known = durable(known)
        met = known.select(F.explode("bands").alias("value"), "text_key").withColumn("salt", F.pmod("text_key", F.lit(SALTS)))
        least = met.groupBy("value").agg(F.min("text_key").alias("least"), F.count("*").alias("n")).filter("n > 1").select("value", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        near = met.join(least.withColumn("salt", F.col("salt").cast("long")), ["value", "salt"]).filter("text_key <> least").select(F.col("text_key").alias("a"), F.col("least").alias("b"))
        placed = durable(known.join(connected(near), F.col("text_key") == F.col("node")).drop("node"))
        parts = placed.groupBy("root").agg(_parts(F.count("*"), F.sum("n_shingles"), texts, size).alias("k")).filter("k > 1")
        self.large = durable(parts)
        large = self.large.select(F.col("root").alias("__root"), "k")
        if self.large.count() <= BROADCAST_CLUSTERS:
            large = F.broadcast(large)
        self.placed = placed.join(large, F.col("root") == F.col("__root"), "left").drop("__root")

    def links(self) -> DataFrame:
        part = lambda seed: F.pmod(F.xxhash64("text_key", F.lit(seed)), F.col("k")).cast("int")
        parts = F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.array(part(1), -1 - part(2)))
        held = _with_sets(self.docs, self.placed.select("doc_id", "text_key", "fp", "root", parts.alias("parts")), self.key, self.text)
        dealt = held.select("root", F.explode("parts").alias("part"), "fp", "shingles")
        similarity = self.similarity
        return _in_groups(dealt, ["root", "part"], lambda sets: _spanning(sets, similarity))

    def rest(self, found: DataFrame) -> DataFrame | None:
        """The links that ``found`` (node, root) does not yet connect, of the clusters that were cut.

        In a band, the largest component is compared with all others, and these with each
        other, in tasks of one part of each; the largest is not compared with itself.
        """
        if self.large.isEmpty():
            return None
        roots = found.select(F.col("node").alias("__node"), F.col("root").alias("component"))
        texts = self.placed.filter("k is not null").join(roots, F.col("fp") == F.col("__node"), "left").drop("__node").withColumn("component", F.coalesce("component", "fp"))
        texts = durable(texts.select("doc_id", "text_key", "fp", "n_shingles", "bands", "component"))
        met = texts.select(F.explode("bands").alias("value"), "text_key", "fp", "n_shingles", "component")
        sizes = met.groupBy("value", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
        several = sizes.groupBy("value").agg(
            F.max(F.struct("n", "component", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("components")
        ).filter("components > 1")
        main = _parts(F.col("most.n"), F.col("most.s"), self.texts, self.size).alias("k_main")
        others = _parts(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s"), self.texts, self.size).alias("k_others")
        several = durable(several.select(F.col("value").alias("v"), F.col("most.component").alias("main"), main, others))
        if several.isEmpty():
            return None
        dealt = met.join(several, F.col("value") == F.col("v"))
        own = lambda k: F.pmod(F.xxhash64("text_key", F.lit(3)), F.col(k)).cast("int")
        task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
        upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
        is_main = F.col("component") == F.col("main")
        with_main = F.when(is_main, F.transform(upto("k_others"), lambda j: task("main", own("k_main"), j, F.lit(0)))).otherwise(F.transform(upto("k_main"), lambda i: task("main", i, own("k_others"), F.lit(1))))
        among = F.when(is_main, F.filter(with_main, lambda x: F.lit(False))).otherwise(
            F.transform(upto("k_others"), lambda j: task("others", F.least(j, own("k_others")), F.greatest(j, own("k_others")), F.lit(1)))
        )
        tasks = dealt.select("text_key", "value", "component", F.explode(F.concat(with_main, among)).alias("t"))
        sets = _with_sets(self.docs, texts.select("doc_id", "text_key", "fp").join(tasks.select(F.col("text_key").alias("__k")).distinct(), F.col("text_key") == F.col("__k"), "left_semi"), self.key, self.text)
        rows = tasks.join(sets, "text_key").select("value", "t.kind", "t.i", "t.j", "fp", "shingles", "component", "t.side")
        similarity = self.similarity
        return _in_groups(rows, ["value", "kind", "i", "j"], lambda sets, parts, sides: _bridges(sets, parts, sides, similarity))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) for every row; component_id is the smallest key
    reachable through links, root a fingerprint that names the component even if keys repeat.

    Rows of the ``HEAVY`` most frequent fingerprints get theirs from a broadcast table, the
    others by a join, so that a text with very many copies does not fill one partition.
    """
    rows = durable(fingerprints(docs, key, text, banded=similarity is not None))
    fps = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    edges = links(fps.select("fp"), distance)
    if similarity is not None:
        similar = Similar(docs, rows, similarity, key, text)
        edges = durable(edges.union(similar.links()))
    found = durable(connected(edges))
    if similarity is not None and (rest := similar.rest(found)) is not None:
        rest = durable(rest)
        found = found if rest.isEmpty() else durable(connected(edges.union(rest)))
    named = found.join(fps, found.node == fps.fp).groupBy("root").agg(F.min("first").alias("least"))
    moved = found.join(named, "root").select(F.col("node").alias("fp"), "root", "least")
    final = fps.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"), "copies")
    final = durable(final)
    heavy = F.broadcast(final.filter("copies > 1").orderBy(F.desc("copies"), "fp").limit(HEAVY).drop("copies"))
    columns = ["doc_id", "text_key", "fp", "root", "component_id"]
    frequent = rows.join(heavy, "fp").select(*columns)
    others = rows.join(heavy, "fp", "left_anti").join(final, "fp").select(*columns)
    return frequent.union(others)


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs, key, text, distance).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id; rows repeated whole are kept once."""
    groups = durable(near_duplicates(docs, distance=distance, similarity=similarity))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = without(docs, durable(groups.filter(~first).select("doc_id", "text_key").distinct()))
    several = durable(groups.filter(first).groupBy("root").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key")).filter("n > 1"))
    if several.isEmpty():
        return kept
    # repeated ids: of a group's first rows one stays, of the smallest text key; copies merge in their tasks before any shuffle
    ids = groups.filter(first).select("root", "doc_id", "text_key").distinct().join(several.select("root"), "root", "left_semi")
    fewer = without(kept, durable(ids.select("doc_id", "text_key")))
    key, a, b = (free_name(docs.columns, n) for n in ("key", "id", "kept"))
    one = several.select(F.col("doc_id").alias(a), F.col("text_key").alias(b))
    again = kept.withColumn(key, F.xxhash64("text"))
    again = again.join(F.broadcast(one) if one.count() <= BROADCAST_KEYS else one, again["doc_id"].eqNullSafe(F.col(a)) & (F.col(key) == F.col(b))).dropDuplicates([a, b])
    return fewer.unionByName(again.select(*docs.columns))

"""Token ids as binary shards with a minimal perfect hash index from document keys to places.

A data set is a folder:

* ``shard-N.ids``: the ids of the shard's documents one after the other, little-endian unsigned 16-bit integers where
  the vocabulary allows, else 32-bit; documents in ascending (key, text hash) order, null keys first, over all shards.
* ``shard-N.ends``: for each document of the shard the number of ids up to its end, little-endian unsigned 64-bit.
* ``index-N.mph``: a slice of the index. The keys' hashes choose a slice and a cell in it; a cell holds a minimal
  perfect hash of its keys (bit arrays of falling size: a key stands in the first array where no other key hits its
  bit, and its number is the count of set bits before it) and, by that number, a 32-bit fingerprint, the shard, the
  document's number in it, the id offset, and how many documents in a row have the key.
* ``manifest.json``: the width of an id, ids and documents of every shard, the index's shape, the place of the null key.

A lookup reads one cell of bounded size, one place and one range of bytes, whatever the size of the data set. A key
that the data set does not hold is taken for another with a chance of 2**-32. Documents under one key follow one
another and may run on into the next shard. Shards are cut by ranges of (key, text hash, row), so copies of a document
need not meet in one task. Files are written under another name and renamed when whole, so a task that is run again
replaces its own file. All files go through Arrow's file systems (local, hdfs, s3, gs) into the shared folder.

A null text counts as empty: its document is the end id alone. An empty table gives a data set without shards.
Repeated rows are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logframe.llm.common import Scratch, release
from logframe.llm.token_counts import counter

END = 2
#: Bytes of the texts of a shard, keys of a slice of the index and of a cell, on average.
SHARD_BYTES, SLICE_KEYS, CELL_KEYS = 256 << 20, 1 << 20, 4096
#: Documents that are read at once, and ids of one read.
RUN, READ_IDS = 2048, 8 << 20
#: Bits of a level's array for each key, and levels before the rest is listed.
GAMMA, LEVELS = 2, 24
ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("record", "<u8"), ("offset", "<u8"), ("copies", "<u8")])


# --- files


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def put(path: str, parts) -> None:
    """Write a file whole: under a name of its own, then renamed."""
    fs, place = opened(path)
    context = TaskContext.get()
    own = f"{place}.{context.taskAttemptId() if context else 'driver'}"
    with fs.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    settle(fs, own, place)


def settle(fs: pafs.FileSystem, own: str, place: str) -> None:
    """Give a whole file its name, in place of one that an earlier attempt left."""
    try:
        fs.move(own, place)
    except OSError:  # some file systems do not rename onto a file
        fs.delete_file(place)
        fs.move(own, place)


def get(path: str, begin: int = 0, size: int | None = None) -> bytes:
    fs, place = opened(path)
    with fs.open_input_file(place) as f:
        f.seek(begin)
        return f.read() if size is None else f.read(size)


# --- minimal perfect hash


def key_hash(keys: np.ndarray) -> np.ndarray:
    """XXH64 with seed 42 of 8-byte integers, as ``xxhash64`` of a long column gives it, unsigned."""
    # fixed values of XXH64
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    # end of fixed values

    def turn(x, by):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = turn(h ^ (turn(keys.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _remix(h: np.ndarray, level: int) -> np.ndarray:
    """Another hash of a hash for each level."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (_remix(h, 1 << 20) >> np.uint64(32)).astype("<u4")


class MinimalPerfectHash:
    """Distinct 64-bit hashes onto 0 .. n - 1."""

    def __init__(self, arrays: list[np.ndarray], rest: np.ndarray):
        self.arrays, self.rest = arrays, rest  # arrays of 0 and 1, the hashes that no level placed, sorted
        self.ranks = []
        before = 0
        for a in arrays:
            self.ranks.append(before + np.cumsum(a, dtype=np.int64) - a)
            before += int(a.sum())
        self.placed = before

    @classmethod
    def of(cls, hashes: np.ndarray) -> MinimalPerfectHash:
        arrays, left = [], hashes
        while len(left) and len(arrays) < LEVELS:
            size = max(64, GAMMA * len(left))
            at = (_remix(left, len(arrays)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(arrays, np.sort(left))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes; some number below n, or -1, for those that it was not made of."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.arange(len(hashes))
        for level, (array, rank) in enumerate(zip(self.arrays, self.ranks, strict=True)):
            if not len(open_):
                return out
            at = (_remix(hashes[open_], level) % np.uint64(len(array))).astype(np.int64)
            hit = array[at] == 1
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            place = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            same = self.rest[place] == hashes[open_]
            out[open_[same]] = self.placed + place[same]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.arrays), len(self.rest), *map(len, self.arrays)], dtype="<u8").tobytes()
        return head + b"".join(np.packbits(a).tobytes() for a in self.arrays) + self.rest.astype("<u8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> tuple[MinimalPerfectHash, int]:
        """The hash written at the beginning of ``data``, and the bytes that it takes."""
        levels, rest = (int(x) for x in np.frombuffer(data, "<u8", 2))
        sizes, at, arrays = np.frombuffer(data, "<u8", levels, 16), 16 + 8 * levels, []
        for size in map(int, sizes):
            n = (size + 7) // 8
            arrays.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at))[:size])
            at += n
        return cls(arrays, np.frombuffer(data, "<u8", rest, at).astype(np.uint64)), at + 8 * rest


def cell_bytes(hashes: np.ndarray, entries: np.ndarray) -> bytes:
    mph = MinimalPerfectHash.of(hashes)
    out = np.zeros(len(entries), dtype=ENTRY)
    out[mph(hashes)] = entries
    return mph.dump() + out.tobytes()


def find_in_cell(cell: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the hashes are found, their entries)."""
    if not cell:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=ENTRY)
    mph, at = MinimalPerfectHash.load(cell)
    entries, place = np.frombuffer(cell, ENTRY, offset=at), mph(hashes)
    there = np.flatnonzero(place >= 0)
    there = there[entries["fingerprint"][place[there]] == fingerprint(hashes[there])]
    return there, entries[place[there]]


def slice_and_cell(h: np.ndarray, slices: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(slices)).astype(np.int64), (_remix(h, 1 << 21) % np.uint64(cells)).astype(np.int64)


def with_cells(keys: DataFrame, slices: int, cells: int) -> DataFrame:
    """(slice, cell) before the columns of ``keys``, the first of which is the key; a null key gets -1."""

    def run(batches):
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            s, c = slice_and_cell(key_hash(batch.column(0).fill_null(0).to_numpy()), slices, cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(null, -1, s)), pa.array(np.where(null, -1, c)), *batch.columns], names=["slice", "cell", *batch.schema.names])

    return keys.mapInArrow(run, StructType([StructField("slice", LongType()), StructField("cell", LongType()), *keys.schema.fields]))


# --- writing


def _width(path: str, end: int) -> str:
    return "<u2" if max(len(counter(path).lengths) - 1, end) < 1 << 16 else "<u4"


def write(docs: DataFrame, out: str, path: str, end: int = END, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> dict:
    """Encode ``docs`` with a vocabulary file and write them as a data set into the folder ``out``; its manifest.

    Texts are dealt by ranges once and encoded where their shard is written, so no ids are stored or shuffled besides it.
    """
    spark, width, end_id = docs.sparkSession, _width(path, end), end
    fs, place = opened(out)
    fs.create_dir(place, recursive=True)
    scratch = Scratch(spark, "encoded")
    body = F.coalesce(F.col(text), F.lit(""))
    # of equal keys and texts the row's number in the input decides, so that copies can be cut apart
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(body).alias("tie"), F.monotonically_increasing_id().alias("row"), body.alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    order = [F.asc_nulls_first("key"), F.col("tie"), F.col("row")]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "text")

    def shard(batches):
        """Write one shard as its rows come; a row (key, first document, offset, copies, shard and its size so far) of each run of a key."""
        first = next(batches, None)
        if first is None:
            return
        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, place = opened(f"{out}/shard-{number}")
        c = counter(path)
        own = [f"{place}.ids.{attempt}", f"{place}.ends.{attempt}"]
        records = ids = 0
        with fs.open_output_stream(own[0]) as payload, fs.open_output_stream(own[1]) as ends:
            for batch in _again(first, batches):
                if not batch.num_rows:
                    continue
                key, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
                sizes = np.zeros(batch.num_rows, dtype=np.int64)
                for i, t in enumerate(batch.column(1)):
                    found = np.array([*c.encode(t.as_py()), end_id], dtype=width)
                    payload.write(found.tobytes())
                    sizes[i] = len(found)
                end = ids + np.cumsum(sizes)
                ends.write(end.astype("<u8").tobytes())
                begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1]))))
                offset = np.concatenate(([ids], end[:-1]))[begins]
                copies = np.diff(np.append(begins, len(key)))
                at, records, ids = records + begins, records + len(key), int(end[-1])
                same = lambda v: np.full(len(begins), v, dtype=np.int64)  # noqa: B023, E731
                columns = [pa.array(key[begins], pa.int64(), mask=null[begins]), *map(pa.array, (at, offset, copies, same(number), same(records), same(ids)))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "record", "offset", "copies", "shard", "records", "ids"])
        settle(fs, own[0], f"{place}.ids")
        settle(fs, own[1], f"{place}.ends")
        release()

    keys = scratch.keep(dealt.mapInArrow(shard, "key long, record long, offset long, copies long, shard long, records long, ids long"), "keys")
    # one row a shard: their number grows with the data by one for each ``shard_bytes``
    sizes = {r["shard"]: [r["records"], r["ids"]] for r in keys.groupBy("shard").agg(F.max("records").alias("records"), F.max("ids").alias("ids")).collect()}
    manifest = {"width": width, "end": end, "shards": [[s, *sizes[s]] for s in sorted(sizes)], "null": None}
    manifest |= _write_index(keys, out, scratch)
    put(f"{out}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def _again(first, rest) -> Iterator:
    yield first
    yield from rest


def _write_index(keys: DataFrame, out: str, scratch: Scratch) -> dict:
    """Write the index's slices; its part of the manifest."""
    spark = keys.sparkSession
    place = F.min(F.struct("shard", "record", "offset")).alias("first")
    merged = scratch.keep(keys.groupBy("key").agg(place, F.sum("copies").alias("copies")).select("key", "first.*", "copies"), "places")
    n = merged.filter(F.col("key").isNotNull()).count()
    none = merged.filter(F.col("key").isNull()).first()
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if n > CELL_KEYS else 1, -(-n // SLICE_KEYS))
    cells = max(1, -(-n // (slices * CELL_KEYS)))

    def index(batches):
        now, written, held = None, [], {}

        def flush():
            bodies, end, starts = [], 8 * (cells + 1), []
            for c in range(cells):
                starts.append(end)
                if c in held:
                    part = np.concatenate(held[c])
                    entries = np.zeros(len(part), dtype=ENTRY)
                    hashes = key_hash(part[:, 0])
                    for i, f in enumerate(("shard", "record", "offset", "copies")):
                        entries[f] = part[:, i + 1]
                    entries["fingerprint"] = fingerprint(hashes)
                    bodies.append(cell_bytes(hashes, entries))
                    end += len(bodies[-1])
            put(f"{out}/index-{now}.mph", [np.array([*starts, end], dtype="<u8").tobytes(), *bodies])
            written.append((now, sum(len(p) for c in held.values() for p in c)))

        for batch in batches:
            values = [batch.column(i).to_numpy() for i in range(7)]
            for cut in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(values[0])) + 1):
                if len(cut):
                    if now != (s := int(values[0][cut[0]])):
                        if now is not None:
                            flush()
                        now, held = s, {}
                    rows, cell = np.column_stack([v[cut] for v in values[2:]]), values[1][cut]
                    for c in np.unique(cell):
                        held.setdefault(int(c), []).append(rows[cell == c])
        if now is not None:
            flush()
            s, k = zip(*written, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(k, pa.int64())], names=["slice", "keys"])
        release()

    rows = merged.filter(F.col("key").isNotNull()).select("key", "shard", "record", "offset", "copies")
    rows = with_cells(rows, slices, cells).repartition("slice").sortWithinPartitions("slice")
    done = rows.mapInArrow(index, "slice long, keys long").agg(F.coalesce(F.sum("keys"), F.lit(0)), F.collect_set("slice")).first()
    if done[0] != n:
        raise RuntimeError(f"{done[0]} of {n} keys are in the index")
    null = [none[c] for c in ("shard", "record", "offset", "copies")] if none else None
    return {"keys": n, "slices": slices, "cells": cells, "null": null}


# --- reading


class DataSet:
    """A written data set, for lookups one at a time or many."""

    def __init__(self, path: str):
        self.path, self.manifest = path, json.loads(get(f"{path}/manifest.json"))
        self.width, self.end = np.dtype(self.manifest["width"]), self.manifest["end"]
        self.shards = {s: (records, ids) for s, records, ids in self.manifest["shards"]}
        self.order = list(self.shards)
        self.at = {s: i for i, s in enumerate(self.order)}
        self.before, total = {}, 0
        for s, (_, ids) in self.shards.items():
            self.before[s] = total
            total += ids

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys, none null, are here, their entries); each slice and cell is read once."""
        found, entries = [], []
        if self.manifest["keys"]:
            h = key_hash(keys)
            slices, cells = slice_and_cell(h, self.manifest["slices"], self.manifest["cells"])
            for s in np.unique(slices):
                name = f"{self.path}/index-{s}.mph"
                fs, place = opened(name)
                if fs.get_file_info(place).type == pafs.FileType.NotFound:
                    continue
                starts = np.frombuffer(get(name, 0, 8 * (self.manifest["cells"] + 1)), "<u8")
                mine = np.flatnonzero(slices == s)
                for c in np.unique(cells[mine]):
                    asked = mine[cells[mine] == c]
                    there, got = find_in_cell(get(name, int(starts[c]), int(starts[c + 1] - starts[c])), h[asked])
                    found.append(asked[there])
                    entries.append(got)
        return (np.concatenate(found), np.concatenate(entries)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=ENTRY))

    def runs(self, shard: int, record: int, copies: int, most: int = RUN) -> Iterator[tuple[int, int, int]]:
        """(shard, first document, number) of documents in a row, each run inside one shard and one stretch of ``most``."""
        at = self.at[shard]
        while copies:
            records = self.shards[self.order[at]][0]
            n = min(copies, records - record, most - record % most)
            yield self.order[at], record, n
            record, copies = record + n, copies - n
            if record == records:
                at, record = at + 1, 0

    def documents(self, shard: int, record: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(ids of all documents before, ids) of ``n`` documents of a shard, read in stretches of bounded size."""
        skip = 1 if record else 0
        ends = np.frombuffer(get(f"{self.path}/shard-{shard}.ends", 8 * (record - skip), 8 * (n + skip)), "<u8").astype(np.int64)
        edges = ends if skip else np.concatenate(([0], ends))
        i, size = 0, self.width.itemsize
        while i < n:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + READ_IDS, "right")) - 1)
            data = np.frombuffer(get(f"{self.path}/shard-{shard}.ids", size * int(edges[i]), size * int(edges[j] - edges[i])), self.width)
            for k in range(i, j):
                yield self.before[shard] + int(edges[k]), data[edges[k] - edges[i] : edges[k + 1] - edges[i]]
            i = j

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document under a key, without their end ids."""
        if key is None:
            place = self.manifest["null"]
        else:
            found, entries = self.find(np.array([key], dtype=np.int64))
            place = [int(entries[0][f]) for f in ("shard", "record", "offset", "copies")] if len(found) else None
        if place is None:
            return []
        return [ids[:-1] for s, r, n in self.runs(place[0], place[1], place[3]) for _, ids in self.documents(s, r, n)]


def read(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document under the keys, null included, through the index.

    Keys are looked up a slice of the index at a time; what is found is dealt by stretches of a shard, which are read in order.
    """
    spark = keys.sparkSession
    data = spark.sparkContext.broadcast(DataSet(path))

    def look(batches):
        d = data.value
        for batch in batches:
            out, column = [], batch.column(2)
            asked = column.drop_null().to_numpy().astype(np.int64)
            found, entries = d.find(asked)
            hits = [(int(asked[i]), int(e["shard"]), int(e["record"]), int(e["copies"])) for i, e in zip(found, entries, strict=True)]
            if column.null_count and d.manifest["null"]:
                shard, record, _, copies = d.manifest["null"]
                hits.append((None, shard, record, copies))
            for k, *place in hits:
                for run in d.runs(*place):
                    out.append((k, *run))
                    if len(out) >= 65_536:
                        yield _table(out)
                        out = []
            if out:
                yield _table(out)

    def _table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "shard", "record", "n"])

    def fetch(batches):
        d = data.value
        for batch in batches:
            places, out, k = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), [], 0
            while k < len(places):
                # places that follow one another in a shard are read together
                m = k + 1
                while m < len(places) and places[m][1] == places[k][1] and places[m][2] == places[m - 1][2] + places[m - 1][3]:
                    m += 1
                documents = d.documents(places[k][1], places[k][2], sum(p[3] for p in places[k:m]))
                for doc, _, _, n in places[k:m]:
                    for start, ids in islice(documents, n):
                        out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) >= 65_536:
                        yield _result(out)
                        out = []
                k = m
            if out:
                yield _result(out)
        release()

    def _result(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shape = data.value.manifest
    asked = with_cells(keys.select(F.col(key).cast("long").alias("doc_id")).distinct(), shape["slices"], shape["cells"])
    places = asked.repartition("slice", "cell").sortWithinPartitions("slice", "cell").mapInArrow(look, "doc_id long, shard long, record long, n long")
    stretch = [F.col("shard"), F.floor(F.col("record") / RUN)]
    return places.repartition(*stretch).sortWithinPartitions("shard", "record").mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` written as a data set into the shared folder and read back by their keys."""
    out = f"{Scratch(docs.sparkSession, 'dataset').home}/ids"
    write(docs, out, path)
    return read(docs, out)


def remove(spark: SparkSession, out: str) -> None:
    """Delete a data set."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""A streaming source that follows growing text files: ``spark.readStream.format("log_tail")``.

The driver only finds where complete lines end; tasks read the byte ranges. A file that
became smaller, or that no longer has the bytes that stood before the kept place, was
replaced: it starts a new generation and is read from its beginning. The offset holds a
checksum of those bytes; they are compared when a file's size or time has changed. A file
that is gone leaves the offset; if one of its name comes back, its generation is above all
that were ever given. Files must be on storage that the driver and all executors see.

Options: ``path`` (a folder of ``*.log`` files, or a glob), ``rangeBytes`` (of one task),
``state``, a file in which the source keeps its last committed place, and
``maxBytesPerBatch``, which needs ``state``: without it the source cannot tell a new query
from a restarted one, and takes all there is as the first batch, in ranges of bounded size.
A restarted query goes on from its checkpoint without ``state``, too; with it, it notices
files that shrank while it was down.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 30
#: Bytes before the kept place that tell whether a file is still the same.
MARK_BYTES = 256


def mark_of(path: str, end: int) -> int:
    """Checksum of the bytes before an offset."""
    with open(path, "rb") as f:
        f.seek(max(0, end - MARK_BYTES))
        return zlib.crc32(f.read(min(MARK_BYTES, end)))


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, generation: int):
        self.path, self.begin, self.end, self.generation = path, begin, end, generation


def last_break(path: str, begin: int, end: int, step: int = 1 << 16) -> int:
    """Offset behind the last line feed in [begin, end); ``begin`` if there is none."""
    with open(path, "rb") as f:
        while end > begin:
            start = max(begin, end - step)
            f.seek(start)
            if (at := f.read(end - start).rfind(b"\n")) >= 0:
                return start + at + 1
            end = start
    return begin


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.batch_bytes = int(options.get("maxbytesperbatch", options.get("maxBytesPerBatch", BATCH_BYTES)))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.state = options.get("state")
        if not self.state and (options.get("maxbytesperbatch") or options.get("maxBytesPerBatch")):
            raise ValueError("maxBytesPerBatch needs the option state")
        self.at: dict | None = None
        self.seen: dict[str, tuple[int, int]] = {}

    def files(self) -> list[str]:
        return sorted(glob.glob(os.path.join(self.path, "*.log")) if os.path.isdir(self.path) else glob.glob(self.path))

    def initialOffset(self) -> dict:
        return {"files": "{}", "born": 0}

    def remembered(self) -> dict | None:
        if self.state and os.path.exists(self.state):
            with open(self.state) as f:
                kept = json.load(f)
            return kept if isinstance(kept.get("files"), str) else {"files": json.dumps(kept)}
        return None

    def latestOffset(self) -> dict:
        # Spark does not tell the place to go on from, and the remembered one may lag behind it: a first batch
        # that may be a restart's takes all there is, so that it cannot end before it starts
        last = self.at or self.remembered()
        first = self.at is None and not (self.state and last is None)
        last = last or self.initialOffset()
        old, born, left = json.loads(last["files"]), last.get("born", 0), sys.maxsize if first else self.batch_bytes
        present = self.files()
        gone = [generation for path, (_, generation, *_) in old.items() if path not in set(present)]
        born = max([born, *(g + 1 for g in gone)])
        known = {}
        for path in present:
            done, generation, *mark = old.get(path, [0, born])
            size, changed = os.path.getsize(path), os.stat(path).st_mtime_ns
            fresh = self.seen.get(path) != (size, changed)
            if size < done or (fresh and done and mark and mark_of(path, done) != mark[0]):
                done, generation, mark = 0, generation + 1, []
            self.seen[path] = size, changed
            end = last_break(path, done, min(size, done + left)) if size > done and left else done
            if end == done and size > done + left > done:  # a line longer than the batch is taken whole
                end = last_break(path, done, size)
            left = max(0, left - (end - done))
            known[path] = [end, generation, mark[0] if mark and end == done else mark_of(path, end)]
        self.at = {"files": json.dumps(known, sort_keys=True), "born": born}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = self.at or end  # a batch run again after a restart
        old, new, out = json.loads(start["files"]), json.loads(end["files"]), []
        for path, (stop, generation, *_) in sorted(new.items()):
            begin, before, *_ = old.get(path, [0, generation])
            begin = begin if before == generation else 0
            out += [Range(path, b, min(b + self.range_bytes, stop), generation) for b in range(begin, stop, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        """Lines that start in the range; the last may run on behind it."""
        name = os.path.basename(partition.path)
        source = name[:-4] if name.endswith(".log") else name
        with open(partition.path, "rb") as f:
            at = partition.begin
            if at:
                f.seek(at - 1)
                if f.read(1) != b"\n":
                    at += len(f.readline())
            f.seek(at)
            while at < partition.end:
                raw = f.readline()
                if not raw.endswith(b"\n"):
                    break
                body = raw[:-1].removesuffix(b"\r")
                yield source, partition.generation, at, len(body), body.decode("utf-8", "replace")
                at += len(raw)

    def commit(self, end: dict) -> None:
        if self.state:
            with open(f"{self.state}.new", "w") as f:
                json.dump(end, f)
            os.replace(f"{self.state}.new", self.state)

    def stop(self) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "source string, generation int, byte_offset long, byte_length int, content string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)

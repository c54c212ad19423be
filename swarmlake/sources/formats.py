"""Dump files and sync frames as data sources: spark.read.format("swarm_dump"), spark.readStream.format("swarm_frames").

Records have no marks to find their beginnings by, so a split is a range of bytes that begins and ends
between records. A header pass finds such places: it reads lengths only, skips what they span and keeps a
place every `splitBytes`. Files up to that size are one split and need none. For larger ones `write_offsets`
makes the pass as a Spark job, a task a file, and leaves the places beside the files; without them, the
planner makes it. Files are opened with pyarrow.fs (file, hdfs, s3, gs), by planner and tasks alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from io import BytesIO
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import codecs
from .datasource import DUMP, entry_batches, frame_batches

SPLIT_BYTES = 16 << 20
OFFSETS = "_offsets"
#: Where a record's name length and its name stand, by format.
LAYOUT = {"dump": (36, 38), "frames": (0, 32)}
READ_BYTES = 1 << 20


def opened(path: str) -> tuple[Any, str]:
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def record_end(buffer: bytes, at: int, kind: str) -> int | None:
    """Where the record that begins at `at` ends, or None if the buffer ends first; the end of a stream of frames is -1."""
    length, name = LAYOUT[kind]
    n = len(buffer)
    if kind == "frames" and buffer[at : at + 2] == b"\0\0":
        return -1
    if at + name > n:
        return None
    p = at + name + int.from_bytes(buffer[at + length : at + length + 2], "big")
    if p + 2 > n:
        return None
    files, p = int.from_bytes(buffer[p : p + 2], "big"), p + 2
    for _ in range(files):
        if p + 10 > n:
            return None
        p += 10 + int.from_bytes(buffer[p + 8 : p + 10], "big")
    return p if p <= n else None


def cuts(stream, start: int, kind: str, every: int, most: int | None = None) -> tuple[list[int], bool]:
    """Places between records from `start` on, the first one past each `every` bytes and the last whole one; and whether bytes of a cut record follow.

    It stops at the first place `most` bytes on. Held is one read and the record under way.
    """
    stream.seek(start)
    buffer, base, at, found, last = b"", start, 0, [start], start
    while True:
        end = record_end(buffer, at, kind)
        if end is None:
            more = stream.read(READ_BYTES)
            if not more:
                break
            buffer, base, at = buffer[at:] + more, base + at, 0
            continue
        if end < 0:
            at = len(buffer)  # nothing behind the end of a stream counts
            break
        at, last = end, base + end
        if last - found[-1] >= every:
            found.append(last)
        if most is not None and last - start >= most:
            return (found if found[-1] == last else [*found, last]), False
    return (found if found[-1] == last else [*found, last]), len(buffer) > at


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the data files under a path, by name; names that begin with _ or . are none."""
    from pyarrow import fs

    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(part[:1] in "_." for part in p[len(at) :].split("/") if part)
    root = path.rstrip("/")
    return sorted((f"{root}/{f.path[len(at.rstrip('/')) :].lstrip('/')}", f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Run(InputPartition):
    """Splits that a task reads one after the other; it holds the bytes of one."""

    splits: list[Split]


def runs(found: list[Split]) -> list[Run]:
    """Splits dealt to tasks: SPLIT_BYTES each, or less if that gives no 64 tasks. So small splits bound what is held, and not how many tasks there are."""
    per, out, size = min(SPLIT_BYTES, sum(s.end - s.start for s in found) // 64), [], 0
    for s in found:
        if not out or size >= per:
            out.append(Run([]))
            size = 0
        out[-1].splits.append(s)
        size += s.end - s.start
    return out


def file_cuts(path: str, size: int, every: int, kind: str = "dump") -> list[int]:
    """Places between a whole file's records. A dump may end inside a hash, no file later in a record."""
    store, at = opened(path)
    with store.open_input_file(at) as stream:
        found, cut = cuts(stream, 0, kind, every)
        if cut and (kind == "frames" or size - found[-1] >= 20):
            raise codecs.Truncated(f"{path} ends inside a record")
    return found


def splits(files: list[tuple[str, int]], every: int, kind: str, known: dict[tuple[str, int], list[int]]) -> list[Split]:
    """Splits of files, those of more than `every` bytes at places that are known or found now, eight files at once."""
    large = [f for f in files if f[1] > every]
    with ThreadPoolExecutor(8) as pool:
        passed = dict(zip(large, pool.map(lambda f: known.get(f) or file_cuts(*f, every, kind), large), strict=True))
    out = []
    for path, size in files:
        places = passed.get((path, size), [0, size])
        out += [Split(path, a, b) for a, b in zip(places, places[1:], strict=False) if b > a]
    return out or [Split("", 0, 0)]  # a source must have a split


class DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def _known(self) -> dict[tuple[str, int], list[int]]:
        """Places that `write_offsets` left, by path and size of the file they are of."""
        from pyarrow import fs

        store, at = opened(f"{self.path.rstrip('/')}/{OFFSETS}")
        if store.get_file_info(at).type != fs.FileType.Directory:
            return {}
        out = {}
        for f in store.get_file_info(fs.FileSelector(at)):
            if f.base_name.startswith("part-"):
                with store.open_input_stream(f.path) as stream:
                    for line in stream.read().splitlines():
                        x = json.loads(line)
                        out[x["path"], x["size"]] = x["cuts"]
        return out

    def partitions(self) -> list[Run]:
        files = listed(self.path)
        return runs(splits(files, self.split, "dump", self._known() if any(n > self.split for _, n in files) else {}))

    def read(self, partition: Run) -> Iterator:
        for s in partition.splits:
            if s.path:
                yield from entry_batches(codecs.read_dump(BytesIO(_bytes(s))))


class FramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Run]:
        return runs(splits(listed(self.path), self.split, "frames", {}))

    def read(self, partition: Run) -> Iterator:
        for s in partition.splits:
            if s.path:
                yield from frame_batches(_bytes(s))


class FramesStream(DataSourceStreamReader):
    """Frames of files that grow: the offset is a byte of each file, always between two frames.

    A frame that is still being written waits for the next batch. A restarted query goes on inside a file
    where its last batch ended. `bytesPerBatch` bounds a batch by whole frames, in order of file names; with the
    trigger availableNow a run is one batch, so leave it out there to read all there is.
    """

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.most = int(options["bytesPerBatch"]) if options.get("bytesPerBatch") else None
        self.at: dict[str, int] | None = None
        self.places: dict[tuple[str, int], list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        known, left = self.at or {}, self.most
        out = dict(known)
        for path, size in listed(self.path):
            name, start = path[len(self.path.rstrip("/")) :].lstrip("/"), known.get(path[len(self.path.rstrip("/")) :].lstrip("/"), 0)
            if size <= start or left is not None and left <= 0:
                continue
            self.places[name, start] = places = self._cuts(path, start, left)
            if places[-1] > start:
                out[name] = places[-1]
                left = left and left - (places[-1] - start)
        self.at = out
        return out

    def _cuts(self, path: str, start: int, most: int | None) -> list[int]:
        store, at = opened(path)
        with store.open_input_file(at) as stream:
            return cuts(stream, start, "frames", self.split, most)[0]

    def partitions(self, start: dict, end: dict) -> list[Run]:
        if self.at is None:  # a restarted query asks for the empty range of the last offset it knows before all else
            self.at = dict(end)
        out = []
        for name, stop in sorted(end.items()):
            begin = start.get(name, 0)
            if stop <= begin:
                continue
            path = f"{self.path.rstrip('/')}/{name}"
            places = self.places.get((name, begin)) or self._cuts(path, begin, stop - begin)
            places = [p for p in places if p < stop] + [stop]
            out += [Split(path, a, b) for a, b in zip(places, places[1:], strict=False)]
        return runs(out)

    def commit(self, end: dict) -> None:
        self.places = {k: v for k, v in self.places.items() if v[-1] > end.get(k[0], 0)}

    def read(self, partition: Run) -> Iterator:
        for s in partition.splits:
            yield from frame_batches(_bytes(s))


def _bytes(split: Split) -> bytes:
    store, at = opened(split.path)
    with store.open_input_file(at) as stream:
        stream.seek(split.start)
        return stream.read(split.end - split.start)


class DumpSource(DataSource):
    """Options: path, splitBytes. A file that ends inside a record, other than in its hash, fails the read."""

    @classmethod
    def name(cls) -> str:
        return "swarm_dump"

    def schema(self) -> str:
        return DUMP

    def reader(self, schema) -> DumpReader:
        return DumpReader(self.options)


class FramesSource(DataSource):
    """Options: path, splitBytes; for streams also bytesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "swarm_frames"

    def schema(self) -> str:
        return DUMP

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options)

    def streamReader(self, schema) -> FramesStream:
        return FramesStream(self.options)


def register(spark: SparkSession) -> None:
    for source in (DumpSource, FramesSource):
        spark.dataSource.register(source)


def write_offsets(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> int:
    """Makes the header pass of all larger files under a path as a job, a task a file; returns the number of files passed."""
    files = [f for f in listed(path) if f[1] > split_bytes]
    if not files:
        return 0

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps({"path": p, "size": n, "cuts": file_cuts(p, n, split_bytes)}) for p, n in rows], pa.string())], ["value"])

    spark.createDataFrame(files, "path string, size long").repartition(len(files), "path").mapInArrow(run, "value string").write.mode("overwrite").text(f"{path.rstrip('/')}/{OFFSETS}")
    return len(files)

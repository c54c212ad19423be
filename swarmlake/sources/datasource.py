"""Source of dump files and row encoders. A dump file is read in one task, as its records can't be split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs

DUMP = "infohash binary, name string, size long, discovered_at long, files array<struct<path:string,size:long>>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all dump files under a path of any store that Spark reads, in whole or not at all per file.

    A file that ends inside a record, other than in its hash, fails the read.
    """
    return from_dump(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def from_dump(files: DataFrame) -> DataFrame:
    """Entries of dump files, rows with a binary column `content`; batch or stream."""
    from io import BytesIO

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0):
                yield from entry_batches(codecs.read_dump(BytesIO(raw.as_buffer())))

    return files.select("content").mapInArrow(parse, DUMP)


def encoded(entries: DataFrame, encode) -> DataFrame:
    """Adds `raw`, each row through an encoder of `codecs`."""
    @F.pandas_udf("binary")
    def run(infohash: pd.Series, name: pd.Series, size: pd.Series, at: pd.Series, files: pd.Series) -> pd.Series:
        rows = zip(infohash, name, size, at, files, strict=True)
        return pd.Series([encode({"infohash": bytes(h), "name": n or "", "size": int(s), "discovered_at": int(t), "files": [(f["path"], int(f["size"])) for f in (fs if fs is not None else ())]}) for h, n, s, t, fs in rows])

    return entries.withColumn("raw", run("infohash", "name", "size", "discovered_at", "files"))


def entry_batches(rows: Iterator[codecs.Entry], size: int = 5000):
    """Arrow batches of entries."""
    import pyarrow as pa

    files = pa.list_(pa.struct([("path", pa.string()), ("size", pa.int64())]))
    schema = pa.schema([("infohash", pa.binary()), ("name", pa.string()), ("size", pa.int64()), ("discovered_at", pa.int64()), ("files", files)])
    held = []
    for e in rows:
        held.append(e | {"files": [{"path": p, "size": n} for p, n in e["files"]]})
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def frame_batches(raw: bytes, size: int = 5000):
    """Arrow batches of the entries of sync frames."""
    import pyarrow as pa

    for hashes, names, sizes, times, starts, paths, lengths in codecs.read_frame_columns(raw, size):
        files = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "size"])
        columns = [pa.array(hashes, pa.binary()), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), files)]
        yield pa.RecordBatch.from_arrays(columns, ["infohash", "name", "size", "discovered_at", "files"])


def from_old_store(pairs: DataFrame) -> DataFrame:
    """Entries of the older store's export, rows (key, value); rows of other kinds and broken ones are left out."""

    def parse(batches):
        for batch in batches:
            got = (codecs.read_old_store(k, v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if k is not None and v is not None)
            yield from entry_batches(e for e in got if e)

    return pairs.select("key", "value").mapInArrow(parse, DUMP)


def from_frames(files: DataFrame) -> DataFrame:
    """Entries of files of sync frames, rows with a binary column `content`; batch or stream."""

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0):
                yield from frame_batches(raw.as_py())

    return files.select("content").mapInArrow(parse, DUMP)


def frames_stream(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """Sync frames as they arrive as files; Spark's checkpoint remembers which were read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return from_frames(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "part-*").load(path))


PACKET = (
    "kind string, transaction binary, method string, id binary, target binary, port int, nodes array<struct<id:binary,ip:string,port:int>>, peers array<struct<ip:string,port:int>>, "
    "samples array<binary>, num long, interval long, error long"
)


def parsed_packets(packets: DataFrame, raw: str = "packet") -> DataFrame:
    """Datagrams (a binary column beside others) as fields; those that can't be read are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    own = [c for c in packets.columns if c != raw]
    schema = StructType([*packets.select(*own).schema.fields, *_parse_datatype_string(PACKET).fields])
    arrow = to_arrow_schema(schema)

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            got = [codecs.parse_message(x) if x is not None else None for x in batch.column(0).to_pylist()]
            where = pa.array([i for i, m in enumerate(got) if m], pa.int64())
            found = [m | {"nodes": [dict(zip(("id", "ip", "port"), n, strict=True)) for n in m["nodes"]], "peers": [dict(zip(("ip", "port"), p, strict=True)) for p in m["peers"]]} for m in got if m]
            cols = [batch.column(1 + i).take(where) for i in range(len(own))]
            cols += [pa.array([m[f.name] for m in found], arrow.field(f.name).type) for f in list(arrow)[len(own) :]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return packets.select(raw, *own).mapInArrow(parse, schema)


def answered_packets(packets: DataFrame, me: bytes, raw: str = "packet") -> DataFrame:
    """Adds `method` and the answer's `kind` and `code` to the requests among datagrams."""
    schema = "method string, kind string, code long"

    @F.pandas_udf(schema)
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            method, answer = codecs.dispatched(bytes(x), me) if x is not None else (None, None)
            got = codecs.parse_message(answer) if answer else None
            rows.append((method, got and got["kind"], got and got["error"]))
        return pd.DataFrame(rows, columns=["method", "kind", "code"]).astype({"code": "Int64"})

    return packets.withColumn("_a", run(raw)).filter("_a.kind is not null").select(*[c for c in packets.columns if c != raw], "_a.*")


def captured(spark: SparkSession, path: str) -> DataFrame:
    """Packets (seq, packet) of capture files: a big-endian length of two bytes before each; a cut end is left out."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                raw, at, out = raw.as_py(), 0, []
                while at + 2 <= len(raw):
                    n = int.from_bytes(raw[at : at + 2], "big")
                    if at + 2 + n > len(raw):
                        break
                    out.append(raw[at + 2 : at + 2 + n])
                    at += 2 + n
                yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int64()), pa.array(out, pa.binary())], ["seq", "packet"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, "seq long, packet binary")

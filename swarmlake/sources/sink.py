"""Sink for dump files, written by Spark's own committer to any store that it writes to."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.format import u48
from ..schema import ENTRY
from . import codecs
from .datasource import encoded

if TYPE_CHECKING:
    import pyarrow as pa

FILE_BYTES = 16 << 20


def write_dump(entries: DataFrame, path: str) -> None:
    """Dump files of about FILE_BYTES. The records of a file are one row of the text writer; the line
    end behind it is shorter than a hash, so a reader ends there cleanly."""

    _write_joined(encoded(entries, codecs.write_dump).select("raw"), path, "\n")


def write_frames(entries: DataFrame, path: str) -> None:
    """Files of sync frames, about FILE_BYTES each. The writer's two zero bytes behind a file's frames end its stream."""
    _write_joined(entries.filter(F.length("name") > 0).select(frame().alias("raw")), path, "\0\0")


def frame() -> Column:
    """The bytes of `codecs.write_frame`, made of the columns of a named entry by built-in expressions."""
    needed = lambda c: F.coalesce(c, F.raise_error(F.lit("a frame has no null")))
    number = lambda c, n: F.lpad(F.hex(needed(c.cast("long"))), 2 * n, "0")
    count = lambda c: number(F.least(c, F.lit(0xFFFF)), 2)
    text = lambda c: F.substring(needed(c).cast("binary"), 1, 0xFFFF)
    record = lambda f: F.concat(number(f["size"], 8), count(F.octet_length(f["path"])), F.hex(text(f["path"])))
    files, at = F.coalesce("files", F.array().cast(ENTRY["files"].dataType)), F.col("discovered_at")
    time = F.when(at.between(0, 0xFFFFFFFF), at).otherwise(F.raise_error(F.lit("a time is a number of 32 bits")))
    return F.unhex(F.concat(
        count(F.octet_length("name")), F.hex(needed(F.col("infohash"))), number(time, 4), number(u48(F.col("size")), 6), F.hex(text(F.col("name"))),
        count(F.size(files)), F.array_join(F.transform(F.slice(files, 1, 0xFFFF), record), ""),
    ))


def write_capture(packets: DataFrame, path: str) -> None:
    """Capture files of packets (a binary column `packet`), each behind its length of two bytes."""
    length = F.unhex(F.lpad(F.hex(F.octet_length("packet").cast("long")), 4, "0"))
    _write_joined(packets.select(F.concat(length, F.col("packet")).alias("raw")), path, "\0")


def _write_joined(rows: DataFrame, path: str, end: str) -> None:
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    files = rows.mapInArrow(joined, "value binary").selectExpr("CAST(value AS STRING) AS value")
    files.write.option("maxRecordsPerFile", 1).option("lineSep", end).mode("overwrite").text(path)

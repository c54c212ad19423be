"""WARC archives with revisit records.

Headers (id, length, digests) are shuffled by payload digest; of equal payloads one capture stays a
response and the others become revisit records that refer to it. Bodies are read once more to write
the archives and are shuffled only if there are too many revisits to send their list to every task.
A record is a gzip member of its own, so it can be fetched by offset; an archive is bounded by bytes
and ends in a metadata record that counts the others. Archives are written by Spark's text writer,
a file per row, and read back as binary files.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_groups

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, warc_type string, page_id long, uri string, refers_to_id string, refers_to_page long, payload_digest string, payload_bytes long, payload_sha1 string"


def resolve_revisits(captures: DataFrame, id_col: str, payload: Column, min_bytes: int) -> DataFrame:
    """A row (_id, _bytes, _sha1, _keep) for each capture that repeats another's payload.

    Only headers travel. Equal payloads are those of equal length, SHA-1 and SHA-256. A payload with
    a third of all captures is no hot key: it is counted on the map side, and what was found out
    about large groups is broadcast to their captures.
    """
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    heads = captures.select(
        F.col(id_col).cast("long").alias("_id"), F.octet_length(body).cast("long").alias("_bytes"), F.sha1(body).alias("_sha1"), F.unhex(F.sha2(body, 256)).alias("_sha256")
    )
    scratch = Scratch(captures.sparkSession, "heads")
    heads = scratch.stage(heads.filter(F.col("_bytes") >= min_bytes), "heads")
    keys = ["_bytes", "_sha1", "_sha256"]
    kept = heads.groupBy(*keys).agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = join_groups(heads, scratch.stage(kept, "kept"), keys, "_n", heads.count())
    return found.filter(~F.col("_id").eqNullSafe(F.col("_keep"))).select("_id", "_bytes", "_sha1", "_keep").distinct()


def _record_id(page: int | None, sha1: str) -> str:
    h = hashlib.sha256(f"{'null' if page is None else page}/{sha1}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _member(fields: list[tuple[str, str]], block: bytes = b"") -> bytes:
    """A record as a gzip member."""
    head = "".join([f"WARC/1.1{CRLF}", *(f"{k}: {v}{CRLF}" for k, v in fields), f"Content-Length: {len(block)}{CRLF}{CRLF}"])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogatepass")) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _record(page: int | None, uri: str, sha1: str, payload: bytes | None, size: int, keep: int | None, date: str) -> bytes:
    """The record of a capture: a response, or with no payload a revisit of the page `keep`."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{CRLF}{CRLF}".encode()
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", _record_id(page, sha1)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Page-ID", "" if page is None else str(page)), ("Content-Type", "application/http; msgtype=response"),
    ]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(keep, sha1)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(keep))]
    return _member(fields, http + (payload or b""))


def _closing(records: int, date: str) -> bytes:
    """The record that ends an archive. As every member of less than 16 MB, it ends in a zero byte."""
    return _member([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<urn:x-count:{records}>"), ("WARC-Date", date), ("X-Records", str(records))])


def write_archives(
    captures: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 1000,
    date: str = "2024-01-01T00:00:00Z", file_bytes: int = 16 << 20, max_broadcast: int = 200_000,
) -> None:
    """Write one record per row: `response` with the payload, or `revisit` with headers only.

    A null payload is empty, a null id or URI an empty header value. Payloads below `min_bytes` are
    never revisits. Rows that repeat the largest id of a payload are all responses. An archive holds
    packed records up to `file_bytes`, and a longer record alone; a very long payload must fit a
    worker's memory. An empty table gives no record. Extra columns are not read. The date is a
    parameter, so that a rerun writes the same bytes. Up to `max_broadcast` revisits are known to
    every task; beyond that the bodies are joined to them by a shuffle, with the same result.
    """
    spark = captures.sparkSession
    scratch = Scratch(spark, "revisits")
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = captures.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("_uri"), text.alias("_body"))
    rows = rows.withColumns({"_sha1": F.sha1("_body"), "_bytes": F.octet_length("_body").cast("long")})
    revisits = resolve_revisits(captures, id_col, F.col(payload_col).cast("string"), min_bytes)
    revisits = scratch.stage(revisits.select("_id", "_sha1", "_bytes", "_keep", F.lit(True).alias("_again")), "revisits")
    if revisits.count() <= max_broadcast:
        revisits = F.broadcast(revisits)
    on = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._sha1") == F.col("b._sha1")) & (F.col("a._bytes") == F.col("b._bytes"))
    again = F.coalesce("b._again", F.lit(False))
    rows = rows.alias("a").join(revisits.alias("b"), on, "left").select("a._id", "a._uri", "a._sha1", "a._bytes", "b._keep", F.when(~again, F.col("a._body")).alias("_body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            # The writer ends a row with a zero byte, which is the last one of the closing record.
            packed = b"".join([*held, _closing(len(held), date)])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([packed[:-1]], pa.binary())], ["value"])

        for batch in batches:
            ids, uris, sha1s, sizes, keeps = (batch.column(i).to_pylist() for i in range(5))
            for i, uri in enumerate(uris):
                uri = uri.replace("\r", "%0D").replace("\n", "%0A")
                record = _record(ids[i], uri, sha1s[i], batch.column(5)[i].as_py(), sizes[i], keeps[i], date)
                if held and size + len(record) > file_bytes:
                    yield flush()
                    size = 0
                held.append(record)
                size += len(record)
        if held:
            yield flush()

    files = rows.mapInArrow(write, "value binary").selectExpr("CAST(value AS STRING) AS value")
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


class _Stream:
    """Reads gzip members piece by piece, so that only one record is held unpacked."""

    def __init__(self, packed: bytes, piece: int = 1 << 16):
        self.packed, self.at, self.piece, self.buf = memoryview(packed), 0, piece, bytearray()
        self.gzip = zlib.decompressobj(31)

    def _next(self) -> memoryview:
        feed = self.packed[self.at : self.at + self.piece]
        self.at += len(feed)
        return feed

    def more(self) -> bool:
        if self.gzip.eof:
            feed = self.gzip.unused_data or self._next()
            if not len(feed):
                return False
            self.gzip = zlib.decompressobj(31)
        else:
            feed = self.gzip.unconsumed_tail or self._next()
        got = self.gzip.decompress(feed, self.piece)
        if not len(feed) and not got and not self.gzip.eof:
            if self.at:
                raise ValueError("a WARC archive is cut short")
            return False
        self.buf += got
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (found := self.buf.find(mark, start)) < 0:
            start = max(0, len(self.buf) - len(mark) + 1)
            if not self.more():
                if self.buf:
                    raise ValueError("a WARC record is cut short")
                return None
        out = bytes(self.buf[:found])
        del self.buf[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self.more():
            pass
        if len(self.buf) < n:
            raise ValueError("a WARC record is cut short")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def parse_archive(packed: bytes) -> Iterator[dict]:
    """The responses and revisits of one archive of gzip members, with the payload's measured length and SHA-1.

    An archive that is cut short, or holds other than the number of records it states, raises ValueError.
    """
    stream, count = _Stream(packed), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends in two line breaks")
        if fields["warc-type"] not in ("response", "revisit"):
            if int(fields.get("x-records", count)) != count:
                raise ValueError("a WARC archive lacks records")
            continue
        count += 1
        payload = block.partition(b"\r\n\r\n")[2]
        own = fields["warc-type"] == "response"
        number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d+", fields.get(k, "")) else None
        yield {
            "record_id": fields["warc-record-id"], "warc_type": fields["warc-type"], "page_id": number("x-page-id"), "uri": fields.get("warc-target-uri", ""),
            "refers_to_id": fields.get("warc-refers-to"), "refers_to_page": number("x-refers-to-page-id"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
            "payload_bytes": len(payload) if own else None, "payload_sha1": hashlib.sha1(payload).hexdigest() if own else None,
        }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path`; a file is parsed in one task, record by record."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_parse_datatype_string(RECORD_SCHEMA))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                rows = []
                for row in parse_archive(packed.as_buffer()):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Revisit records joined to their responses: the payload's length and digest, for every record.

    `records` is read several times, so it should be a table. A revisit without a response among the
    records has neither length nor digest.
    """
    responses = records.filter("warc_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("_b"), F.col("payload_sha1").alias("_d")).dropDuplicates(["refers_to_id"])
    revisits = records.filter("warc_type = 'revisit'").withColumn("refers_to_id", F.coalesce("refers_to_id", F.lit(""))).drop("payload_bytes", "payload_sha1")
    known = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("_n")).join(responses, "refers_to_id", "left")
    revisits = join_groups(revisits, known, ["refers_to_id"], "_n", revisits.count()).drop("_n").withColumnsRenamed({"_b": "payload_bytes", "_d": "payload_sha1"})
    return records.filter("warc_type = 'response'").unionByName(revisits)

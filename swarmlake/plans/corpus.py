"""A deterministic catalog over the driver's tables, as DataFrames and as SQL for checking.

One torrent per order: the infohash is the SHA-1 of its key, the name a template around a part's
name, the time the order's date shifted to begin at 0, the files the order's lines. A second
catalog takes one torrent per document, with the text as its name and the lines of its number as files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import format as fmt

TEMPLATES = [
    ("", " S01E02 720p HDTV x264"), ("", " 2019 1080p BluRay x264 YIFY"), ("", " (1999)"), ("", " [DEADBEEF]"), ("[SubsPlease] ", " - 05 [1080p]"), ("Artist - ", " (2001) FLAC"),
    ("", " v1.2"), ("", " v1.2 x64"), ("", "-CODEX"), ("", " REPACK"), ("Photoshop CODEX ", " windows"), ("Learn ", " course linux"), ("", " unabridged audiobook"), ("", " epub"),
    ("xxx ", " S01E01"), ("xxx ", " S01E01 1080p"), ("xxx ", " GOG portable"), ("[judas] xxx ", " 1080p"), ("EP ", ""), ("", ""), ("", " season 3 complete series"),
    ("", " discography vinyl"), ("", " keygen windows"), ("", " isbn pdf pack"), ("udemy ", " tutorial"),
]
SHIFT = 788_918_400  # 1995-01-01 as time 0
FILE_EXT = [".mkv", ".mp3", ".pdf", ".exe", ".txt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unix_seconds(ts: Column) -> Column:
    """Seconds of a time without zone, whatever the session's zone."""
    return (F.unix_date(F.to_date(ts)) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))).cast("long")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the name of a part: what a torrent is made of, narrower than what is made of it."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    parts = max(1, p.count())
    cents = fmt.u48(F.round(F.col("o_totalprice") * 100))
    return o.join(p, F.col("p_partkey") == F.col("o_orderkey") % parts).select("o_orderkey", "p_name", cents.alias("size"), (unix_seconds(F.col("o_orderdate")) - SHIFT).alias("discovered_at"))


def _torrent() -> list[Column]:
    """infohash, name, size and discovered_at of the rows of `_named`."""
    k = (F.col("o_orderkey") % len(TEMPLATES)).cast("int")
    prefix, suffix = (F.get(F.array(*[F.lit(t[i]) for t in TEMPLATES]), k) for i in (0, 1))
    return [F.unhex(F.sha1(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))).alias("infohash"), F.concat(prefix, F.col("p_name"), suffix).alias("name"), F.col("size"), F.col("discovered_at")]


def torrents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """infohash, name, size, discovered_at, o_orderkey."""
    return _named(spark, sf_dir).select(*_torrent(), "o_orderkey")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, files: an order's lines by number, path and size. Lines are shuffled as rows, since a task has few lines of an order and its lists of them would be larger."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), "p_name", (F.col("l_partkey") % len(FILE_EXT)).cast("int").alias("ext"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size")
    )
    path = F.concat(F.col("p_name"), F.lit("/"), F.col("n").cast("string"), F.get(F.array(*map(F.lit, FILE_EXT)), F.col("ext")))
    grouped = lines.repartition("o_orderkey").groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", path.alias("path"), "size"))).alias("_f"))
    return grouped.select("o_orderkey", F.transform("_f", lambda f: F.struct(f["path"].alias("path"), f["size"].alias("size"))).alias("files"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full logical schema, with files. Hashes and names are made after the join, so that it shuffles neither."""
    none = F.array().cast("array<struct<path:string,size:long>>")
    return _named(spark, sf_dir).join(files(spark, sf_dir), "o_orderkey", "left").select(*_torrent(), F.coalesce("files", none).alias("files"))


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    none = F.array().cast("array<struct<path:string,size:long>>")
    return d.join(files(spark, sf_dir).withColumnRenamed("o_orderkey", "doc_id"), "doc_id", "left").select(
        F.unhex(F.sha1(F.concat(F.lit("d"), F.col("doc_id").cast("string")))).alias("infohash"), F.col("text").alias("name"), fmt.u48(F.col("n_chars")).alias("size"), (F.col("doc_id") * 97 % 5000).alias("discovered_at"),
        F.coalesce("files", none).alias("files"), "doc_id",
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing nodes, one per customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.sha1(F.concat(F.lit("c"), k.cast("string"))).alias("id"), F.concat_ws(".", F.lit("10"), (k % 7).cast("string"), (k % 251).cast("string"), F.lit("1")).alias("ip"), (1024 + k % 3).cast("int").alias("port"),
        (k * 7919 % 100000).alias("last_responded"), F.lit(False).alias("dropped"), (F.col("c_nationkey") % 3 == 0).alias("bep51"), (k * 31 % 5000).alias("next_at"), k.alias("insert_seq"),
    )


def _sql_templates() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(TEMPLATES))


SQL = f"""templates(k, prefix, suffix) AS (VALUES {_sql_templates()}),
torrents AS (SELECT sha1('o' || o_orderkey) AS infohash, prefix || p_name || suffix AS name, CAST(round(o_totalprice * 100) AS BIGINT) & 281474976710655 AS size,
    CAST(epoch(o_orderdate) AS BIGINT) - {SHIFT} AS discovered_at, o_orderkey
    FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT greatest(1, count(*)) FROM part) JOIN templates ON k = o_orderkey % {len(TEMPLATES)}),
docs AS (SELECT sha1('d' || doc_id) AS infohash, text AS name, n_chars & 281474976710655 AS size, doc_id * 97 % 5000 AS discovered_at, doc_id FROM documents),
listed AS (SELECT l_orderkey, '[' || string_agg('{{"path":"' || path || '","size":' || size || '}}', ',' ORDER BY l_linenumber, path, size) || ']' AS files FROM (SELECT l_orderkey, l_linenumber,
    p_name || '/' || l_linenumber || ['.mkv', '.mp3', '.pdf', '.exe', '.txt'][l_partkey % 5 + 1] AS path, CAST(round(l_extendedprice * 100) AS BIGINT) AS size FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey),
nodes AS (SELECT sha1('c' || c_custkey) AS id, '10.' || (c_custkey % 7) || '.' || (c_custkey % 251) || '.1' AS ip, CAST(1024 + c_custkey % 3 AS INTEGER) AS port, c_custkey * 7919 % 100000 AS last_responded,
    false AS dropped, c_nationkey % 3 = 0 AS bep51, c_custkey * 31 % 5000 AS next_at, c_custkey AS insert_seq FROM customer)"""

"""Catalog operators: first-write-wins upsert, listings, statistics, cursors.

Tables are immutable snapshots. An upsert is an anti-join on the key and an append; both sides
shuffle on the infohash only, and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import format as fmt
from ..functions.classify import label, with_category
from ..functions.text import index_tokens
from ..schema import CODE, ENTRY, RECENT_PAGE

FILES = ENTRY["files"].dataType


def first_arrivals(incoming: DataFrame, order: Column, key: str = "infohash") -> DataFrame:
    """The first row of each key, in one pre-aggregated shuffle instead of a window over each key."""
    rest = [c for c in incoming.columns if c != key]
    picked = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(key, "_row.*").select(*incoming.columns)


def absent(first: DataFrame, keys: DataFrame, first_bytes: list[bytes], few: bool) -> DataFrame:
    """Rows of distinct hashes that are not among stored keys, which are sorted by hash; no null hash is stored.

    Of the keys only those that begin with one of `first_bytes` are read. If the rows are `few`, their hashes are broadcast
    and the stored side stays where it is; what it has of them is as few again.
    """
    if not first_bytes:
        return first
    end = lambda b: F.lit(True) if b == b"\xff" else F.col("infohash") < F.lit(bytes([b[0] + 1]))
    if len(first_bytes) <= 32:
        inside = F.lit(False)
        for b in first_bytes:
            inside = inside | ((F.col("infohash") >= F.lit(b)) & end(b))
    else:
        inside = (F.col("infohash") >= F.lit(first_bytes[0])) & end(first_bytes[-1])
    keys = keys.select("infohash").filter(inside)
    if few:
        keys = F.broadcast(keys.join(F.broadcast(first.select("infohash")), "infohash", "left_semi"))
    return first.join(keys, "infohash", "left_anti")


def placed(rows: DataFrame, places: DataFrame, bits: bool) -> DataFrame:
    """Rows whose place `_id` is among `places`, which are distinct. With `bits` no row is shuffled: places are broadcast as bitmaps, a bit for each row."""
    if not bits:
        return rows.join(places, "_id", "left_semi")
    at, bit = F.col("_id") + 1, F.bitmap_bit_position(F.col("_id") + 1)  # buckets are counted from 1
    maps = places.select(F.bitmap_bucket_number(at).alias("_bucket"), bit.alias("_bit")).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), (F.bitmap_bucket_number(at) == F.col("_bucket")) & (F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1), "left_semi")


def new_entries(stored: DataFrame, incoming: DataFrame, order: Column) -> DataFrame:
    """Rows that an upsert adds: first arrivals whose key is not stored."""
    return first_arrivals(incoming, order).join(stored.select("infohash"), "infohash", "left_anti")


def upsert_first_wins(stored: DataFrame, incoming: DataFrame, order: Column) -> DataFrame:
    """The catalog after the upsert; stored rows always win."""
    return stored.unionByName(new_entries(stored, incoming, order).select(*stored.columns))


def classify(entries: DataFrame) -> DataFrame:
    return with_category(entries).select("infohash", "category")


def classified(entries: DataFrame) -> DataFrame:
    """Stored categories, which keep the time, as they are sorted and cut by it."""
    return with_category(entries).select("infohash", "category", "discovered_at")


def postings(entries: DataFrame) -> DataFrame:
    """Inverted index: distinct (token, infohash), with the entry's time."""
    return entries.select(F.explode(index_tokens(F.col("name"))).alias("token"), "discovered_at", "infohash")


def category_stats(categories: DataFrame) -> DataFrame:
    """Counts of classified rows; empty categories are absent."""
    return categories.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def unclassified(entries: DataFrame, categories: DataFrame) -> DataFrame:
    return entries.join(categories.select("infohash"), "infohash", "left_anti")


def category_filter(name: str | None) -> int | None:
    """Code of an exact lower-case label; any other value filters nothing."""
    return CODE.get(name) if name else None


def listing(entries: DataFrame) -> DataFrame:
    """Output columns of a result row; entries that are stored without files have none."""
    files = F.col("files") if "files" in entries.columns else F.lit(None)
    return entries.select(
        fmt.hex_lower(F.col("infohash")).alias("infohash"), "name", "size", label(F.coalesce(F.col("category").cast("int"), F.lit(0))).alias("category"), fmt.to_unix(F.col("discovered_at")).alias("discovered_at"),
        F.coalesce(files.cast(FILES), F.array().cast(FILES)).alias("files"),
    )


def newest_first() -> list[Column]:
    return [F.desc("discovered_at"), F.desc("infohash")]


Bounds = Iterable[int | None]


def newest(keys_since: Callable[[int | None], DataFrame], bounds: Bounds, offset: int, limit: int) -> list[tuple[int, bytes]]:
    """Keys (time, hash) of a page, newest first: of what is newer than the first bound, if that fills the page, else than the next.

    No more than the page's rows come to the driver.
    """
    for since in bounds:
        got = keys_since(since).select("discovered_at", "infohash").orderBy(*newest_first()).offset(offset).limit(limit).collect()
        if len(got) == limit or since is None:
            return [(r["discovered_at"], bytes(r["infohash"])) for r in got]
    return []


def since_time(rows: DataFrame, since: int | None) -> DataFrame:
    return rows if since is None or "discovered_at" not in rows.columns else rows.filter(F.col("discovered_at") >= since)


def page(keys: list[tuple[int, bytes]], entries: DataFrame, categories: DataFrame) -> DataFrame:
    """Result rows, newest first, of a page's few keys, which reach the scans as literals: names, files and categories are read near them alone."""

    def of(rows: DataFrame) -> DataFrame:
        hashes = F.col("infohash").isin([k[1] for k in keys]) if keys else F.lit(False)
        if keys and "discovered_at" in rows.columns:
            hashes = hashes & F.col("discovered_at").between(min(k[0] for k in keys), max(k[0] for k in keys))
        return rows.filter(hashes)

    rows = of(entries).join(F.broadcast(of(categories).select("infohash", "category")), "infohash", "left")
    return listing(rows).repartition(1).sortWithinPartitions(*newest_first())


def recent(entries: DataFrame, categories: DataFrame, category: str | None = None, offset: int = 0, limit: int = RECENT_PAGE, bounds: Bounds = (None,)) -> DataFrame:
    """Newest entries. With a category, entries that are not classified count as `other`.

    The page is cut on keys, and only its rows are read whole. `bounds` are times to look behind first (see `newest`).
    """
    return page(newest(lambda since: listed(entries, categories, category, since), bounds, offset, limit), entries, categories)


def listed(entries: DataFrame, categories: DataFrame, category: str | None = None, since: int | None = None) -> DataFrame:
    """Keys of a listing in no order."""
    code = category_filter(category)
    rows = since_time(entries.select("infohash", "discovered_at"), since)
    if code is None:
        return rows
    codes = since_time(categories, since).select("infohash", "category")
    return rows.join(codes, "infohash", "left").filter(F.coalesce(F.col("category"), F.lit(0)) == code)


def all_pages(at: Callable[[int], DataFrame], limit: int = RECENT_PAGE) -> Iterator[DataFrame]:
    """Pages, each by its offset, as a scrolling client asks for them: the next one until one has fewer rows than a page."""
    offset = 0
    while True:
        one = at(offset)
        yield one
        if one.count() < limit:
            return
        offset += limit


def numbered(rows: DataFrame, path: str, *order: Column) -> DataFrame:
    """Rows with `n`, their place in an order, from 0 on: sorted in ranges and stored once, so that ranges stay as they are.

    Of each range its number of rows comes to the driver.
    """
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    held = rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("_id", T.LongType())])).parquet(path)
    part = F.shiftright("_id", 33)
    before, starts = 0, []
    for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        starts.append((r["p"], before))
        before += r["n"]
    at = F.broadcast(rows.sparkSession.createDataFrame(starts, "_p long, _start long"))
    return held.join(at, part == F.col("_p")).withColumn("n", F.col("_start") + F.col("_id") - F.shiftleft(part, 33)).drop("_id", "_p", "_start")


def paged(rows: DataFrame, path: str, limit: int = RECENT_PAGE) -> DataFrame:
    """Keys with `page`, the number of the page that shows them: all pages at once, where `all_pages` looks from the newest entry on for each."""
    return numbered(rows.select("discovered_at", "infohash"), path, *newest_first()).withColumn("page", F.floor(F.col("n") / limit))


def unseen(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows of a page that were not shown before, as pages shift while entries arrive."""
    return rows.join(shown.select("infohash"), "infohash", "left_anti")


def point_lookup(entries: DataFrame, categories: DataFrame, infohash: str) -> DataFrame:
    """The entry of a hash given in hex; the output keeps the caller's letter case.

    Raises ValueError for text that is not the hex form of 20 bytes.
    """
    try:
        raw = bytes.fromhex(infohash)
    except ValueError:
        raw = b""
    if len(raw) != 20:
        raise ValueError("invalid infohash")
    match = F.col("infohash") == F.lit(raw)  # reaches the scan of a stored catalog
    rows = entries.filter(match).join(categories.filter(match).select("infohash", "category"), "infohash", "left")
    return listing(rows).withColumn("infohash", F.lit(infohash))


def entries_since(entries: DataFrame, since: int) -> DataFrame:
    """Inclusive cursor scan in time order; the all-zero hash at exactly `since` is skipped, unless that is 0."""
    keep = F.col("discovered_at") >= since
    if since:
        keep = keep & ~((F.col("discovered_at") == since) & (F.col("infohash") == F.lit(bytes(20))))
    return entries.filter(keep)


def entries_after(entries: DataFrame, discovered_at: int, infohash: bytes, limit: int | None = None) -> DataFrame:
    """Exclusive keyset page after (discovered_at, infohash) in time order."""
    t = F.col("discovered_at")
    rows = entries.filter((t >= discovered_at) & ((t > discovered_at) | (F.col("infohash") > F.lit(infohash)))) if discovered_at or any(infohash) else entries
    rows = rows.orderBy("discovered_at", "infohash")
    return rows if limit is None else rows.limit(limit)


def latest_timestamp(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.max("discovered_at"), F.lit(0)).cast("long").alias("latest"))

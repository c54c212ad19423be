"""A stored catalog: entries, their keys, categories and postings under one path.

A table is a set of folders. A commit writes new folders and then a manifest, one small JSON file with
the next version number that names the folders of all tables; the highest number is the current state.
So a reader sees one state of all tables, while a commit runs or after it failed, and increments only
append. One writer at a time commits; a second one that took the same number fails.

Beside folders a manifest holds what spares readers a scan: the number of entries and of each category, and for
each folder of entries 65 times that cut its rows into equal parts. Which files of entries are classified is kept
by name, so that an increment reads the others only. Layouts are Spark's: entries and categories are
sorted by time, postings by token and time, keys by hash (an increment's categories and postings within each file only, as they are
written where their entries lie, and `compact` makes ranges of them), with Bloom filters of hashes, so that bounds given as
literals skip row groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.format import sync_state
from .operators import catalog, search
from .schema import CATEGORIES, DISPLAY_ORDER, ENTRY, POSTING_CAP, RECENT_PAGE, SEARCH_DEFAULT

TABLES = {
    "entries": ENTRY, "keys": "infohash binary", "categories": "infohash binary, category tinyint, discovered_at long", "postings": "token string, discovered_at long, infohash binary",
}
ORDER = {"entries": ("discovered_at", "infohash"), "keys": ("infohash",), "categories": ("discovered_at", "infohash"), "postings": ("token", "discovered_at", "infohash")}
ROW_GROUP = 16 << 20  # bytes
CUTS = 64
BROADCAST_KEYS = 200_000  # incoming hashes that are sent to the stored keys, of 20 bytes each
BROADCAST_BITS = 64 << 20  # bytes of bits that tell which of the incoming rows are new


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._at)] if self._fs.exists(self._at) else []

    def state(self) -> dict:
        """The current manifest: version, tables (folders by name), meta (numbers by name)."""
        versions = sorted(n for n in self._names() if n.startswith("manifest-"))
        if not versions:
            return {"version": 0, "tables": {t: [] for t in TABLES}, "meta": {}, "entries": {}, "classified": {}, "counts": {}, "loose": False}
        stream = self._fs.open(self._file(versions[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict, **changes) -> None:
        new = state | changes | {"version": state["version"] + 1}
        name, draft = f"manifest-{new['version']:012d}", self._file(f"_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(json.dumps(new).encode())
        finally:
            stream.close()
        if self._fs.exists(self._file(name)) or not self._fs.rename(draft, self._file(name)):
            raise RuntimeError(f"version {new['version']} was committed by another writer")

    def read(self, table: str) -> DataFrame:
        """A table's rows; one that was never written is empty."""
        return self._read(table, self.state()["tables"][table])

    def _read(self, table: str, names: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], TABLES[table])

    def _write(self, table: str, rows: DataFrame, partitions: int | None = None, in_place: bool = False) -> str:
        """A new folder. Rows `in_place` stay in their tasks: what is made of stored entries is near in time already, and ranges would make it twice, once to sample."""
        name, order = f"{table}-{uuid.uuid4().hex}", ORDER[table]
        dealt = rows if in_place else rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
        out = dealt.sortWithinPartitions(*order).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
        if table in ("entries", "keys", "categories"):
            out = out.option("parquet.bloom.filter.enabled#infohash", True).option("parquet.bloom.filter.adaptive.enabled", True)
        out.parquet(f"{self.path}/{name}")
        return name

    def _described(self, folder: str) -> dict:
        """Of a folder of entries the number of rows, and times that cut them into equal parts."""
        share = [k / CUTS for k in range(CUTS + 1)]
        r = self._read("entries", [folder]).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("discovered_at", share, 10_000).alias("cuts")).first()
        return {"rows": r["n"], "cuts": list(r["cuts"] or [])}

    def bounds(self, rows: int) -> list[int | None]:
        """Times from the newest back; behind the first there are about twice as many entries as `rows`, behind each next one eight times more.

        The last is None. A page reads what is newer than the first, and goes on to the next if that is too little.
        """
        parts = [d for d in self.state()["entries"].values() if d["rows"]]
        times = sorted({t for d in parts for t in d["cuts"]}, reverse=True)
        behind = lambda t: sum(d["rows"] * sum(c >= t for c in d["cuts"]) / len(d["cuts"]) for d in parts)
        out: list[int | None] = []
        want = 2 * max(1, rows)
        for t in times:
            n = behind(t)
            if n >= want:
                out.append(t)
                while n >= want:
                    want *= 8
        return [*out, None]

    def _write_computed(self, table: str, rows: DataFrame) -> str:
        """A new folder of rows that take work: it is done once, in as many tasks as the session has room for, and ranges are cut on its outcome."""
        draft = f"{self.path}/_incoming-{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        try:
            return self._write(table, self.spark.read.schema(TABLES[table]).parquet(draft))
        finally:
            self._fs.delete(self._file(draft.rpartition("/")[2]), True)

    def spread(self, rows: DataFrame) -> DataFrame:
        """Rows dealt to all cores, whatever few bytes they have, for work that counts by row."""
        return rows.repartition(4 * self.spark.sparkContext.defaultParallelism)

    def replace(self, **tables: DataFrame | Callable[[DataFrame], DataFrame]) -> None:
        """Takes whole tables as they are, all in one commit. One may be a function of the entries, which then gets them as they are stored."""
        state, written = self.state(), {}
        if "entries" in tables:
            written["entries"] = [self._write("entries", tables["entries"])]
        entries = self._read("entries", written.get("entries", state["tables"]["entries"]))
        if "entries" in tables:
            written["keys"] = [self._write("keys", entries.select("infohash"))]
        for t, rows in tables.items():
            if t == "postings" and callable(rows):
                written[t] = [self._write(t, rows(entries), in_place=True)]
            elif t != "entries":
                written[t] = [self._write_computed(t, rows(entries)) if callable(rows) else self._write(t, rows)]
        changes = {"tables": state["tables"] | written}
        if "entries" in tables:
            (folder,) = written["entries"]
            changes |= {"entries": {folder: self._described(folder)}, "classified": {}}
        if "categories" in tables:
            changes |= {"counts": self._counted(written["categories"]), "loose": True}
        self._commit(state, **changes)

    def _counted(self, folders: list[str]) -> dict[str, int]:
        return {str(r["category"]): r["n"] for r in catalog.category_stats(self._read("categories", folders)).collect()}

    def add(self, incoming: DataFrame, order=None) -> int:
        """First write wins; the number of rows that were new.

        The incoming rows are written once. Up to BROADCAST_KEYS of them, their hashes go to the stored keys, of which only the
        range of the incoming first bytes is read. Of more rows, hashes alone are shuffled (`_new_keys`), and rows stay where
        they were written: a new one is told by a bit for its place.
        """
        state = self.state()
        draft = f"{self.path}/_incoming-{uuid.uuid4().hex}"
        rows = incoming.select(*ENTRY.fieldNames(), (F.col("discovered_at") if order is None else order).alias("_order")).withColumn("_id", F.monotonically_increasing_id())
        rows.write.option("compression", "zstd").parquet(draft)
        held = self.spark.read.schema(rows.schema).parquet(draft)
        try:
            n, low, high = held.agg(F.count(F.lit(1)), F.min("infohash"), F.max("infohash")).first()
            if n <= BROADCAST_KEYS:
                folder = self._write("entries", self.unknown(catalog.first_arrivals(held, F.struct(*self._first())).select(*ENTRY.fieldNames())))
                keys = None
            else:
                keys = self._write("keys", self._new_keys(held, low, high), in_place=True)
                new = self.spark.read.schema("_id long").parquet(f"{self.path}/{keys}")
                bits = n // 8 + len(self._names_in(draft.rpartition("/")[2])) * 4096 <= BROADCAST_BITS
                folder = self._write("entries", catalog.placed(held, new, bits).select(*ENTRY.fieldNames()), in_place=True)
            known = self._described(folder)
            if known["rows"] or not state["tables"]["entries"]:
                keys = keys or self._write("keys", self._read("entries", [folder]).select("infohash"))
                tables = state["tables"] | {"entries": [*state["tables"]["entries"], folder], "keys": [*state["tables"].get("keys", []), keys]}
                self._commit(state, tables=tables, entries=state["entries"] | {folder: known})
        finally:
            self._fs.delete(self._file(draft.rpartition("/")[2]), True)
        return known["rows"]

    def _first(self) -> list:
        """Of the rows of a hash one without an order comes last, of equal ones the first in place."""
        return [F.col("_order").isNull().alias("_last"), F.col("_order"), F.col("_id")]

    def _new_keys(self, held: DataFrame, low: bytes | None, high: bytes | None) -> DataFrame:
        """Hashes that are not stored, with the place `_id` of the first row of each, in ranges of hashes: one shuffle of hashes, orders and places, and of the stored keys between two hashes."""
        none = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("_order", "_id")]
        stored = self.read("keys").filter(F.col("infohash").between(F.lit(low), F.lit(high))).select("infohash", *none)
        dealt = held.select("infohash", "_order", "_id").unionByName(stored).repartitionByRange("infohash")
        first = F.min(F.struct(F.col("_id").isNotNull().alias("new"), *self._first()))  # a stored key comes before all
        return dealt.groupBy("infohash").agg(first.alias("_first")).filter("_first.new").select("infohash", "_first._id")

    def unknown(self, first: DataFrame) -> DataFrame:
        """Rows of distinct hashes that are not stored yet."""
        bytes_ = first.groupBy(F.substring("infohash", 1, 1).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # 256 rows at most
        return catalog.absent(first, self.read("keys"), sorted(bytes(r["b"]) for r in bytes_ if r["b"] is not None), sum(r["n"] for r in bytes_) <= BROADCAST_KEYS)

    def _open_files(self, state: dict) -> list[str]:
        """Files of entries that are not classified, by folder and name."""
        out = []
        for folder in state["tables"]["entries"]:
            done = state["classified"].get(folder, [])
            if done is not True:
                out += [f"{folder}/{n}" for n in self._names_in(folder) if n not in done]
        return out

    def _names_in(self, folder: str) -> list[str]:
        return [n for x in self._fs.listStatus(self._file(folder)) if (n := x.getPath().getName()).endswith(".parquet")]

    def _classified(self, state: dict, todo: DataFrame, classified: dict, fresh: bool = False) -> int:
        """Commits categories and postings of entries; `fresh` forgets the earlier ones. Returns the number of entries."""
        codes = self._write("categories", catalog.classified(todo), in_place=True)
        index = self._write("postings", catalog.postings(todo), in_place=True)
        new = self._counted([codes])
        latest = self._read("categories", [codes]).agg(F.max("discovered_at")).first()[0]
        old = {"categories": [], "postings": []} if fresh else state["tables"]
        counts = {} if fresh else dict(state["counts"])
        for code, n in new.items():
            counts[code] = counts.get(code, 0) + n
        meta = state["meta"] | ({"classifier_ts": max(latest, 0 if fresh else state["meta"].get("classifier_ts", 0))} if latest is not None else {})
        tables = state["tables"] | {"categories": [*old["categories"], codes], "postings": [*old["postings"], index]}
        self._commit(state, tables=tables, meta=meta, classified=classified, counts=counts, loose=state["loose"] and not fresh)
        return sum(new.values())

    def classify(self, full: bool = False) -> int:
        """Categories and postings of the entries in files that have none yet, or of all; both appear in one commit with the watermark."""
        state = self.state()
        files = state["tables"]["entries"] if full else self._open_files(state)
        todo = self._read("entries", files)
        if state["loose"] and not full:  # categories that came by `replace` are of no known file
            todo = self.spread(catalog.unclassified(todo, self.read("categories")))
        if not files and not full:
            return 0
        return self._classified(state, todo, {f: True for f in state["tables"]["entries"]}, full)

    def classify_files(self, batch: DataFrame) -> int:
        """Classifies a micro-batch of `stream`, rows with their file in `_file`: the batch alone is read. Files that are classified add nothing."""
        state = self.state()
        paths = [r["_file"] for r in batch.select("_file").distinct().collect()]  # as many as the stream's limit of files
        part = lambda p: tuple(p.rsplit("/", 2)[1:])
        marks = state["classified"]
        new = [p for p in paths if (own := marks.get(part(p)[0], [])) is not True and part(p)[1] not in own]
        if not new:
            return 0
        grown = dict(marks)
        for folder, name in map(part, new):
            grown[folder] = [*grown.get(folder, []), name]
        return self._classified(state, batch.filter(F.col("_file").isin(new)).drop("_file"), grown)

    def drop_classification(self) -> None:
        """Forgets categories, postings and the watermark; entries stay."""
        state = self.state()
        meta = {k: v for k, v in state["meta"].items() if k != "classifier_ts"}
        self._commit(state, tables=state["tables"] | {"categories": [], "postings": []}, meta=meta, classified={}, counts={}, loose=False)

    def compact(self, partitions: int | None = None, reclaim: bool = True) -> int:
        """Rewrites each table as one folder in its order, entries that are not classified yet as another; the bytes saved.

        `reclaim` then deletes all folders and manifests that are no longer current, so no reader of an
        older state may be at work.
        """
        state, before = self.state(), self.size()
        todo = self._open_files(state)
        done = [f"{f}/{n}" for f in state["tables"]["entries"] for n in self._names_in(f) if f"{f}/{n}" not in set(todo)]
        tables = {t: [self._write(t, self.read(t), partitions)] if state["tables"][t] else [] for t in TABLES if t != "entries"}
        parts = {self._write("entries", self._read("entries", files), partitions): mark for files, mark in ((done, True), (todo, [])) if files}
        described = {f: self._described(f) for f in parts}
        self._commit(state, tables=tables | {"entries": list(parts)}, entries=described, classified={f: m for f, m in parts.items() if m})
        if reclaim:
            self.reclaim()
        return before - self.size()

    def reclaim(self) -> None:
        state = self.state()
        live = {f for folders in state["tables"].values() for f in folders} | {f"manifest-{state['version']:012d}"}
        for name in self._names():
            if name not in live and name.startswith(("manifest-", "_draft-", "_incoming-", *(f"{t}-" for t in TABLES))):
                self._fs.delete(self._file(name), True)

    def size(self) -> int:
        """Bytes of everything that is stored."""
        return self._fs.getContentSummary(self._at).getLength() if self._fs.exists(self._at) else 0

    def meta(self, key: str) -> int:
        """A stored 32-bit number; 0 if there is none."""
        return int(self.state()["meta"].get(key, 0))

    def set_meta(self, key: str, value: int) -> None:
        state = self.state()
        self._commit(state, meta=state["meta"] | {key: value & 0xFFFFFFFF})

    def total(self) -> int:
        return sum(d["rows"] for d in self.state()["entries"].values())

    def latest(self) -> int:
        """The newest entry's time, 0 if there is none."""
        return max((d["cuts"][-1] for d in self.state()["entries"].values() if d["rows"]), default=0)

    def stats(self, sync_code: int = 0) -> DataFrame:
        """total, db_size (bytes stored), categories (a map of the counts of those that have any, in display order) and sync. No table is read."""
        counts = self.category_counts()
        shown = {c: counts[c] for c in DISPLAY_ORDER if c in counts}
        row = self.spark.createDataFrame([(self.total(), self.size(), list(shown.items()))], "total long, db_size long, categories array<struct<label:string,n:long>>")
        return row.select("total", "db_size", F.map_from_entries("categories").alias("categories"), sync_state(F.lit(sync_code)).alias("sync"))

    def category_counts(self) -> dict[str, int]:
        """Classified entries by label; codes without a label count as `other`."""
        out: dict[str, int] = {}
        for code, n in self.state()["counts"].items():
            name = CATEGORIES[int(code)] if 0 <= int(code) < len(CATEGORIES) else "other"
            out[name] = out.get(name, 0) + n
        return out

    def recent(self, category: str | None = None, offset: int = 0, limit: int = RECENT_PAGE) -> DataFrame:
        return catalog.recent(self.read("entries"), self.read("categories"), category, offset, limit, self.bounds(offset + limit))

    def pages(self, path: str, category: str | None = None, limit: int = RECENT_PAGE) -> DataFrame:
        """The keys of all pages of a listing, with their page and place; `path` is a new folder for them."""
        return catalog.paged(catalog.listed(self.read("entries"), self.read("categories"), category), path, limit)

    def search(self, text: str, category: str | None = None, limit: int = SEARCH_DEFAULT, offset: int = 0, cap: int | None = POSTING_CAP, strict_stopwords: bool = True) -> DataFrame:
        return search.search(self.read("entries"), self.read("categories"), self.read("postings"), text, category, limit, offset, cap, strict_stopwords, self.bounds(64 * (offset + limit)))

    def stream(self, table: str, files_per_batch: int) -> DataFrame:
        """A table's files as a stream, a bounded number in each micro-batch, as they are committed; `_file` names a row's."""
        rows = self.spark.readStream.schema(TABLES[table]).option("maxFilesPerTrigger", files_per_batch).parquet(f"{self.path}/{table}-*")
        return rows.select("*", F.col("_metadata.file_path").alias("_file"))


Sink = Callable[[DataFrame, int], None]


def classifier(store: Store) -> Sink:
    """For foreachBatch over new entries (`stream`): classifies the batch. The stream's checkpoint is the cursor, and a replayed batch adds nothing."""

    def run(batch: DataFrame, number: int) -> None:
        store.classify_files(batch)

    return run

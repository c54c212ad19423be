"""Registered queries of the catalog engine, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as cls
from ..functions import format as fmt
from ..functions.text import STOPWORDS
from ..operators import catalog, routing
from ..schema import CATEGORIES, DISPLAY_ORDER
from ..sources import codecs, datasource
from ..store import Store
from ..streaming import ingest
from . import corpus
from .base import ORACLE_SQL, QUERIES, query, scratch  # noqa: F401  the first two are the driver's

# Parts of the checking SQL.
CLASSIFIED = f"cat AS ({cls.category_sql('torrents', 'infohash')}), known AS (SELECT * FROM cat JOIN (SELECT infohash, o_orderkey FROM torrents) USING (infohash) WHERE o_orderkey % 10 <> 3)"
LABELS = "lab(code, label) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES)) + ")"
ROW = "infohash, name, size, coalesce(label, 'other') AS category, discovered_at + 1577836800 AS discovered_at, coalesce(files, '[]') AS files"
FROM = "FROM torrents LEFT JOIN known USING (infohash) LEFT JOIN lab ON code = category LEFT JOIN listed ON l_orderkey = torrents.o_orderkey"
TOKENS = "tok AS (SELECT DISTINCT infohash, token FROM (SELECT infohash, unnest(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]')) AS token FROM docs) WHERE strlen(token) >= 2 AND token NOT IN (" + ", ".join(f"'{w}'" for w in STOPWORDS) + "))"


_stores: dict[tuple[str, str, str], Store] = {}


def _stored(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[Store], None]) -> Store:
    """A stored catalog, made once for a session and a folder of tables; the listings read it."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _stores:
        store = Store(spark, scratch(spark, kind))
        build(store)
        _stores[key] = store
    return _stores[key]


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """The torrents; every tenth is not classified yet."""

    def build(store: Store) -> None:
        known = corpus.torrents(spark, sf_dir).filter("o_orderkey % 10 <> 3").select("infohash")
        codes = lambda entries: catalog.classified(store.spread(entries.select("infohash", "name", "discovered_at").join(known, "infohash", "left_semi")))
        store.replace(entries=corpus.entries(spark, sf_dir), categories=codes)

    return _stored(spark, sf_dir, "torrents", build)


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    store = _store(spark, sf_dir)
    return store.read("entries"), store.read("categories")


def _documents(spark: SparkSession, sf_dir: str) -> Store:
    """Documents as entries, with codes for most of them and postings of all their tokens."""

    def build(store: Store) -> None:
        codes = lambda d: d.filter("size % 4 <> 1").select("infohash", (F.col("size") % 11).cast("tinyint").alias("category"), "discovered_at")
        store.replace(entries=corpus.document_entries(spark, sf_dir).drop("doc_id"), categories=codes, postings=catalog.postings)

    return _stored(spark, sf_dir, "documents", build)


def _shown(rows: DataFrame) -> DataFrame:
    """Result rows with their files as JSON."""
    return rows.withColumn("files", F.to_json("files"))


DOC_CODES = "dcat AS (SELECT infohash, size % 11 AS category FROM docs WHERE size % 4 <> 1)"


def _search_sql(tokens: list[str], where: str = "true", limit: int = 20, offset: int = 0, cap: int | None = None) -> str:
    source = "tok" if cap is None else f"(SELECT * FROM tok WHERE token IN ({', '.join(map(repr, tokens))}) QUALIFY row_number() OVER (PARTITION BY token ORDER BY infohash) <= {cap})"
    return f""", {TOKENS}, {LABELS}, {DOC_CODES}, hit AS (SELECT infohash FROM {source} WHERE token IN ({", ".join(map(repr, tokens))}) GROUP BY infohash HAVING count(DISTINCT token) = {len(tokens)})
        SELECT {ROW} FROM docs JOIN hit USING (infohash) LEFT JOIN dcat USING (infohash) LEFT JOIN lab ON code = category LEFT JOIN listed ON l_orderkey = doc_id WHERE {where}
        ORDER BY docs.discovered_at DESC, infohash DESC LIMIT {limit} OFFSET {offset}"""


# --- text and classifier


@query(f", {TOKENS} SELECT infohash, token FROM tok")
def tokenize(spark, sf_dir):
    return catalog.postings(corpus.document_entries(spark, sf_dir)).select(fmt.hex_lower(F.col("infohash")).alias("infohash"), "token")


@query(f", {TOKENS} SELECT token, count(*)::BIGINT AS df FROM tok GROUP BY token")
def token_df(spark, sf_dir):
    return catalog.postings(corpus.document_entries(spark, sf_dir)).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query(" SELECT infohash, " + ", ".join(f"{s} AS s{i}" for i, s in enumerate(cls.scores_sql("name"))) + " FROM torrents")
def classify_scores(spark, sf_dir):
    s = corpus.torrents(spark, sf_dir).withColumn("gate", cls.possible(F.col("name"))).withColumn("s", cls.scores(F.col("name"), F.col("gate")))
    return s.select(fmt.hex_lower(F.col("infohash")).alias("infohash"), *[F.col("s")[i].alias(f"s{i}") for i in range(11)])


@query(f", {CLASSIFIED} SELECT infohash, category FROM cat")
def classify(spark, sf_dir):
    return catalog.classify(corpus.torrents(spark, sf_dir)).withColumn("infohash", fmt.hex_lower(F.col("infohash")))


@query(f", {CLASSIFIED} SELECT category, count(*)::BIGINT AS n FROM cat GROUP BY category")
def reclassify_full(spark, sf_dir):
    return catalog.category_stats(catalog.classify(corpus.torrents(spark, sf_dir)))


@query(f", {CLASSIFIED} SELECT infohash, category FROM cat WHERE infohash NOT IN (SELECT infohash FROM known)")
def classify_incremental(spark, sf_dir):
    t, known = _catalog(spark, sf_dir)
    return catalog.classify(catalog.unclassified(t, known)).withColumn("infohash", fmt.hex_lower(F.col("infohash")))


@query(f", {LABELS} SELECT k AS code, coalesce(label, 'other') AS label FROM (SELECT DISTINCT l_linenumber + 5 AS k FROM lineitem) LEFT JOIN lab ON code = k")
def category_label(spark, sf_dir):
    codes = corpus.table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") + 5).alias("code")).distinct()
    return codes.select("code", cls.label(F.col("code")).alias("label"))


@query(
    ", ext(e, c, w) AS (VALUES " + ", ".join(f"('{e}', '{c}', {w}::DOUBLE)" for e, m in cls.EXTENSIONS.items() for c, w in m.items()) + ")"
    " SELECT c AS category, count(*)::BIGINT AS n, round(sum(w), 4) AS weight FROM lineitem JOIN ext ON e = ['.mkv', '.mp3', '.pdf', '.exe', '.txt'][l_partkey % 5 + 1] GROUP BY c"
)
def ext_weights(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, corpus.FILE_EXT)), (F.col("l_partkey") % 5).cast("int"))
    weights = spark.createDataFrame([(e, c, w) for e, m in cls.EXTENSIONS.items() for c, w in m.items()], "e string, category string, w double")
    lines = corpus.table(spark, sf_dir, "lineitem").select(ext.alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("k"))
    return lines.join(F.broadcast(weights), "e").groupBy("category").agg(F.sum("k").alias("n"), F.round(F.sum(F.col("k") * F.col("w")), 4).alias("weight"))


# --- listings and statistics


@query(f", {CLASSIFIED}, {LABELS} SELECT {ROW} {FROM} ORDER BY torrents.discovered_at DESC, infohash DESC LIMIT 50")
def recent(spark, sf_dir):
    return _shown(_store(spark, sf_dir).recent())


@query(f", {CLASSIFIED}, {LABELS} SELECT {ROW} {FROM} ORDER BY torrents.discovered_at DESC, infohash DESC LIMIT 50 OFFSET 50")
def recent_page2(spark, sf_dir):
    return _shown(_store(spark, sf_dir).recent(offset=50))


@query(f", {CLASSIFIED}, {LABELS} SELECT {ROW} {FROM} WHERE coalesce(category, 0) = 0 ORDER BY torrents.discovered_at DESC, infohash DESC LIMIT 50")
def recent_by_category(spark, sf_dir):
    return _shown(_store(spark, sf_dir).recent("other"))


@query(" SELECT count(*)::BIGINT AS total FROM torrents")
def stats_total(spark, sf_dir):
    return _store(spark, sf_dir).stats().select("total")


@query(f", {CLASSIFIED}, {LABELS} SELECT label AS category, count(*)::BIGINT AS n, list_position([{', '.join(map(repr, DISPLAY_ORDER))}], label) AS position FROM known JOIN lab ON code = category GROUP BY label")
def stats_by_category(spark, sf_dir):
    counts = _store(spark, sf_dir).stats().select(F.explode("categories").alias("category", "n"))
    rank = F.array_position(F.array(*map(F.lit, DISPLAY_ORDER)), F.col("category")).cast("int")
    return counts.withColumn("position", rank)


@query(
    f", {CLASSIFIED}, {LABELS}, counts AS (SELECT label, count(*) AS n, list_position([{', '.join(map(repr, DISPLAY_ORDER))}], label) AS position FROM known JOIN lab ON code = category GROUP BY label)"
    " SELECT (SELECT count(*) FROM torrents)::BIGINT AS total, true AS has_size, '{' || (SELECT string_agg('\"' || label || '\":' || n, ',' ORDER BY position) FROM counts) || '}' AS categories, 'connected' AS sync"
)
def stats(spark, sf_dir):
    """Total, whether bytes are stored, the counts of categories that have any, and the state of the replication."""
    return _store(spark, sf_dir).stats(2).select("total", (F.col("db_size") > 0).alias("has_size"), F.to_json("categories").alias("categories"), "sync")


@query(" SELECT coalesce(max(discovered_at), 0)::BIGINT AS latest FROM torrents")
def latest_ts(spark, sf_dir):
    return catalog.latest_timestamp(corpus.torrents(spark, sf_dir))


@query(f", {CLASSIFIED}, {LABELS} SELECT {ROW} {FROM} WHERE infohash = sha1('o7')")
def point_lookup(spark, sf_dir):
    import hashlib

    return _shown(catalog.point_lookup(*_catalog(spark, sf_dir), hashlib.sha1(b"o7").hexdigest()))


@query(" SELECT infohash, discovered_at FROM torrents ORDER BY discovered_at, infohash")
def scan_time_order(spark, sf_dir):
    """All entries in time order, by a range-partitioned sort."""
    return catalog.entries_after(corpus.torrents(spark, sf_dir), 0, bytes(20)).select(fmt.hex_lower(F.col("infohash")).alias("infohash"), "discovered_at")


@query(" SELECT infohash, discovered_at FROM torrents WHERE (discovered_at, infohash) > (86400000, sha1('o7')) ORDER BY discovered_at, infohash LIMIT 1000")
def keyset_page(spark, sf_dir):
    import hashlib

    page = catalog.entries_after(corpus.torrents(spark, sf_dir), 86_400_000, hashlib.sha1(b"o7").digest(), 1000)
    return page.select(fmt.hex_lower(F.col("infohash")).alias("infohash"), "discovered_at")


@query(" SELECT infohash, discovered_at FROM torrents WHERE discovered_at >= 150000000")
def sync_since(spark, sf_dir):
    return catalog.entries_since(corpus.torrents(spark, sf_dir), 150_000_000).select(fmt.hex_lower(F.col("infohash")).alias("infohash"), "discovered_at")


@query(f", {CLASSIFIED} SELECT count(*)::BIGINT AS late FROM torrents WHERE infohash NOT IN (SELECT infohash FROM known)")
def late_unclassified(spark, sf_dir):
    return catalog.unclassified(*_catalog(spark, sf_dir)).agg(F.count(F.lit(1)).alias("late"))


# --- search


@query(_search_sql(["of", "is"]))
def search_all_tokens(spark, sf_dir):
    return _shown(_documents(spark, sf_dir).search("of is", cap=None))


@query(_search_sql(["tion"]))
def search_one_token(spark, sf_dir):
    return _shown(_documents(spark, sf_dir).search("Tion", cap=None))


@query(_search_sql(["of", "is"], limit=100, offset=20))
def search_page(spark, sf_dir):
    return _shown(_documents(spark, sf_dir).search("is of", limit=500, offset=20, cap=None))


@query(_search_sql(["of", "is"], where="category IS NULL OR category = 1"))
def search_category(spark, sf_dir):
    return _shown(_documents(spark, sf_dir).search("of is", category="movie", cap=None))


@query(_search_sql(["of", "is"]))
def search_bad_category(spark, sf_dir):
    return _shown(_documents(spark, sf_dir).search("of is", category="nonsense", cap=None))


@query(_search_sql(["the", "of"]))
def search_stopword(spark, sf_dir):
    return _shown(_documents(spark, sf_dir).search("the of", cap=None))


@query(_search_sql(["of", "is"], cap=30))
def search_capped(spark, sf_dir):
    return _shown(_documents(spark, sf_dir).search("of is", cap=30))


# --- writes

SECOND = "SELECT sha1('o' || o_orderkey * 2) AS infohash, 'again ' || o_orderkey AS name, 1::BIGINT AS size, 5::BIGINT AS discovered_at, o_orderkey AS seq FROM orders UNION ALL SELECT sha1('o' || o_orderkey * 2), 'late', 2, 6, o_orderkey + 1000000000 FROM orders"


def _incoming(spark, sf_dir):
    """Rows that are stored already, new rows, and repeats of both."""
    o = corpus.table(spark, sf_dir, "orders")
    h = F.unhex(F.sha1(F.concat(F.lit("o"), (F.col("o_orderkey") * 2).cast("string")))).alias("infohash")
    one = lambda v: F.lit(v).cast("long")
    first = o.select(h, F.concat(F.lit("again "), F.col("o_orderkey").cast("string")).alias("name"), one(1).alias("size"), one(5).alias("discovered_at"), F.col("o_orderkey").alias("seq"))
    return first.unionByName(o.select(h, F.lit("late").alias("name"), one(2).alias("size"), one(6).alias("discovered_at"), (F.col("o_orderkey") + 1_000_000_000).alias("seq")))


@query(f", incoming AS ({SECOND}), new AS (SELECT infohash, name, size, discovered_at FROM incoming WHERE infohash NOT IN (SELECT infohash FROM torrents) QUALIFY row_number() OVER (PARTITION BY infohash ORDER BY seq) = 1) SELECT infohash, name, size, discovered_at FROM torrents UNION ALL SELECT * FROM new")
def upsert_first_wins(spark, sf_dir):
    stored = corpus.torrents(spark, sf_dir).drop("o_orderkey")
    return catalog.upsert_first_wins(stored, _incoming(spark, sf_dir), F.col("seq")).withColumn("infohash", fmt.hex_lower(F.col("infohash")))


@query(f", incoming AS ({SECOND}), new AS (SELECT infohash, name, size, discovered_at FROM incoming WHERE infohash NOT IN (SELECT infohash FROM torrents) QUALIFY row_number() OVER (PARTITION BY infohash ORDER BY discovered_at, name) = 1) SELECT infohash, name, size, discovered_at FROM torrents UNION ALL SELECT * FROM new")
def upsert_stored(spark, sf_dir):
    """The same upsert into a stored catalog: incoming hashes go to the stored keys, which are not shuffled."""
    store = Store(spark, scratch(spark, "upsert"))
    store.add(corpus.entries(spark, sf_dir))
    store.add(_incoming(spark, sf_dir).withColumn("files", F.array().cast(catalog.FILES)), F.struct("discovered_at", "name"))
    return store.read("entries").select(fmt.hex_lower(F.col("infohash")).alias("infohash"), "name", "size", "discovered_at")


@query(f", incoming AS ({SECOND}) SELECT infohash, name FROM incoming WHERE infohash NOT IN (SELECT infohash FROM torrents)")
def ingest_antijoin(spark, sf_dir):
    return _incoming(spark, sf_dir).join(corpus.torrents(spark, sf_dir).select("infohash"), "infohash", "left_anti").select(fmt.hex_lower(F.col("infohash")).alias("infohash"), "name")


@query(" SELECT count(*)::BIGINT AS applied FROM torrents WHERE discovered_at >= 100000000")
def sync_apply(spark, sf_dir):
    """Replicates to a store that holds what is older, from its latest time on."""
    t = corpus.torrents(spark, sf_dir).drop("o_orderkey")
    local = t.filter("discovered_at < 100000000")
    since = catalog.latest_timestamp(local).first()["latest"]
    return catalog.new_entries(local, catalog.entries_since(t, since), F.col("discovered_at")).agg(F.count(F.lit(1)).alias("applied"))


# --- formats


@query(" SELECT o_orderkey, greatest(0, CAST(epoch(o_orderdate) AS BIGINT) - 1577836800) & 4294967295 AS stored, CAST(epoch(o_orderdate) AS BIGINT) - 788918400 + 1577836800 AS shown FROM orders")
def epoch_convert(spark, sf_dir):
    unix = corpus.unix_seconds(F.col("o_orderdate"))
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", fmt.from_unix(unix).alias("stored"), fmt.to_unix(unix - corpus.SHIFT).alias("shown"))


@query(" SELECT o_orderkey, (281474976710656 * (o_orderkey % 100) + o_orderkey) & 281474976710655 AS size FROM orders")
def codec_u48(spark, sf_dir):
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", fmt.u48(F.lit(1 << 48) * (F.col("o_orderkey") % 100) + F.col("o_orderkey")).alias("size"))


# Every third is a quarter above whole megabytes, midway between two tenths.
SIZES = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 * 1048576 + 262144 ELSE (o_orderkey * 7919 % 1000003) * power(10, o_orderkey % 7)::BIGINT END::BIGINT"


@query(
    f" SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN format('{{:.1f}}GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN format('{{:.1f}}MB', n / 1048576.0::DOUBLE) ELSE CAST(n // 1024 AS BIGINT) || 'KB' END AS bin FROM (SELECT o_orderkey, {SIZES} AS n FROM orders)"
)
def format_size(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.when(k % 3 == 0, F.floor(k / 3).cast("long") * 1048576 + 262144).otherwise(((k * 7919) % 1000003) * F.pow(F.lit(10), k % 7).cast("long"))
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", fmt.size_binary(n).alias("bin"))


@query(" SELECT infohash, CASE WHEN d < 60 THEN d || 's ago' WHEN d < 3600 THEN (d // 60) || 'm ago' WHEN d < 86400 THEN (d // 3600) || 'h ago' ELSE (d // 86400) || 'd ago' END AS ago FROM (SELECT infohash, 300000000 - discovered_at - (o_orderkey * 7919) % 90000 AS d FROM torrents)")
def time_ago(spark, sf_dir):
    t = corpus.torrents(spark, sf_dir)
    return t.select(fmt.hex_lower(F.col("infohash")).alias("infohash"), fmt.time_ago(F.lit(300_000_000) - (F.col("o_orderkey") * 7919) % 90000, F.col("discovered_at")).alias("ago"))


@query(" SELECT infohash, 'magnet:?xt=urn:btih:' || infohash || '&dn=' || replace(replace(url_encode(name), '%28', '('), '%29', ')') AS link FROM torrents")
def magnet(spark, sf_dir):
    h = fmt.hex_lower(F.col("infohash"))
    return corpus.torrents(spark, sf_dir).select(h.alias("infohash"), fmt.magnet(h, F.col("name")).alias("link"))


@query(" SELECT v, y, greatest(CASE WHEN y THEN least(CASE WHEN v > 0 THEN v ELSE 60 END, 60) ELSE 300 END, 10) AS seconds FROM (SELECT DISTINCT o_orderkey % 90 - 5 AS v, o_orderkey % 2 = 0 AS y FROM orders)")
def interval_rule(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 90 - 5).alias("v"), (F.col("o_orderkey") % 2 == 0).alias("y")).distinct()
    return rows.withColumn("seconds", fmt.sampling_interval(F.col("v"), F.col("y")).cast("long"))


# --- codecs


def _hex_entries(df):
    return df.select(fmt.hex_lower(F.col("infohash")).alias("infohash"), "name", "size", "discovered_at", F.size("files").cast("long").alias("n_files"), F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["size"]).alias("bytes"))


FILES = ", f AS (SELECT l_orderkey, count(*)::BIGINT AS n_files, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS bytes FROM lineitem GROUP BY l_orderkey) SELECT infohash, name, size, discovered_at, coalesce(n_files, 0)::BIGINT AS n_files, coalesce(bytes, 0)::BIGINT AS bytes FROM torrents LEFT JOIN f ON l_orderkey = o_orderkey"


@query(FILES)
def codec_entry(spark, sf_dir):
    """Stored entries, encoded and decoded again."""
    raw = datasource.encoded(corpus.entries(spark, sf_dir), codecs.encode_entry).select("infohash", "raw")

    def decode(batches):
        import pandas as pd

        for b in batches:
            rows = [codecs.decode_entry(bytes(x)) for x in b["raw"]]
            yield pd.DataFrame({"infohash": b["infohash"], **{c: [r[c] for r in rows] for c in ("name", "size", "discovered_at")}, "files": [[{"path": p, "size": n} for p, n in r["files"]] for r in rows]})

    return _hex_entries(raw.mapInPandas(decode, datasource.DUMP))


@query(FILES)
def src_dump_roundtrip(spark, sf_dir):
    """Dump files, written by executors through Spark and read back by the dump source."""
    from ..sources.sink import write_dump

    path = scratch(spark, "dump")
    write_dump(corpus.entries(spark, sf_dir), path)
    return _hex_entries(datasource.read_dump(spark, path))


@query(FILES)
def src_dump_splits(spark, sf_dir):
    """Dump files through the data source, in splits of 64 KB at places that a job found."""
    from ..sources import formats
    from ..sources.sink import write_dump

    path = scratch(spark, "splits")
    write_dump(corpus.entries(spark, sf_dir), path)
    formats.register(spark)
    formats.write_offsets(spark, path, 65_536)
    return _hex_entries(spark.read.format("swarm_dump").option("splitBytes", 65_536).load(path))


@query(FILES)
def sync_export(spark, sf_dir):
    """Sync frames, written and read back; entries without a name have none."""
    raw = datasource.encoded(corpus.entries(spark, sf_dir).filter(F.length("name") > 0), codecs.write_frame).select("raw")

    def decode(batches):
        import pandas as pd

        for b in batches:
            rows = [e for x in b["raw"] for e in codecs.read_frames(bytes(x))]
            yield pd.DataFrame({c: [r[c] for r in rows] for c in ("infohash", "name", "size", "discovered_at")} | {"files": [[{"path": p, "size": n} for p, n in r["files"]] for r in rows]})

    return _hex_entries(raw.mapInPandas(decode, datasource.DUMP))


@query(" SELECT l_orderkey AS o_orderkey, string_agg(x, '' ORDER BY n, x) AS whole FROM (SELECT l_orderkey, l_linenumber AS n, 'p' || l_linenumber || ';' AS x FROM lineitem) GROUP BY l_orderkey")
def pieces(spark, sf_dir):
    """Pieces put together by their numbers."""
    li = corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string"), F.lit(";")).alias("x")).alias("p"))
    return li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("p")).alias("p")).select("o_orderkey", F.array_join(F.transform("p", lambda p: p["x"]), "").alias("whole"))


# --- routing

LIMB = "xor(('0x' || substr(id, {a}, {n}))::BIGINT, ('0x' || substr(sha1('s1'), {a}, {n}))::BIGINT)"
DISTANCE = ", ".join(LIMB.format(a=a, n=n) for a, n in routing.LIMBS)
NODE = "id, ip, port, insert_seq"
_TARGET = lambda: F.sha1(F.lit("s1"))


@query(f" SELECT {NODE} FROM nodes WHERE NOT dropped ORDER BY {DISTANCE}, insert_seq LIMIT 80")
def route_knn(spark, sf_dir):
    return routing.closest(corpus.nodes(spark, sf_dir), _TARGET()).select(*NODE.split(", "))


@query(f" SELECT {NODE} FROM nodes ORDER BY {DISTANCE}, insert_seq LIMIT 80")
def route_evict(spark, sf_dir):
    n = corpus.nodes(spark, sf_dir)
    return routing.evicted(n.filter("insert_seq % 2 = 0"), n.filter("insert_seq % 2 = 1"), _TARGET()).select(*NODE.split(", "))


@query(f" SELECT {NODE} FROM nodes WHERE last_responded < 50000 ORDER BY insert_seq LIMIT 20")
def route_stale(spark, sf_dir):
    return routing.stale(corpus.nodes(spark, sf_dir), 50_000, 20).select(*NODE.split(", "))


@query(f" SELECT {NODE} FROM nodes WHERE bep51 AND next_at <= 2500 ORDER BY insert_seq LIMIT 20")
def route_sample_ready(spark, sf_dir):
    return routing.sample_ready(corpus.nodes(spark, sf_dir), 2500, 20).select(*NODE.split(", "))


@query(
    f", ready AS (SELECT {NODE}, 0 AS feed FROM nodes WHERE bep51 AND next_at <= 300 ORDER BY insert_seq LIMIT 60), old AS (SELECT {NODE}, 1 AS feed FROM nodes WHERE last_responded < 50000 ORDER BY insert_seq LIMIT 60)"
    f" SELECT {NODE}, feed FROM (SELECT * FROM ready UNION ALL SELECT * FROM old) ORDER BY feed, insert_seq LIMIT 60"
)
def route_feed(spark, sf_dir):
    return routing.feed(corpus.nodes(spark, sf_dir), 300, 50_000, 60).select(*NODE.split(", "), F.col("_feed").alias("feed"))


@query(" SELECT count(*)::BIGINT AS nodes, count(*) FILTER (NOT dropped)::BIGINT AS live FROM nodes")
def route_stats(spark, sf_dir):
    return corpus.nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("dropped")).alias("live"))


@query(" SELECT s_suppkey, ip, port FROM (SELECT s_suppkey, '10.' || (s_suppkey % 9) || '.' || (s_suppkey % 251) || '.1' AS ip, CAST(1024 + s_suppkey % 3 AS INTEGER) AS port FROM supplier) s WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.ip = s.ip AND n.port = s.port)")
def route_unknown_addrs(spark, sf_dir):
    k = F.col("s_suppkey")
    seen = corpus.table(spark, sf_dir, "supplier").select(k, F.concat_ws(".", F.lit("10"), (k % 9).cast("string"), (k % 251).cast("string"), F.lit("1")).alias("ip"), (1024 + k % 3).cast("int").alias("port"))
    return routing.unknown(seen, corpus.nodes(spark, sf_dir)).select("s_suppkey", "ip", "port")


@query(
    ", seen AS (SELECT s_suppkey, sha1('c' || s_suppkey * 3) AS id, '10.' || (s_suppkey % 7) || '.' || (s_suppkey % 251) || '.1' AS ip, CAST(1024 + s_suppkey % 3 AS INTEGER) AS port FROM supplier)"
    " SELECT s_suppkey, (SELECT min(insert_seq) FROM nodes n WHERE n.id = seen.id OR (n.ip = seen.ip AND n.port = seen.port)) AS matched FROM seen"
)
def route_upsert(spark, sf_dir):
    k = F.col("s_suppkey")
    seen = corpus.table(spark, sf_dir, "supplier").select(
        k, F.sha1(F.concat(F.lit("c"), (k * 3).cast("string"))).alias("id"), F.concat_ws(".", F.lit("10"), (k % 7).cast("string"), (k % 251).cast("string"), F.lit("1")).alias("ip"), (1024 + k % 3).cast("int").alias("port")
    )
    return routing.upserted(corpus.nodes(spark, sf_dir), seen).select("s_suppkey", "matched")


@query(f" SELECT {NODE} FROM nodes WHERE id <> sha1('c3') AND ip <> '10.1.1.1'")
def route_drop(spark, sf_dir):
    import hashlib

    return routing.without(corpus.nodes(spark, sf_dir), [hashlib.sha1(b"c3").hexdigest()], ["10.1.1.1"]).select(*NODE.split(", "))


ANNOUNCES = "ann AS (SELECT sha1('u' || user_id) AS infohash, event_id AS seq, 'p' || event_id AS peer FROM events)"


def _announces(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    return e.select(F.sha1(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("infohash"), F.col("event_id").alias("seq"), F.array(F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("peers"))


@query(f", {ANNOUNCES} SELECT infohash, max_by(peer, seq) AS peer FROM ann GROUP BY infohash")
def announce_last(spark, sf_dir):
    return routing.last_announced(_announces(spark, sf_dir)).select("infohash", F.col("peers")[0].alias("peer"))


# --- streaming and ingest


@query(f", {ANNOUNCES}, ok AS (SELECT * FROM ann WHERE seq % 3 <> 0) SELECT infohash, peer FROM ok QUALIFY row_number() OVER (PARTITION BY infohash ORDER BY seq) = 1")
def first_success(spark, sf_dir):
    """The first attempt of each hash that succeeds."""
    tried = _announces(spark, sf_dir).filter("seq % 3 <> 0")
    return tried.groupBy("infohash").agg(F.min_by(F.col("peers")[0], "seq").alias("peer"))


@query(f", {ANNOUNCES}, held AS (SELECT infohash, max_by(peer, seq) AS peer FROM ann GROUP BY infohash) SELECT c_custkey, coalesce(peer, 'node' || c_custkey) AS peer FROM customer LEFT JOIN held ON infohash = sha1('u' || c_custkey * 2)")
def peer_fallback(spark, sf_dir):
    asked = corpus.table(spark, sf_dir, "customer").select("c_custkey", F.sha1(F.concat(F.lit("u"), (F.col("c_custkey") * 2).cast("string"))).alias("infohash"))
    return asked.join(routing.last_announced(_announces(spark, sf_dir)), "infohash", "left").select("c_custkey", F.coalesce(F.col("peers")[0], F.concat(F.lit("node"), F.col("c_custkey").cast("string"))).alias("peer"))


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = corpus.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


GAP = 21_600


@query(
    f", e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events), k AS (SELECT user_id, min(seconds) AS seconds FROM e GROUP BY user_id UNION ALL"
    f" SELECT k.user_id, (SELECT min(e.seconds) FROM e WHERE e.user_id = k.user_id AND e.seconds >= k.seconds + {GAP}) FROM k WHERE k.seconds IS NOT NULL) SELECT user_id, seconds FROM k WHERE seconds IS NOT NULL"
)
def cooldown_dedup(spark, sf_dir):
    """Events in four files by time, a micro-batch each; the state of a key ends when the watermark is past its gap."""
    path = scratch(spark, "cooldown")
    e = corpus.table(spark, sf_dir, "events").select("user_id", corpus.unix_seconds(F.col("ts")).alias("seconds"))
    cut = e.agg(F.percentile_approx("seconds", [0.25, 0.5, 0.75]).alias("c")).first()["c"] or []
    for low, high in zip([None, *cut], [*cut, None], strict=True):
        part = e.filter((F.lit(True) if low is None else F.col("seconds") >= low) & (F.lit(True) if high is None else F.col("seconds") < high))
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("user_id long, seconds long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    kept = ingest.cool_down(stream, "user_id", "seconds", GAP)
    kept.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema("user_id long, seconds long").parquet(f"{path}/rows")


@query(" SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    stream = _event_stream(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch(spark, "dedup")
    once = ingest.distinct_arrivals(stream, "user_id", "ts", "3650 days").select("user_id")
    once.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema("user_id long").parquet(f"{path}/rows")


from . import jobs, protocol  # noqa: E402, F401  they register theirs

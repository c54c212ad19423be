"""Findings on larger tables: pages, chunks and filters whose work must not grow faster than their input."""

import duckdb
from pyspark.sql import functions as F

from swarmlake.operators import catalog
from swarmlake.plans import registry
from swarmlake.streaming import ingest
from tests.test_store import made


def test_a_filter_is_not_worn_down_by_other_keys(spark, tmp_path):
    """Two keys of one shard of 1,024, where each use of the first ages a cell of the second."""
    import hashlib

    from swarmlake.sources import codecs

    n = 2_000_000
    raw = lambda u: hashlib.sha1(str(u).encode()).digest()
    aged = lambda u: {((int.from_bytes(raw(u)[:8], "little") + i) * codecs.StableBloom.SPREAD & (1 << 64) - 1) % n for i in range(3)}
    raws = {u: raw(u) for u in range(90_000)}
    shards = spark.createDataFrame([(u, h) for u, h in raws.items()], "u int, h binary").select("u", F.pmod(F.xxhash64("h"), F.lit(1024)).alias("s")).collect()
    owner = {(r["s"], c): r["u"] for r in shards for c in codecs.StableBloom.indices(raws[r["u"]], n)}
    pairs = [(r["u"], owner[r["s"], c]) for r in shards for c in aged(r["u"]) if owner.get((r["s"], c), r["u"]) != r["u"]]
    assert pairs
    rows = [x for a, b in pairs for x in (b, *[a] * 9, b)]
    duckdb.execute(f"COPY (SELECT unnest(range({len(rows)})) AS event_id, unnest({rows}::BIGINT[]) AS user_id, TIMESTAMP '2020-01-01' AS ts) TO '{tmp_path}/events.parquet'")
    for name in ("customer", "part", "orders", "lineitem", "documents"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    got = {r["seq"]: r["seen"] for r in registry.QUERIES["bloom_sim"](spark, str(tmp_path)).collect()}
    assert got == {i: u in rows[:i] for i, u in enumerate(rows)}


def test_all_pages_in_one_pass(spark, tmp_path):
    """Pages of all keys are those that a client gets one after the other, over several ranges and with a last one that is not full."""
    rows = made(spark, 0, 530, 7)
    pages = catalog.paged(rows, f"file://{tmp_path}/pages").collect()
    for p in range(11):
        want = catalog.newest(lambda since: rows, (None,), p * 50, 50)
        assert [(r["discovered_at"], bytes(r["infohash"])) for r in sorted((r for r in pages if r["page"] == p), key=lambda r: r["n"])] == want
    assert len(pages) == 530 and len(want) == 30
    assert catalog.paged(rows.limit(0), f"file://{tmp_path}/none").count() == 0


def test_exact_chunks_without_a_single_task(spark, tmp_path):
    rows = made(spark, 0, 1003, 300)
    chunks = ingest.exact_ranges(rows.select("discovered_at", "infohash"), 100, f"file://{tmp_path}/c")
    assert [c.count() for c in chunks] == [100] * 10 + [3]
    keys = [sorted((r["discovered_at"], bytes(r["infohash"])) for r in c.collect()) for c in chunks]
    assert sum(keys, []) == sorted((r["discovered_at"], bytes(r["infohash"])) for r in rows.collect())
    assert not any("GlobalLimit" in c._jdf.queryExecution().optimizedPlan().toString() for c in chunks)


def test_small_splits_share_tasks():
    from swarmlake.sources import formats

    small = [formats.Split("f", k << 16, (k + 1) << 16) for k in range(32_768)]  # 2 GB in splits of 64 KB
    runs = formats.runs(small)
    assert len(runs) == 128 and [s for r in runs for s in r.splits] == small
    assert max(sum(s.end - s.start for s in r.splits) for r in runs) == formats.SPLIT_BYTES
    assert len(formats.runs(small[:50])) == 50 and formats.runs([]) == []
    large = [formats.Split("f", k << 24, (k + 1) << 24) for k in range(200)]
    assert [r.splits for r in formats.runs(large)] == [[s] for s in large]


def test_computed_rows_are_made_once(spark, tmp_path):
    """Ranges are cut on stored rows, so the work of a row is not done again to sample it."""
    from swarmlake.store import Store

    made_rows = spark.sparkContext.accumulator(0)

    @F.udf("tinyint")
    def code(size):
        made_rows.add(1)
        return size % 11

    store = Store(spark, f"file://{tmp_path}/s")
    store.replace(entries=made(spark, 0, 300), categories=lambda e: e.select("infohash", code("size").alias("category"), "discovered_at"), postings=catalog.postings)
    assert made_rows.value == 300 == store.read("categories").count() == store.total() and store.read("postings").count() > 300


def test_many_rows_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Above BROADCAST_KEYS an upsert shuffles hashes and places, not names and files; the first row of a hash by the order, and of equal ones the first that came."""
    from swarmlake import store as module

    Store = module.Store

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    salt = F.concat_ws("", *[F.sha2(F.concat(F.col("size").cast("string"), F.lit(str(k))), 512) for k in range(8)])  # 1,024 letters a row
    rows = lambda low, high: made(spark, low, high).withColumn("name", F.concat(F.lit("n"), F.col("size").cast("string"), F.lit(" "), salt))
    want, got = {}, {}
    for kind, limit in (("few", 10_000), ("many", 100)):
        monkeypatch.setattr(module, "BROADCAST_KEYS", limit)
        s, counts = Store(spark, f"file://{tmp_path}/{kind}"), []
        counts.append(s.add(rows(0, 1000).limit(0)))
        before = shuffled()
        counts.append(s.add(rows(0, 1000)))
        again = rows(500, 1500).unionByName(rows(500, 1500).withColumn("name", F.lit("later")).withColumn("discovered_at", F.col("discovered_at") + 1))
        again = again.unionByName(rows(1500, 1600).withColumn("name", F.lit("no time")).withColumn("discovered_at", F.lit(None).cast("long"))).unionByName(rows(1500, 1550))
        counts += [s.add(again), s.add(again), s.add(rows(0, 300))]
        moved = shuffled() - before
        (want if kind == "few" else got).update({r["infohash"]: r for r in s.read("entries").filter("discovered_at is not null").collect()}, counts=counts, total=s.total(), keys=s.read("keys").count())
    assert got == want and got["counts"] == [0, 1000, 600, 0, 0] and got["total"] == got["keys"] == 1600
    assert moved < 600_000  # rows would be over a megabyte
    monkeypatch.setattr(module, "BROADCAST_BITS", 0)
    s = Store(spark, f"file://{tmp_path}/joined")
    assert [s.add(rows(0, 1000)), s.add(again), s.add(again)] == [1000, 600, 0] and s.read("entries").select("infohash").distinct().count() == 1600


def test_a_large_upsert_groups_no_rows(spark, tmp_path, monkeypatch):
    """`upsert_stored` with both of its increments above BROADCAST_KEYS against its SQL, without first arrivals of whole rows."""
    from swarmlake import store as module
    from tests.test_oracle import plain

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for name in ("orders", "part", "customer", "lineitem", "documents"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    monkeypatch.setattr(module, "BROADCAST_KEYS", 100)
    monkeypatch.setattr(module.catalog, "first_arrivals", None)
    got = registry.QUERIES["upsert_stored"](spark, sf).toPandas()
    assert plain(got).equals(plain(c.execute(registry.ORACLE_SQL["upsert_stored"]).df()))


def test_entries_are_made_after_their_joins(spark):
    """What entries are made of is shuffled, not hashes, names and lists of files: 131 bytes an order at sf0.01, before 169."""
    from swarmlake.plans import corpus

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    made_of = corpus.entries(spark, "/root/testdata/sf0.01")
    before = shuffled()
    made_of.write.format("noop").mode("overwrite").save()
    moved = (shuffled() - before) / spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    assert 0 < moved < 150

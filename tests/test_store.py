"""What the stored catalog reads: scan metrics and plans of lookups, pages, searches, upserts, increments."""

import random

import pytest
from pyspark.sql import functions as F

from swarmlake.operators import catalog, search
from swarmlake.store import Store, classifier
from swarmlake.streaming import ingest
from tests.test_goldens import entries

NONE = "array<struct<path:string,size:long>>"


def made(spark, low, high, per_day=1):
    """Entries low..high with hashes that say nothing of their time, `per_day` a day."""
    i = F.col("id")
    name = F.concat(F.lit("red fish "), (i % 7).cast("string"), F.when(i % 500 == 3, " rare").otherwise(""), F.when(i == 1, " single").otherwise(""))
    return spark.range(low, high).select(
        F.unhex(F.sha1(i.cast("string"))).alias("infohash"), name.alias("name"), i.alias("size"), (F.floor(i / per_day) * 86_400).cast("long").alias("discovered_at"), F.array().cast(NONE).alias("files")
    )


def walk(plan):
    yield plan
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
    kids = plan.children()
    for k in [*inner, *(kids.apply(i) for i in range(kids.size()))]:
        yield from walk(k)


def scanned(df, column):
    """Rows that the Parquet scans with a column put out."""
    df.collect()
    nodes = [n for n in walk(df._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet")]
    return sum(n.metrics().apply("numOutputRows").value() for n in nodes if column in n.simpleString(1000).split("ReadSchema")[1])


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """8,000 entries over 1,000 days in eight files a table."""
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    s.add(made(spark, 0, 8000, 8))
    s.classify()
    s.compact(8)
    return s


def test_lookup_reads_a_row_group(spark, store):
    import hashlib

    for i in (5, 4321, 7999):
        found = catalog.point_lookup(store.read("entries"), store.read("categories"), hashlib.sha1(str(i).encode()).hexdigest())
        assert scanned(found, "files") <= 1100 and found.first()["size"] == i
    assert scanned(catalog.point_lookup(store.read("entries"), store.read("categories"), "ab" * 20), "files") == 0


def test_pages_read_their_days(store):
    plain = lambda **k: catalog.recent(store.read("entries"), store.read("categories"), **k).collect()
    bound = store.bounds(50)[0]
    assert store.read("entries").filter(F.col("discovered_at") >= bound).count() < 1000
    for k in ({}, {"offset": 70}, {"category": "other"}, {"category": "movie"}, {"offset": 7990}, {"offset": 9000}):
        page = store.recent(**k)
        assert page.collect() == plain(**k), k
        if not k:
            assert scanned(page, "files") <= 1100


def test_searches_stop_when_the_page_is_full(store, monkeypatch):
    looked = []
    monkeypatch.setattr(search, "matches", lambda postings, *a, real=search.matches: (looked.append(postings), real(postings, *a))[1])
    plain = lambda q, **k: search.search(store.read("entries"), store.read("categories"), store.read("postings"), q, cap=None, **k).collect()
    all_postings = store.read("postings").count()
    got = store.search("red fish", cap=None, limit=10)
    assert len(looked) == 1 and looked[0].count() < all_postings / 4
    assert got.collect() == plain("red fish", limit=10) and scanned(got, "files") <= 1100
    for q, k in (("red rare", {"limit": 5}), ("rare fish", {}), ("single", {}), ("nothing", {}), ("red 3", {"offset": 40, "limit": 100}), ("fish", {"category": "movie"})):
        assert store.search(q, cap=None, **k).collect() == plain(q, **k), q
    looked.clear()
    assert len(store.search("red", cap=3).collect()) == 3 and len(looked) == 1


def test_upserts_leave_the_stored_keys_in_place(spark, store):
    one = made(spark, 7000, 9000).filter(F.substring("infohash", 1, 1) == F.lit(b"\x07")).persist()
    new = store.unknown(one)
    assert scanned(new, "infohash") <= 2500 and {r["size"] for r in new.collect()} == {r["size"] for r in one.collect() if r["size"] >= 8000}
    hashes = [n for n in walk(new._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]
    assert not hashes  # neither side is shuffled
    few, many = (catalog.absent(one, store.read("keys"), [b"\x07"], f) for f in (True, False))
    assert sorted(few.collect()) == sorted(many.collect()) == sorted(new.collect())


def test_a_micro_batch_reads_its_own_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    seen = []

    def run(batch, n):
        before = store.state()["version"]
        for _ in range(2):
            classifier(store)(batch, n)
        seen.append((batch.count(), store.state()["version"] - before))

    for k in range(3):
        store.add(made(spark, k * 300, k * 300 + 300))
        ingest.run_available(store.stream("entries", 2), f"file://{tmp_path}/state", run)
    assert sum(n for n, _ in seen) == 900 and all(commits == 1 for _, commits in seen)  # a replay commits nothing
    assert store.read("categories").count() == 900 == store.read("categories").select("infohash").distinct().count()
    assert store.classify() == 0
    store.add(made(spark, 900, 1000))
    (folder,) = {f.split("/")[0] for f in store._open_files(store.state())}
    assert folder == store.state()["tables"]["entries"][-1]  # the rest is not read again
    assert store.classify() == 100
    ingest.run_available(store.stream("entries", 2), f"file://{tmp_path}/state", run)
    assert store.read("categories").count() == 1000 and store.read("postings").count() == store.read("postings").select("token", "infohash").distinct().count()


def test_counts_are_those_of_a_recount(spark, tmp_path):
    """Any order of calls: the kept numbers are those of the tables, compaction keeps what is open open."""
    r = random.Random(3)
    store, at = Store(spark, f"file://{tmp_path}/s"), 0
    for step in ("add", "classify", "add", "compact", "add", "classify", "drop", "classify", "add", "full", "compact", "drop", "add", "compact", "classify"):
        if step == "add":
            n = r.randrange(20, 90)
            assert store.add(made(spark, max(0, at - 10), at + n)) == n
            at += n
        elif step == "compact":
            store.compact(2)
        elif step == "drop":
            store.drop_classification()
        else:
            store.classify(full=step == "full")
        row = store.stats().first()
        want = {r["label"]: r["n"] for r in store.read("categories").groupBy(F.element_at(F.array(*map(F.lit, catalog.CODE)), F.col("category") + 1).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
        assert row["total"] == store.read("entries").count() == at and row["categories"] == want, step
        assert store.latest() == (at - 1) * 86_400
    assert sum(row["categories"].values()) == at


def test_replication_in_ranges(spark, tmp_path):
    """Near equal ranges of the key, a second with many rows cut as well; a run that was cut off goes on."""
    rows = made(spark, 0, 3000).withColumn("discovered_at", F.when(F.col("size") % 3 == 0, F.lit(5_000_000)).otherwise(F.col("discovered_at")))
    chunks = ingest.ranges(rows, 300)
    sizes = [c.count() for c in chunks]
    assert len(chunks) == 10 and sum(sizes) == 3000 and max(sizes) <= 330
    assert not any("TakeOrdered" in c._jdf.queryExecution().executedPlan().toString() for c in chunks)
    keys = [c.agg(F.min(F.struct("discovered_at", "infohash")).alias("a"), F.max(F.struct("discovered_at", "infohash")).alias("b")).first() for c in chunks]
    assert all(x["b"] < y["a"] for x, y in zip(keys, keys[1:], strict=False))
    target = Store(spark, f"file://{tmp_path}/t")
    run = ingest.replicate(rows, target, 900)
    first = next(run)
    assert 700 <= first <= 800  # a quarter
    assert sum(ingest.replicate(rows, target, 900)) == 3000 - first and target.total() == 3000
    assert sum(ingest.replicate(rows, target, 900)) == 0 and ingest.ranges(rows.limit(0), 10) == []


def test_hashes_of_null_and_repeats(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    twice = entries(spark, [(1, "a", 1, 5), (1, "b", 2, 4), (255, "c", 3, 9)])
    assert store.add(twice) == 2 and store.add(twice) == 0
    assert {r["name"] for r in store.read("entries").collect()} == {"b", "c"}

"""The command-line jobs over a stored catalog, parameters and SQL functions."""

import json

import pytest

from swarmlake.__main__ import main
from swarmlake.functions import params, sql
from swarmlake.sources import sink
from tests.test_goldens import entries


def test_jobs(spark, tmp_path):
    dump, at = f"file://{tmp_path}/dump", f"file://{tmp_path}/catalog"
    run = lambda *a: [json.loads(x) for x in main(["--catalog", at, *a], spark)]
    assert run("recent") == []
    sink.write_dump(entries(spark, [(1, "Show S01E02 720p", 5, 10), (2, "Novel epub", 6, 11), (1, "later", 7, 12)]), dump)
    run("migrate", dump), run("migrate", dump), run("classify")
    assert [(r["name"], r["category"]) for r in run("recent")] == [("Novel epub", "book"), ("Show S01E02 720p", "tv")]
    assert [r["name"] for r in run("search", "novel")] == ["Novel epub"]
    (stats,) = run("stats")
    assert stats["total"] == 2 and stats["db_size"] > 0 and stats["categories"] == {"book": 1, "tv": 1}
    before = run("search", "epub")
    run("reclassify"), run("compact")
    assert run("search", "epub") == before
    assert run("recent")[0]["files"] == [] and stats["sync"] == "connecting"
    (tmp_path / "requests").write_text(json.dumps({"job": "recent", "category": "book"}) + "\n" + json.dumps({"job": "stats"}))
    answers = run("web", f"file://{tmp_path}/requests")
    assert answers[0]["name"] == "Novel epub" and answers[1]["total"] == 2
    assert [r["size"] for r in run("show", "01" * 20)] == [5]


def test_params():
    assert params.parse_key("ab" * 32) == b"\xab" * 32
    n, text = int.from_bytes(b"\x01" * 32, "big"), ""
    while n:
        n, d = divmod(n, 58)
        text = params.BASE58[d] + text
    assert params.parse_key(text) == b"\x01" * 32
    for bad in ("", "0OIl", "abc"):
        with pytest.raises(ValueError):
            params.parse_key(bad)
    assert params.expand_path("a~/b") == "a~/b" and not params.expand_path("~/b").startswith("~")
    got = params.Settings.from_env({"SWARM_BATCH_FILES": "x", "SWARM_SCALE": "2.5", "SWARM_CATALOG": "/c"})
    assert (got.batch_files, got.scale, got.catalog) == (16, 2.5, "/c")


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT swarm_tokens('The Matrix (1999)') AS t, swarm_label(200) AS a, swarm_label(2) AS b, swarm_unix(1) AS u, swarm_u48(281474976710661) AS s").first()
    assert tuple(row) == (["matrix", "1999"], "other", "tv", 1577836801, 5)


def test_readers_see_one_state(spark, tmp_path):
    """A commit that fails, or is under way, leaves the old state; two writers of one version can't both win."""
    from swarmlake.store import Store

    rows = lambda n: entries(spark, [(i, f"name {i}", 1, i) for i in range(1, n + 1)])
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("entries").count() == 0 and store.size() == 0
    assert store.add(rows(2)) == 2 and store.classify() == 2
    old, seen = store.state(), store.read("entries")
    store._write("entries", rows(9))  # a commit that never came
    assert store.state() == old and store.read("entries").count() == 2
    assert store.add(rows(3)) == 1 and store.classify() == 1
    assert seen.count() == 2 and len(store.state()["tables"]["entries"]) == 2
    with pytest.raises(RuntimeError):
        store._commit(old)
    store.compact()
    assert [store.read(t).count() for t in ("entries", "categories")] == [3, 3] and store.meta("classifier_ts") == 3


def test_a_table_that_is_cut_off_goes_on(spark, tmp_path):
    """More rows in one second than a chunk holds: the full key still moves on."""
    from swarmlake.store import Store
    from swarmlake.streaming import ingest

    source, target = entries(spark, [(i, f"n{i}", 1, 7) for i in range(1, 8)]), Store(spark, f"file://{tmp_path}/t")
    assert next(ingest.replicate(source, target, 3)) == 3
    assert sum(ingest.replicate(source, target, 3)) == 4 and target.read("entries").count() == 7

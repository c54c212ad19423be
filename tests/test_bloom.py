"""The filter that all keys share, against one that takes the rows one by one."""

import hashlib
import random

import duckdb

from swarmlake.operators import bloom
from swarmlake.plans import registry
from swarmlake.sources import codecs


def _came(rows):
    seen, out = set(), {}
    for s, k in rows:
        out[s] = k in seen
        seen.add(k)
    return out


def test_a_small_filter_reports_what_one_by_one_does(spark):
    """300 keys and null in 1,024 cells, where both errors are common; the check mends them."""
    draw = random.Random(1)
    keys = [None, *(hashlib.sha1(b"%d" % k).digest() for k in range(300))]
    rows = [(3 * s, draw.choice(keys)) for s in range(4000)]
    one = codecs.StableBloom(512)
    want, came = {s: one.test_and_add(k or b"") for s, k in rows}, _came(rows)
    assert any(came[s] and not want[s] for s in want) and any(want[s] and not came[s] for s in want)
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "seq long, key binary")
    assert {r["seq"]: r["reported"] for r in bloom.reports(df, "seq", "key", 512).collect()} == want
    assert {r["seq"]: r["seen"] for r in bloom.repeats(df, "seq", "key", 512).collect()} == came


def test_the_query_uses_one_filter_for_all_keys(spark, tmp_path, monkeypatch):
    """Keys that wear a cell of another in the crawl's filter: it forgets some, and the query still has all repeats."""
    n = 2 * bloom.CAPACITY
    raw = [hashlib.sha1(b"%d" % u).digest() for u in range(10_000)]
    owner = {c: u for u, h in enumerate(raw) for c in codecs.StableBloom.indices(h, n)}
    aged = lambda h: {((int.from_bytes(h[:8], "little") + i) * codecs.StableBloom.SPREAD & (1 << 64) - 1) % n for i in range(3)}
    pairs = [(a, owner[c]) for a, h in enumerate(raw) for c in aged(h) if owner.get(c, a) != a]
    users = [u for a, b in pairs for u in (b, *[a] * 4, b)]
    duckdb.execute(f"COPY (SELECT unnest(range({len(users)})) AS event_id, unnest({users}::BIGINT[]) AS user_id) TO '{tmp_path}/events.parquet'")

    said, reports = [], bloom.reports
    monkeypatch.setattr(bloom, "reports", lambda *args: said.append(reports(*args)) or said[-1])
    got = {r["seq"]: r["seen"] for r in registry.QUERIES["bloom_sim"](spark, str(tmp_path)).collect()}
    one, came = codecs.StableBloom(bloom.CAPACITY), _came(enumerate(users))
    want = {s: one.test_and_add(raw[u]) for s, u in enumerate(users)}
    assert sum(came[s] and not want[s] for s in want) > 10
    assert [{r["seq"]: r["reported"] for r in s.collect()} for s in said] == [want]
    assert got == came


def test_ties_and_nulls_count_as_in_sql(spark):
    rows = [(None if i % 11 == 0 else i // 3, b"" if i % 7 == 0 else b"%020d" % (i * 31 % 40)) for i in range(1500)]
    rows = [(s, k or None) for s, k in rows]
    got = bloom.repeats(spark.createDataFrame(rows, "seq long, key binary").coalesce(1), "seq", "key", 10).collect()
    want = []
    for key in {k for _, k in rows}:
        mine = sorted((s for s, k in rows if k == key), key=lambda s: (s is None, s or 0))
        want += [(s, i > 0) for i, s in enumerate(mine)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["seq"], r["seen"]) for r in got), key=order) == sorted(want, key=order)

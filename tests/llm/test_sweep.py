"""The band join against all pairs."""

import math
import random
import zlib

import pytest

from swarmlake.llm.sweep_join import band_join, merged

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, i long, u string, part int"
ITEMS = "item_id long, price double, p long, kind string, m int"


def all_pairs(lines, items, ranks):
    out = []
    good = lambda x: x is not None and math.isfinite(x) and abs(x) < 1e13
    cents = lambda x: math.floor(x * 100 + 0.5)
    units = [(s, n, i, (2 * cents(a) + q) // (2 * q)) for s, n, i, q, a in lines if s is not None and i is not None and q and good(a)]
    for item, price in items:
        found = []
        if item is not None and good(price):
            p = cents(price)
            for s, n, i, u in units:
                gap = abs(u - p)
                if i != item and (gap <= 10 or 1000 * gap <= 2 * p):
                    found.append((gap, u, s, n, i, zlib.crc32(f"{s},{'' if n is None else n},{i}".encode())))
        found.sort(key=lambda x: (*x[:3], x[3] is not None, x[3] or 0, x[4]))
        sums = (len(found), sum(x[0] for x in found), sum(x[5] for x in found))
        out += [(item, k + 1, *x[:5], *sums) for k, x in enumerate(found[:ranks])] or [(item, 0, None, None, None, None, None, *sums)]
    return sorted(out, key=str)


def joined(spark, lines, items, **how):
    lines = spark.createDataFrame([(*r, 0, "x", 1) for r in lines], LINES)
    items = spark.createDataFrame([(*r, 0, "k", 3) for r in items], ITEMS)
    return sorted((tuple(r) for r in band_join(lines, items, **how).collect()), key=str)


def rows_with_ties(seed):
    """Few prices, one item with a third of the lines, nulls in each column, repeats, zero and negative values."""
    r = random.Random(seed)
    prices = [r.choice([0.03, 1.0, 2.5, 99.99, 500.0, 731.37, -4.0]) + r.choice([0, 0.01, 0.05, 0.11, 1.0]) for _ in range(12)]
    lines = []
    for _ in range(400):
        q = r.choice([1, 2, 3, 7, -2])
        lines.append((r.randrange(30), r.randrange(3), 7 if r.random() < 0.4 else r.randrange(12), q, round(r.choice(prices) * q + r.choice([0, 0.01, 0.04]), 2)))
    lines += lines[:40]
    for k in range(5):
        lines += [tuple(None if j == k else x for j, x in enumerate(row)) for row in lines[:3]]
    lines += [(1, 1, 2, 0, 5.0), (1, 1, 2, 1, math.nan), (1, 1, 2, 1, math.inf), (1, 1, 2, 1, 1e300)]
    items = [(i, r.choice(prices)) for i in range(12)] + [(7, 2.5), (7, 2.5), (None, 1.0), (3, None), (None, None), (4, math.nan), (5, 1e12)]
    return lines, items


@pytest.mark.parametrize("ranges", [1, 13])
@pytest.mark.parametrize("ranks", [1, 5])
def test_all_pairs(spark, ranges, ranks):
    lines, items = rows_with_ties(ranges)
    assert joined(spark, lines, items, ranges=ranges, ranks=ranks) == all_pairs(lines, items, ranks)


def test_wide_bands(spark):
    """Bands of many cents, whose nearest lines are mostly the item's own."""
    r = random.Random(3)
    lines = [(k, 1, 1 if r.random() < 0.9 else r.randrange(5), 1, 900 + r.randrange(-300, 300) / 100) for k in range(600)]
    items = [(i, 900 + i / 100) for i in range(8)] + [(1, 900.5)]
    assert joined(spark, lines, items, ranges=9) == all_pairs(lines, items, 5)


def test_empty_tables(spark):
    assert joined(spark, [], [(1, 2.0)]) == [(1, 0, None, None, None, None, None, 0, 0, 0)]
    assert joined(spark, [(1, 1, 1, 1, 1.0)], []) == []


def test_bounded_lists_lose_no_rank():
    """Whatever item is left out, its first ranks are in the merged list."""
    r = random.Random(5)
    for _ in range(200):
        lines = [(u, r.randrange(9), 0, r.choice([1, 1, 1, 2, 3])) for u in range(r.randrange(60))]
        kept = merged(lines[:20], lines[20:], 3)
        assert len(kept) <= 6
        for item in range(4):
            assert [x for x in kept if x[3] != item][:3] == [x for x in lines if x[3] != item][:3]

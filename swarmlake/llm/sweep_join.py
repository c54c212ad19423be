"""Numeric band join by a sweep over the price axis.

An item's band is the interval of unit prices that pair with it. The events of the sweep are the start,
the price and the end of each band, and the unit prices at which there are lines, each with what its
lines add up to. They are sorted once over all, in ranges; what a range has to know of the others (totals
before it, the nearest lines on either side) is a fixed number of rows, so ranges are swept side by side.
No pair is made but those that are returned: counts and sums over a band are differences of running
totals, less the item's own lines.
"""

from __future__ import annotations

from collections import deque
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAST, PER_MILLE = 10, 2  # a gap of at most LEAST cents, or of PER_MILLE thousandths of the item's price
START, POINT, PRICE, END = range(4)  # events of one value, in their order
EVENT = "v long, kind int, i long, p long, n long, c long, lines array<struct<s:long,l:long,i:long>>"
SWEPT = "i long, p long, n decimal(38,0), gap decimal(38,0), c decimal(38,0), pairs array<struct<gap:long,u:long,s:long,l:long,i:long>>"


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5) in doubles; null for what is no number or not below 10^13."""
    return F.when(~F.isnan(x) & (F.abs(x) < 1e13), F.floor(x * 100 + 0.5).cast("long"))


def unit_cents(amount: Column, quantity: Column) -> Column:
    """floor((2a + q) / 2q) in exact integers, for either sign of q; null for a quantity of 0."""
    q = quantity.cast("long")
    top, bottom = (cents(amount) * 2 + q) * F.signum(q).cast("long"), F.nullif(F.abs(q) * 2, F.lit(0).cast("long"))
    return F.call_function("div", top - F.pmod(top, bottom), bottom)


def half_width(p: Column) -> Column:
    """The largest gap with which a line still pairs: floor(2p / 1000), LEAST at least."""
    return F.greatest(F.lit(LEAST).cast("long"), F.floor(p * PER_MILLE / 1000).cast("long"))


def cell(u: Column) -> Column:
    """A monotone cell number, so wide that a band lies in two cells at most."""
    return (F.signum(u.cast("double")) * F.floor(F.ln(F.abs(u) + F.lit(5000.0)) * 100)).cast("long")


def nearest(rows: DataFrame, group: list[str], order: list[Column], ranks: int) -> DataFrame:
    """The first 2 x `ranks` lines of each group, of which at most `ranks` are of one item (column i).

    Whatever item is left out, its first `ranks` lines of other items are among them. Both limits are
    applied before rows are shuffled.
    """
    for keys, most in (([*group, "i"], ranks), (group, 2 * ranks)):
        first = Window.partitionBy(*keys).orderBy(*order, F.col("l").asc_nulls_first(), "i")
        rows = rows.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most).drop("_k")
    return rows


def merged(near: list[tuple], far: list[tuple], ranks: int) -> list[tuple]:
    """Lines (u, s, l, i) of `near` and then of `far`, at most `ranks` of an item and 2 x `ranks` in all."""
    out, of = [], {}
    for line in (*near, *far):
        if of.get(line[3], 0) < ranks:
            of[line[3]] = of.get(line[3], 0) + 1
            out.append(line)
            if len(out) == 2 * ranks:
                break
    return out


class Active:
    """A price whose band the sweep is in: its items, and bounded lists of the nearest lines on both sides."""

    __slots__ = ("above", "below", "items", "p", "width")

    def __init__(self, p: int, below: list[tuple]):
        self.p, self.below, self.above, self.items = p, below, [], []
        self.width = max(LEAST, p * PER_MILLE // 1000)

    def pairs(self, ranks: int):
        """For each item its pairs (gap, u, s, l, i), in rank order."""
        found = [(abs(x[0] - self.p), *x) for x in (*self.below, *self.above)]
        found = sorted((x for x in found if x[0] <= self.width), key=lambda x: (x[0], x[1], x[2], x[3] is not None, x[3] or 0, x[4]))
        for i in self.items:
            yield i, [x for x in found if x[4] != i][:ranks]


def swept(events, carry: dict, ranks: int):
    """Sweeps events (part, v, kind, i, p, n, c, lines) of one or more whole ranges; yields rows of SWEPT.

    carry: for each range the totals (count, sum of unit prices, sum of checksums) before it and the nearest
    lines before and after it. Held are the active prices and 2 x `ranks` lines for each of them.
    """
    part, active = None, deque()

    def ended(a: Active):
        for i, pairs in a.pairs(ranks):
            yield i, a.p, 0, 0, 0, pairs

    def closed():
        while active:
            a = active.popleft()
            a.above = merged(a.above, carry[part][4], ranks)
            yield from ended(a)

    for now, v, kind, i, p, n, c, lines in events:
        if now != part:
            yield from closed()
            part = now
            count, total, check, recent, _ = carry[part]
        if kind == POINT:
            at = [(v, x["s"], x["l"], x["i"]) for x in lines]
            count, total, check = count + n, total + n * v, check + c
            recent = merged(at, recent, ranks)
            still = deque()
            for a in active:  # a price stays active until its band is passed or its list is full
                if v <= a.p + a.width:
                    a.above = merged(a.above, at, ranks)
                if v >= a.p + a.width or len(a.above) == 2 * ranks:
                    yield from ended(a)
                else:
                    still.append(a)
            active = still
        elif kind == START:
            yield i, p, -count, total - p * count, -check, None
        elif kind == END:
            yield i, p, count, total - p * count, check, None
        else:
            if not active or active[-1].p != p:
                active.append(Active(p, recent))
            active[-1].items.append(i)
            yield i, p, 0, 2 * (p * count - total), 0, None
    yield from closed()


def _batches(rows, size: int = 20_000):
    import itertools

    import pyarrow as pa

    whole = pa.decimal128(38, 0)
    pair = pa.list_(pa.struct([(f, pa.int64()) for f in ("gap", "u", "s", "l", "i")]))
    while held := list(itertools.islice(rows, size)):
        i, p, n, gap, c, pairs = zip(*held, strict=True)
        listed = [x and [dict(zip(("gap", "u", "s", "l", "i"), y, strict=True)) for y in x] for x in pairs]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int64()), pa.array(p, pa.int64()), *(pa.array(map(Decimal, x), whole) for x in (n, gap, c)), pa.array(listed, pair)], ["i", "p", "n", "gap", "c", "pairs"]
        )


def _carried(points: DataFrame, parts: int, ranks: int) -> dict:
    """What each range needs of the others: `parts` rows of totals and 4 x `ranks` lines a range come to the driver."""
    sums = {r["part"]: r for r in points.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("decimal(20,0)") * F.col("v").cast("decimal(18,0)")).alias("t"), F.sum(F.col("c").cast("decimal(20,0)")).alias("c")).collect()}
    lines = points.select("part", F.col("v").alias("u"), F.explode("lines").alias("x")).select("part", "u", "x.*")
    first, last = {}, {}
    for side, order in ((first, F.asc("u")), (last, F.desc("u"))):
        for r in nearest(lines, ["part"], [order, F.asc("s")], ranks).collect():
            side.setdefault(r["part"], []).append((r["u"], r["s"], r["l"], r["i"]))
        sign = 1 if side is first else -1
        for own in side.values():
            own.sort(key=lambda x: (sign * x[0], x[1], x[2] is not None, x[2] or 0, x[3]))
    carry, so_far, before = {}, (0, 0, 0), []
    for k in range(parts):
        carry[k] = [*so_far, before, []]
        if k in sums:
            so_far = tuple(a + int(b) for a, b in zip(so_far, (sums[k]["n"], sums[k]["t"], sums[k]["c"]), strict=True))
            before = merged(last[k], before, ranks)
    after = []
    for k in reversed(range(parts)):
        carry[k][4] = after
        after = merged(first.get(k, []), after, ranks)
    return carry


def band_join(lines: DataFrame, items: DataFrame, ranks: int = 5, ranges: int = 64) -> DataFrame:
    """Each item's first `ranks` lines of near unit price, and counts and sums over all its pairs.

    Returns item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc; an item
    without pairs has one row of rank 0 with nulls and zeros. Pairs rank by gap, u, sale_id, line_no (null
    first) and line_item_id; repeated lines each take a rank. Lines null in sale_id, item_id, quantity or
    amount never pair, nor do lines of quantity 0, items null in item_id or price, and amounts or prices that
    are no number or not below 10^13. A null line_no counts as empty in the checksum. Rows that repeat an
    item each give its rows. Extra columns are not read; empty tables give no pairs.

    The sort deals events to `ranges` ranges by (value, kind, item), so that many items of one price don't
    meet in one; 4 x `ranks` lines and three sums a range pass the driver, whatever the input. Lines of a unit
    price are summed before they travel, and the first of them are cut out before, too. An item's own
    lines meet it by (item, cell), where they are as many as there are cents in a cell. The sums of one
    unit price are longs: 2 billion lines each.
    """
    scratch = Scratch(lines.sparkSession, "sweep")
    src = lines.select(
        F.col("sale_id").cast("long").alias("s"), F.col("line_no").cast("long").alias("l"), F.col("item_id").cast("long").alias("i"),
        unit_cents(F.col("amount").cast("double"), F.when(F.col("quantity").cast("long") != 0, F.col("quantity").cast("long"))).alias("u"),
    ).filter("s is not null and i is not null and u is not null")
    text = F.concat_ws(",", F.col("s").cast("string"), F.coalesce(F.col("l").cast("string"), F.lit("")), F.col("i").cast("string"))
    own = scratch.stage(src.withColumn("c", F.crc32(text.cast("binary"))).groupBy("i", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")), "own")
    front = nearest(src.select("u", "s", "l", "i"), ["u"], [F.asc("s")], ranks)
    listed = front.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("s", "l", "i"))).alias("lines"))
    totals = own.groupBy("u").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    none = F.lit(None).cast("long")
    points = scratch.stage(totals.join(listed, "u").select(F.col("u").alias("v"), F.lit(POINT).alias("kind"), none.alias("i"), none.alias("p"), "n", "c", "lines"), "points")

    each = items.select(F.col("item_id").cast("long").alias("i"), cents(F.col("price").cast("double")).alias("p")).groupBy("i", "p").agg(F.count(F.lit(1)).alias("m"))
    each = scratch.stage(each, "items")
    w = half_width(F.col("p"))
    ends = F.array(*(F.struct(at.alias("v"), F.lit(kind).alias("kind")) for at, kind in ((F.col("p") - w, START), (F.col("p"), PRICE), (F.col("p") + w, END))))
    priced = each.filter("i is not null and p is not null")
    bands = priced.select("i", "p", F.explode(ends).alias("e")).select("e.v", "e.kind", "i", "p", none.alias("n"), none.alias("c"), F.lit(None).cast("array<struct<s:long,l:long,i:long>>").alias("lines"))
    order = ["v", "kind", "i", "p"]
    dealt = points.unionByName(bands).repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    dealt = scratch.stage(dealt, "events")
    parts = (dealt.agg(F.max("part")).first()[0] or 0) + 1
    carry = _carried(dealt.filter(F.col("kind") == POINT), parts, ranks)

    def run(batches):
        names = ("part", "v", "kind", "i", "p", "n", "c", "lines")
        rows = (r for b in batches for r in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in names), strict=True))
        yield from _batches(swept(rows, carry, ranks))

    found = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", *order).mapInArrow(run, SWEPT)

    zero = F.lit(0).cast("decimal(38,0)")
    whole = lambda x: x.cast("decimal(38,0)")
    no_pairs = F.lit(None).cast("array<struct<gap:long,u:long,s:long,l:long,i:long>>")
    cells = priced.select("i", "p", F.explode(F.sequence(cell(F.col("p") - w), cell(F.col("p") + w))).alias("cell"))
    gap = F.abs(F.col("u") - F.col("p"))
    less = own.withColumn("cell", cell(F.col("u"))).join(cells, ["i", "cell"]).filter(gap <= w)
    less = less.select("i", "p", whole(-F.col("n")).alias("n"), (whole(-F.col("n")) * gap.cast("decimal(18,0)")).cast("decimal(38,0)").alias("gap"), whole(-F.col("c")).alias("c"), no_pairs.alias("pairs"))
    every = each.select("i", "p", zero.alias("n"), zero.alias("gap"), zero.alias("c"), no_pairs.alias("pairs"), "m")
    result = every.unionByName(found.unionByName(less), allowMissingColumns=True).groupBy("i", "p").agg(
        F.sum("n").cast("long").alias("n_pairs"), F.sum("gap").cast("long").alias("gap_sum"), F.sum("c").cast("long").alias("lines_crc"), F.first("pairs", ignorenulls=True).alias("pairs"), F.sum("m").alias("m")
    )
    ranked = result.select("i", F.col("m").cast("int").alias("m"), "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("pairs").alias("k", "x"))
    return ranked.select(
        F.col("i").alias("item_id"), F.coalesce(F.col("k") + 1, F.lit(0)).alias("rank"), F.col("x.gap").alias("gap"), F.col("x.u").alias("u"), F.col("x.s").alias("sale_id"), F.col("x.l").alias("line_no"),
        F.col("x.i").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("_copy"),
    ).drop("_copy")

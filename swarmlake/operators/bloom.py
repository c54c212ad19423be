"""The decaying (stable) Bloom filter of the crawl as a job: one filter that all keys share, worked out cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.codecs import StableBloom

CAPACITY = 10_000_000  # the crawl's
LOW = (1 << 32) - 1


def _halves(h: Column, at: int) -> list[Column]:
    """Eight little-endian bytes from a hex digit on as two longs of 32 bits, the higher first; a long alone has a sign."""
    text = lambda a: F.concat(*(F.substring(h, a + 6 - 2 * i, 2) for i in range(4)))
    return [F.coalesce(F.conv(text(a), 16, 10).cast("long"), F.lit(0)) for a in (at + 8, at)]


def _cell(high: Column, low: Column, n: int) -> Column:
    """A number of 64 bits modulo `n`; what the halves have beyond 32 bits is carried and wraps."""
    high = (high + F.shiftright(low, 32)).bitwiseAND(LOW)
    return ((high * F.lit((1 << 32) % n) + low.bitwiseAND(LOW)) % F.lit(n)).cast("int")


def _own(n: int) -> list[Column]:
    """The cells that a key is tested by and sets."""
    return [_cell(F.col("high1") + F.col("high2") * i, F.col("low1") + F.col("low2") * i, n) for i in range(StableBloom.HASHES)]


def _aged(n: int) -> list[Column]:
    """The cells that a key wears down by one before its test. Both halves of the multiplier have less than 32 bits, so products fit."""
    high, low = divmod(StableBloom.SPREAD, 1 << 32)

    def cell(i: int) -> Column:
        k = F.col("low1") + i
        up, k = (F.col("high1") + F.shiftright(k, 32)).bitwiseAND(LOW), k.bitwiseAND(LOW)
        return _cell((k * high).bitwiseAND(LOW) + (up * low).bitwiseAND(LOW), k * low, n)

    return [cell(i) for i in range(StableBloom.HASHES)]


def reports(rows: DataFrame, seq: str, key: str, capacity: int = CAPACITY) -> DataFrame:
    """What one filter says of each row, when it takes all rows by `seq` (ties as they are read).

    Each row wears three cells down by one, is `reported` if none of its key's own three is 0, and sets these to the top
    value. A cell's value at a test is thus the top less what it was worn since it was last set by any key, so all cells
    are worked out at once, each in order. `own`: one of the cells was last set by this key. `place` tells rows apart.
    """
    n = max(1024, capacity * StableBloom.CELLS_PER_ITEM)
    halves = [c.alias(name) for c, name in zip(_halves(F.hex(key), 1) + _halves(F.hex(key), 17), ("high1", "low1", "high2", "low2"), strict=True)]
    rows = rows.select(seq, key, F.monotonically_increasing_id().alias("place"), *halves)
    use = lambda cells, sets: F.array(*(F.struct(c.alias("cell"), F.lit(sets).alias("sets")) for c in cells))
    uses = F.concat(use(_aged(n), False), F.array_distinct(use(_own(n), True)))
    uses = rows.select(seq, key, "place", F.inline(uses)).withColumn(key, F.when(F.col("sets"), F.col(key)))

    in_order = Window.partitionBy("cell").orderBy(F.col(seq).asc_nulls_last(), "place", "sets")
    worn = F.count(F.when(~F.col("sets"), True)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(F.col("sets"), F.struct(key, "worn")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    tests = uses.withColumn("worn", worn).withColumn("last", last).filter("sets")
    held = F.coalesce(F.col("worn") - F.col("last.worn") < StableBloom.TOP, F.lit(False))
    own = F.col("last").isNotNull() & F.col(f"last.{key}").eqNullSafe(F.col(key))
    return tests.groupBy(seq, key, "place").agg(F.bool_and(held).alias("reported"), F.bool_or(own).alias("own"))


def repeats(rows: DataFrame, seq: str, key: str, capacity: int = CAPACITY) -> DataFrame:
    """`seq` and whether the row's key came before, by the filter and an exact check of what it leaves open.

    A reported row is a repeat if its key set one of the cells last. Others are rows that the filter does not report, among
    them repeats whose cells were worn down, and rows reported for other keys' sake. The check numbers those
    of a key in order; its very first row is always among them, as no cell can be its own yet.
    """
    said = reports(rows, seq, key, capacity)
    sure = F.col("reported") & F.col("own")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).asc_nulls_last(), "place"))
    return said.filter(sure).select(seq, F.lit(True).alias("seen")).unionByName(said.filter(~sure).select(seq, (nth > 1).alias("seen")))

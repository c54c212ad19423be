"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, id). Counting rounds narrow, for every shard boundary, the
key range in which the target number of bytes is reached: each round counts the exact bytes below
256 equally spaced probes per boundary, in one pre-aggregated job whose result has a fixed bound.
When all splitters stand, one exchange deals the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PROBE_BITS = 8
LOW, SPAN_BITS = -(1 << 63), 64
OVERHEAD = 16  # bytes of a row besides its text


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"),
    )


def _splitters(rows: DataFrame, key: str, group: Column, goals: dict[int, tuple[int, int]], tolerance: int) -> dict[int, tuple[int, int, int, int]]:
    """Splitters by boundary: (first key of its range, bits of the range, bytes below, bytes in).

    `goals` gives a boundary's group and the bytes of that group that should lie below it. A round
    cuts every open range into 2**PROBE_BITS parts; at most as many rows times boundaries return.
    """
    state = {s: (LOW, SPAN_BITS, 0, tolerance + 1) for s in goals}
    while True:
        left = [s for s, (_, bits, _, inside) in state.items() if bits and inside > tolerance]
        if not left:
            return state
        bits = max(state[s][1] for s in left)
        step, now = bits - PROBE_BITS, [s for s in left if state[s][1] == bits]
        ranges: dict[int, set[int]] = {}
        for s in now:
            ranges.setdefault(goals[s][0], set()).add(state[s][0] >> bits)
        inside = F.lit(False)
        for g, prefixes in ranges.items():
            inside = inside | ((group == g) & (F.lit(True) if bits == SPAN_BITS else F.shiftright(F.col(key), bits).isin(sorted(prefixes))))
        probe = F.shiftright(F.col(key), step) if step else F.col(key)
        got = rows.filter(inside).groupBy(group.alias("g"), probe.alias("p")).agg(F.sum("size").alias("b"), F.min(key).alias("least"), F.max(key).alias("most")).collect()
        for s in now:
            first, _, below, _ = state[s]
            for r in sorted((r for r in got if r["g"] == goals[s][0] and first <= r["p"] << step < first + (1 << bits)), key=lambda r: r["p"]):
                one = r["least"] == r["most"]  # a single key needs no more probes
                state[s] = (r["least"] if one else r["p"] << step, 0 if one else step, below, r["b"])
                below += r["b"]
                if below >= goals[s][1]:
                    break
            else:
                if state[s][1] == bits:
                    state[s] = (first, 0, below, 0)


def _edge(first: int, bits: int, below: int, inside: int, target: int) -> int:
    """The end of a range that is nearer to the target."""
    return first if target - below <= below + inside - target else first + (1 << bits)


def _cuts(rows: DataFrame, shards: int, tolerance: float, whole_group: float) -> dict[int, tuple[int, int]]:
    """The first key (hash, id) of each shard but the first."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    near = max(1, int(share * tolerance))
    targets = {s: round(share * s) for s in range(1, shards)}
    hashes = _splitters(rows, "_h", F.lit(0), {s: (0, t) for s, t in targets.items()}, near)
    cuts, goals = {}, {}
    for s, (first, bits, below, inside) in hashes.items():
        cuts[s] = (_edge(first, bits, below, inside, targets[s]), LOW)
        if bits == 0 and inside > share * whole_group:
            goals[s] = (first, targets[s] - below)
    for s, (first, bits, below, inside) in _splitters(rows, "_i", F.col("_h"), goals, near).items():
        cuts[s] = (goals[s][0], _edge(first, bits, below, inside, goals[s][1]))
    return cuts


def _shard(cuts: dict[int, tuple[int, int]]) -> Column:
    """The shard of a row with a hash `_h` and an id `_i`."""
    top = (1 << 63) - 1
    shard = F.lit(0)
    for h, i in cuts.values():
        past = F.lit(False) if h > top else F.col("_h") > h
        at = F.lit(False) if h > top or i > top else (F.col("_h") == h) & (F.col("_i") >= i)
        shard = shard + (past | at).cast("int")
    return shard


def histogram_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, whole_group: float = 0.05) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: shards get near equal sums of size, the UTF-8 bytes of the text (null:
    none) plus 16. Equal texts are neighbours in the order. A boundary that falls in a group of
    equal texts moves to the group's nearer edge if the group has at most the share `whole_group`
    of a shard's bytes; a larger group is cut between its ids. So the bytes before a boundary differ
    from their target by at most half of that share, or of the longest text if that is more, plus
    the tolerance. Null and empty texts are one group, null ids come last in theirs, repeated rows
    keep one shard per id; ids are cast to long, null if they are no numbers. Texts of any length
    count whole. Extra columns are not read; an empty table gives an empty result. slot numbers a
    shard's rows without gaps in key order.
    """
    spark = docs.sparkSession
    rows = Scratch(spark, "shards").stage(keyed(docs, id_col, text_col), "keys").withColumn("_i", F.coalesce("_id", F.lit((1 << 63) - 1)))
    dealt = rows.withColumn("shard", _shard(_cuts(rows, shards, tolerance, whole_group)))

    # Slots: rows are ranked in parts of a shard, and a part starts where those before it end. Parts
    # are ranges of the hash, and a part of many rows (one text's copies) has a number of its own by
    # id. Their number has a fixed bound whatever the input.
    counts = {r["p"]: r["n"] for r in rows.groupBy(F.shiftright("_h", 54).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    usual = max(1, sum(counts.values()) // 512)
    salts = F.array(*[F.lit(1 + counts.get(p - 512, 0) // usual) for p in range(1024)])
    part = F.shiftright("_h", 54).cast("int")
    dealt = dealt.withColumn("_part", part).withColumn("_salt", F.pmod(F.xxhash64("_i"), F.get(salts, part + 512)).cast("int"))
    sums, base = {}, []
    for r in sorted(dealt.groupBy("shard", "_part", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()):
        base.append((r["shard"], r["_part"], r["_salt"], sums.get(r["shard"], 0)))
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["n"]
    starts = F.broadcast(spark.createDataFrame(base, "shard int, _part int, _salt int, _start long"))
    order = Window.partitionBy("shard", "_part", "_salt").orderBy("_h", "_i", "size")
    return dealt.withColumn("_rank", F.row_number().over(order)).join(starts, ["shard", "_part", "_salt"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.col("_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, whole_group: float = 0.05, tasks: int = 4) -> None:
    """Writes the documents with their own columns to `path`, a folder shard=N for each shard.

    The counting rounds read keys only; then the rows travel once, each shard to `tasks` tasks by a
    hash of the text and the id. The rules are those of `histogram_shards`; a column `shard` of the
    documents is an error.
    """
    if "shard" in docs.columns:
        raise ValueError("the documents have a column shard already")
    rows = Scratch(docs.sparkSession, "shards").stage(keyed(docs, id_col, text_col), "keys").withColumn("_i", F.coalesce("_id", F.lit((1 << 63) - 1)))
    cuts = _cuts(rows, shards, tolerance, whole_group)
    own = docs.columns
    wide = docs.select(*own, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_h"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_i"))
    dealt = wide.withColumn("shard", _shard(cuts)).withColumn("_part", F.pmod(F.xxhash64("_h", "_i"), F.lit(tasks)))
    dealt.repartition(shards * tasks, "shard", "_part").select(*own, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)

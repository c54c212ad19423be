"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A shingle is five words (a shorter text is one shingle) and weighs as often as it occurs. Every
shingle sends points of a Poisson process, whose rate is its weight, to random registers; a register
keeps the shingle of its first point, and a process stops once its next point comes later than the
first points of all registers. Registers of two documents agree with the probability Jaccard
similarity of their weights. Bands of registers find candidates, whose shingle sets are then
compared exactly; links make classes by connected components. Texts that repeat shingles have a
second set of bands with weights of one, so that candidates also follow the similarity of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, Scratch, join_groups

TABLE = np.frombuffer(WORD_TABLE, np.uint8)
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
PIECE = 1 << 20  # bytes of text hashed at once
VOLUME, COLUMNS = 4_000_000, 4096  # shingles of a part of a bucket; columns multiplied at once
SIGNATURES = "doc_id long, k1 long, k2 long, n int, bands array<long>"
SETS = "doc_id long, k1 long, k2 long, shingles array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE)
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, base)))) for base in (P, P_INV))
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of adjacent texts (UTF-8 bytes and their offsets), and each word's text.

    Words are those of `common.words`. A word's hash is a polynomial of its bytes, from prefix sums.
    """
    plain = TABLE[data]
    inside = plain != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts[1:]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _Powers.of(len(plain))
    sums = np.zeros(len(plain) + 1, np.uint64)
    np.cumsum(plain * up, out=sums[1:], dtype=np.uint64)
    return mix((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64)), np.searchsorted(offsets, at, "right") - 1


class Shingled:
    """Shingles of a batch of texts: for each distinct one its text, hash and number of times."""

    def __init__(self, texts: pa.Array, width: int):
        """Pieces of some texts at a time bound the memory; a longer text is a piece of its own."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        hashes, owner = word_hashes(data, offsets - offsets[0]) if len(data) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        n = len(texts)
        count = np.bincount(owner, minlength=n)
        first = np.cumsum(count) - count
        order = (np.arange(len(owner)) - first[owner]).astype(np.uint64)
        # Two hashes of the sequence of words tell texts apart.
        self.keys = [self._sums(mix(hashes + mix(order + np.uint64(seed))), first, count) for seed in (1, 1 << 40)]
        size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        rolled = np.zeros(len(hashes), np.uint64)
        for j in range(width):  # words past a text's end are left out
            there = order.astype(np.int64) + j < count[owner]
            rolled = rolled * Q + np.where(there, np.concatenate((hashes[j:], np.zeros(min(j, len(hashes)), np.uint64))), np.uint64(0))
        own = order.astype(np.int64) < size[owner]
        shingles, doc = mix(rolled[own]), owner[own]
        ends = np.cumsum(size)
        for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
            shingles[a:b].sort()
        fresh = np.ones(len(shingles), bool)
        fresh[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(fresh)
        self.doc, self.hash = doc[at], shingles[at]
        self.times = np.diff(np.append(at, len(shingles)))
        self.size = np.bincount(self.doc, minlength=n)

    @staticmethod
    def _sums(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return mix(total[first + count] - total[first] + count.astype(np.uint64)).view(np.int64)


def signatures(s: Shingled, texts: int, registers: int) -> np.ndarray:
    """The shingle of the first point in each register, for every text with shingles."""
    return first_shingles(s.doc, s.hash, s.times, texts, registers)


def first_shingles(doc: np.ndarray, shingles: np.ndarray, weights: np.ndarray, texts: int, registers: int) -> np.ndarray:
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    seed, rate, time = shingles, weights.astype(np.float64), np.zeros(len(doc))
    source, step = shingles, 0
    while len(doc):
        step += 1
        draw = mix(seed + np.uint64(step * int(P) % (1 << 64)))
        u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        time = time - np.log(u) / rate
        at = doc * registers + (mix(draw ^ Q) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        winner[at[won]] = source[won]
        latest = first.reshape(texts, registers).max(1)
        live = time < latest[doc]
        doc, seed, rate, time, source = doc[live], seed[live], rate[live], time[live], source[live]
    return winner.reshape(texts, registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * P
    for r in range(rows):
        key = mix(key * Q + parts[:, :, r])
    return key.view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
        at = held = 0
        for i, size in enumerate(sizes.tolist()):
            if i > at and held + size > PIECE:
                yield ids.slice(at, i - at), texts.slice(at, i - at)
                at, held = i, 0
            held += size
        if len(ids) > at:
            yield ids.slice(at), texts.slice(at)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int64()))


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """A row (doc_id, k1, k2, n, bands) per document; k1, k2 stand for its words, n counts its shingles.

    A text that repeats shingles has its bands by weights and those by its set; in other texts both
    are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(batches):
            s, n = Shingled(texts, width), len(texts)
            keys = band_keys(signatures(s, n, bands * rows), bands)
            has = s.size > 0
            repeats = np.bincount(s.doc, s.times > 1, n) > 0
            if repeats.any():
                own, at = repeats[s.doc], np.cumsum(repeats) - 1
                plain = first_shingles(at[s.doc[own]], s.hash[own], np.ones(own.sum()), int(repeats.sum()), bands * rows)
                both = np.concatenate((keys, keys), 1)
                both[repeats, bands:] = band_keys(plain, bands)
                there = np.arange(2 * bands) < np.where(has, np.where(repeats, 2, 1), 0)[:, None] * bands
                flat, sizes = both[there], there.sum(1)
            else:
                flat, sizes = keys[has].ravel(), has * bands
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(s.keys[0]), pa.array(s.keys[1]), pa.array(s.size, pa.int32()), _lists(flat, sizes)], ["doc_id", "k1", "k2", "n", "bands"]
            )

    return docs.mapInArrow(run, SIGNATURES)


def shingle_sets(docs: DataFrame, width: int, wanted: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Distinct shingles of the documents; `wanted` limits them to some (k1, doc_id), sorted by k1."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = shared.value
        for ids, texts in _pieces(batches):
            s = Shingled(texts, width)
            pick = s.size > 0
            if only is not None:
                at = np.minimum(np.searchsorted(only[0], s.keys[0]), max(0, len(only[0]) - 1))
                own = np.asarray(ids.fill_null(np.iinfo(np.int64).min))
                pick &= (only[0][at] == s.keys[0]) & (only[1][at] == own) if len(only[0]) else False
            if pick.any():
                where = pa.array(np.flatnonzero(pick))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(where), pa.array(s.keys[0][pick]), pa.array(s.keys[1][pick]), _lists(s.hash[pick[s.doc]].view(np.int64), s.size[pick])], ["doc_id", "k1", "k2", "shingles"]
                )

    return docs.mapInArrow(run, SETS)


def _joined(roots: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Roots of all nodes after more links."""
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    up = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    found = components(up, scratch, name)
    moved = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
    kept = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return kept.unionByName(found.join(roots, "node", "left_anti"))


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """Each node of the edges (a, b) with the least node of its component, by alternating stars.

    A round links every node's larger neighbours, then its smaller ones, to the least node around;
    rounds go as the logarithm of the nodes. All of it stays in tables.
    """
    now, k, mark = scratch.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0"), 0, None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.stage(large, f"{name}-large{k}")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
        k += 1
        after = scratch.stage(small.filter("u <> v").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-large{k - 1}")
        new = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, mark = after, new


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 4,
    all_pairs: int = 4, block: int = 1000, max_shared: int = 2_000_000,
) -> DataFrame:
    """One row per document: id, class_id (the largest id of its class), class_size, kept.

    Two texts are linked if the Jaccard similarity of their sets of `width`-word shingles is at
    least `similarity`; which pairs are compared follows both the weights and the sets. Texts of equal word
    sequences are one node. Null and empty texts, and others without words, have no shingles and
    are classes of their own. Rows that repeat an id count singly and share `kept`; null ids stand
    below all others. Texts of any length are read whole, in pieces. Extra columns are not read; an
    empty table gives an empty result.

    A band's bucket of at most `all_pairs` nodes compares all its pairs; in a larger one all nodes
    are compared with the least. Links make classes. A large bucket whose nodes are then of one
    class is done. In the others all pairs of nodes of different classes are compared, in blocks of
    about `block` by `block` nodes.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = scratch.stage(sketch(src, width, bands, rows), "sketch")
    nodes = found.filter("n > 0").groupBy("k1", "k2").agg(F.max("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    nodes = scratch.stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total, texts = found.count(), nodes.count()
    bucketed = nodes.select("node", "n", F.explode(F.array_distinct("bands")).alias("bucket"))
    both = F.col("x.bucket") == F.col("y.bucket")
    fits = F.least("x.n", "y.n") >= F.lit(similarity) * F.greatest("x.n", "y.n")
    pair = [F.col("x.node").alias("a"), F.col("y.node").alias("b")]
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre")).filter("size > 1")
    members = scratch.stage(join_groups(bucketed, scratch.stage(sizes, "sizes"), ["bucket"], "size", 2 * bands * texts), "members0")
    sets = _sets(src, nodes, members.select("node").distinct(), width, max_shared, scratch)
    few, many = members.filter(F.col("size") <= all_pairs), members.filter(F.col("size") > all_pairs)
    pairs = few.alias("x").join(few.alias("y"), both & (F.col("x.node") < F.col("y.node")) & fits).select(*pair)
    pairs = pairs.unionByName(many.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))).distinct()
    roots = scratch.stage(components(_linked(sets, pairs, similarity), scratch, "c0"), "roots0")
    # Only buckets of more than one class hold pairs that can still matter.
    many = many.select("node", "n", "bucket").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    new = scratch.stage(_across(sets, scratch.stage(many, "members1"), similarity, block, scratch).distinct(), "links1")
    if not new.isEmpty():
        roots = scratch.stage(_joined(roots, new, scratch, "c1"), "roots1")
    # A class is summed up over its distinct texts, a text over its copies; neither may be a hot key.
    owner = scratch.stage(nodes.join(roots, "node", "left").select("k1", "k2", "rep", "copies", F.coalesce("root", "node").alias("root")), "owner")
    classes = owner.groupBy("root").agg(F.max("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("_texts"))
    owner = join_groups(owner, scratch.stage(classes, "classes"), ["root"], "_texts", texts).select("k1", "k2", "class_id", "class_size", "copies")
    owner = scratch.stage(owner, "owned")
    scratch.drop("members0", "members1", "sizes", "sets", "chosen", "links1", "roots0", "owner", "classes", "met")
    alone = found.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    every = join_groups(found.filter("n > 0").select("doc_id", "k1", "k2"), owner, ["k1", "k2"], "copies", total).select("doc_id", "class_id", "class_size").unionByName(alone)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))).withColumnRenamed("doc_id", id_col)


def _sets(src: DataFrame, nodes: DataFrame, chosen: DataFrame, width: int, max_shared: int, scratch: Scratch) -> DataFrame:
    """The distinct shingles (node, shingles) of the chosen nodes."""
    chosen = scratch.stage(nodes.join(chosen, "node").select("node", "k1", "k2", "rep"), "chosen")
    wanted = None
    if chosen.count() <= max_shared:  # the list of wanted texts goes to every task only below this size
        got = chosen.select("k1", F.coalesce("rep", F.lit(np.iinfo(np.int64).min)).alias("rep")).toPandas().sort_values("k1")
        wanted = (got["k1"].to_numpy(np.int64), got["rep"].to_numpy(np.int64))
    sets = shingle_sets(src, width, wanted).join(chosen.select("node", "k1", "k2"), ["k1", "k2"]).select("node", "shingles")
    return scratch.stage(sets.dropDuplicates(["node"]), "sets")


def _linked(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches the bound."""
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _across(sets: DataFrame, members: DataFrame, similarity: float, block: int, scratch: Scratch) -> DataFrame:
    """Links between the classes of each bucket, as pairs of roots, from all its pairs of nodes of different classes.

    Members are (node, n, bucket, root). A bucket's largest class and the rest are cut into parts of
    about `block` nodes and VOLUME shingles; a unit compares two parts. Two parts of the largest
    class never meet, so its nodes travel once for each part of the rest.
    """
    by_class = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("v"))
    sizes = by_class.groupBy("bucket").agg(F.max(F.struct("c", "v", "root")).alias("major"), F.sum("c").alias("c"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    parts = lambda c, v: F.ceil(F.greatest(c / F.lit(block), v / F.lit(VOLUME)))
    sizes = sizes.select("bucket", "c", F.col("major.root").alias("major"), parts(F.col("major.c"), F.col("major.v")).alias("m"), parts(F.col("c") - F.col("major.c"), F.col("v") - F.col("major.v")).alias("r"))
    m, r, own = F.col("m"), F.col("r"), F.col("part")
    met = join_groups(members, scratch.stage(sizes, "met"), ["bucket"], "c", members.count())
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("major"), m).otherwise(r)))
    with_rest = F.transform(F.sequence(F.lit(0), r - 1), lambda j: own * r + j)
    with_major = F.transform(F.sequence(F.lit(0), m - 1), lambda i: i * r + own)
    in_rest = F.transform(F.sequence(F.lit(0), r - 1), lambda j: (m + F.least(own, j)) * r + F.greatest(own, j))
    units = F.when((m == 1) & (r == 1), F.array(F.lit(0).cast("long"))).when(F.col("root") == F.col("major"), with_rest).otherwise(F.concat(with_major, in_rest))
    rows = met.select("node", "root", "bucket", F.explode(units).alias("unit")).join(sets, "node").select("bucket", "unit", "root", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def links() -> np.ndarray:
            root, lists = pa.concat_arrays([h.column(2) for h in held]), pa.concat_arrays([h.column(3) for h in held])
            return class_links(np.asarray(root), np.asarray(pa.compute.list_value_length(lists)), np.asarray(lists.flatten()), similarity)

        for batch in batches:
            bucket, unit, found = np.asarray(batch.column(0)), np.asarray(batch.column(1)), []
            cuts = (np.flatnonzero((bucket[1:] != bucket[:-1]) | (unit[1:] != unit[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if lo < hi:
                    if held and key != (bucket[lo], unit[lo]):
                        found.append(links())
                        held.clear()
                    key = (bucket[lo], unit[lo])
                    held.append(batch.slice(lo, hi - lo))
            yield from _pairs(found)
        yield from _pairs([links()] if held else [])

    return rows.repartition("bucket", "unit").sortWithinPartitions("bucket", "unit").mapInArrow(run, "a long, b long")


def _pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        both = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def class_links(root: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of roots that connect the classes with texts as similar as the bound, from all pairs of texts.

    Shingles that texts share are columns of a matrix of 0 and 1; its products count the common ones.
    """
    classes, own = np.unique(root, return_inverse=True)
    n, c = len(root), len(classes)
    if c == 1:
        return np.empty((0, 2), np.int64)
    _, column, times = np.unique(shingles, return_inverse=True, return_counts=True)
    doc, shared = np.repeat(np.arange(n), sizes), times[column] > 1
    doc, column = doc[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    common = np.zeros((n, n))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[doc[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    near = common >= similarity * (sizes[:, None] + sizes[None, :] - common)
    near &= own[:, None] != own[None, :]
    a, b = np.nonzero(near)
    linked = np.zeros((c, c), bool)
    linked[own[a], own[b]] = True
    out, left = [], linked.any(1)
    while left.any():  # a star for each group of connected classes
        first = int(left.argmax())
        left[first] = False
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & left)
            left[front] = False
            out.append(np.stack((np.full(len(front), classes[first]), classes[front]), 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)

"""Merkle manifest of a dataset: a digest per row, a ternary tree per group, one root, and a proof for every row.

Rows are numbered within their group by one global sort. Trees are built in blocks of 3^HEIGHT consecutive
nodes: the roots of a level's blocks are the nodes of the next level, until each group has one. Proofs
go down again: the upper path of a block is one row, which travels to the block once, and a traversal of
the block's nodes puts their own paths in front of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

HEIGHT, ARITY = 6, 3
NODE = "g string, pos long, n long, digest binary"


def encoded(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256))


def joined(nodes: list[str]) -> str:
    """The digest of digests, all as hex text."""
    return sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """The node of a height over the leaves start..stop, hashed leaf by leaf; it holds two digests a level at most."""

    def __init__(self, height: int, start: int, stop: int):
        self.height, self.at, self.stop, self.value = height, start, stop, None
        self.pending: list[list[str]] = [[] for _ in range(height)]

    def tail(self) -> int:
        """Height of the lowest digest held."""
        return next((h for h, run in enumerate(self.pending) if run), self.height)

    def push(self, leaf: str) -> None:
        self.at += 1
        for run in self.pending:
            run.append(leaf)
            if len(run) < ARITY:
                break
            leaf = joined(run)
            run.clear()
        else:
            self.value = leaf
        if self.value is None and self.at == self.stop:  # the last run of each level is as long as it is
            last: list[str] = []
            for run in self.pending:
                run.extend(last)
                last = [joined(run)] if run else []
                run.clear()
            self.value = last[0]


class Ahead:
    """The nodes of a level's next run that will stand to the right of its first one."""

    def __init__(self, level: int, run: int, total: int):
        width = ARITY**level
        starts = [x * width for x in range(ARITY * run + 1, ARITY * (run + 1)) if x * width < total]
        self.todo = [Treehash(level, s, min(s + width, total)) for s in starts]
        self.ready: list[str] = []

    def tail(self) -> int:
        return self.todo[0].tail()

    def push(self, leaves: list[str]) -> None:
        one = self.todo[0]
        one.push(leaves[one.at])
        if one.value is not None:
            self.ready.append(one.value)
            self.todo.pop(0)

    def finished(self, leaves: list[str]) -> list[str]:
        while self.todo:
            self.push(leaves)
        return self.ready


class Traversal:
    """Authentication paths of a block's leaves, one after the other.

    Of each level it holds the siblings of the current node: those to the left are what is pending of the
    leaves passed, those to the right were hashed ahead while the run before was passed. A leaf is given to the
    runs ahead two thirds of a level's height times for each leaf passed, always to the one whose lowest digest is
    lowest, so that few of them are under way at once and the memory is a small multiple of the height.
    """

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height = leaves, height
        self.passed = Treehash(height, 0, len(leaves))
        self.right = [Ahead(h, 0, len(leaves)).finished(leaves) for h in range(height)]
        self.ahead = [Ahead(h, 1, len(leaves)) for h in range(height)]
        self.late = 0

    def held(self) -> int:
        """Digests held now, without the leaves."""
        return sum(map(len, self.right)) + sum(map(len, self.passed.pending)) + sum(len(a.ready) + sum(len(r) for t in a.todo for r in t.pending) for a in self.ahead)

    def paths(self) -> Iterator[list[tuple[list[str], list[str]]]]:
        """For each leaf its siblings, (left, right) of each level from below."""
        budget = -(-self.height * (ARITY - 1) // ARITY)
        for i, leaf in enumerate(self.leaves):
            for h in range(self.height if i else 0):
                if i % ARITY ** (h + 1) == 0:
                    self.late += sum(t.stop - t.at for t in self.ahead[h].todo)
                    self.right[h] = self.ahead[h].finished(self.leaves)
                    self.ahead[h] = Ahead(h, i // ARITY ** (h + 1) + 1, len(self.leaves))
                elif i % ARITY**h == 0:
                    self.right[h] = self.right[h][1:]
                else:
                    break
            yield [(self.passed.pending[h], self.right[h]) for h in range(self.height)]
            self.passed.push(leaf)
            for _ in range(budget):
                lowest = min((a for a in self.ahead if a.todo), key=Ahead.tail, default=None)
                if lowest is None:
                    break
                lowest.push(self.leaves)


def height_over(n: int) -> int:
    """Levels from n nodes to one."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and its path give. A path is the levels from below, `left|right`, with slashes between."""
    for level in path.split("/") if path else ():
        left, right = level.split("|")
        leaf = sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def _rows(batches, names: tuple[str, ...]):
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in names), strict=True)


def _out(rows, names: tuple[str, ...], kinds: tuple, size: int = 5000):
    import itertools

    import pyarrow as pa

    while held := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], list(names))


def numbered(rows: DataFrame, group: str, order: list[str], ranges: int, scratch: Scratch, name: str) -> DataFrame:
    """Adds `pos`, the row's place in its group from 0, and `n`, the group's rows.

    The sort is in ranges of (group, order), so a group may lie in many of them; equal rows are told apart by number.
    """
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, group, *order, "_row")
    dealt = scratch.stage(dealt.withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order, "_row")) - 1
    return dealt.withColumn("_place", place).join(counts, [group, "_part"]).withColumn("pos", F.col("_before") + F.col("_place")).drop("_row", "_part", "_place", "_before")


def _blocks(level: DataFrame, height: int) -> DataFrame:
    return level.withColumn("blk", F.floor(F.col("pos") / ARITY**height))


def block_roots(level: DataFrame, height: int) -> DataFrame:
    """The next level: a node (g, pos, n, digest) for each block of nodes."""
    width = ARITY**height

    def run(batches):
        import pyarrow as pa

        def roots():
            block, tree = None, None
            for g, blk, n, node in _rows(batches, ("g", "blk", "n", "digest")):
                if (g, blk) != block:
                    block = (g, blk)
                    tree = Treehash(min(height, height_over(n)), 0, min(width, n - blk * width))
                tree.push(node.hex())
                if tree.value is not None:
                    yield g, blk, -(-n // width), bytes.fromhex(tree.value)

        yield from _out(roots(), ("g", "pos", "n", "digest"), (pa.string(), pa.int64(), pa.int64(), pa.binary()))

    rows = _blocks(level, height).select("g", "blk", "pos", "n", "digest").repartition("g", "blk").sortWithinPartitions("g", "blk", "pos")
    return rows.mapInArrow(run, NODE)


def with_paths(level: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """Rows (g, pos, digest, id, other, path, top) of a level's nodes. `upper` has a row (g, pos, path, top) for each block."""
    width = ARITY**height

    def run(batches):
        import pyarrow as pa

        def block_paths(g, above, top, n, held):
            tree = Traversal([x[1].hex() for x in held], min(height, height_over(n)))
            for (pos, node, i, other), levels in zip(held, tree.paths(), strict=True):
                own = "/".join(f"{''.join(left)}|{''.join(right)}" for left, right in levels)
                yield g, pos, node, i, other, "/".join(filter(None, (own, above))), top

        def paths():
            above = top = None
            held: list[tuple] = []
            for g, kind, n, pos, node, i, other, path, root in _rows(batches, ("g", "kind", "n", "pos", "digest", "id", "other", "path", "top")):
                if kind == 0:
                    above, top = path, root
                    continue
                held.append((pos, node, i, other))
                if pos == n - 1 or (pos + 1) % width == 0:
                    yield from block_paths(g, above, top, n, held)
                    held = []

        kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.binary())
        yield from _out(paths(), ("g", "pos", "digest", "id", "other", "path", "top"), kinds, 1000)

    own = _blocks(level, height).withColumn("kind", F.lit(1))
    if "id" not in level.columns:
        own = own.withColumn("id", F.lit(None).cast("long")).withColumn("other", F.lit(None).cast("binary"))
    first = upper.select("g", F.col("pos").alias("blk"), "path", "top").withColumn("kind", F.lit(0))
    rows = first.unionByName(own, allowMissingColumns=True).select("g", "blk", "kind", "pos", "n", "digest", "id", "other", "path", "top")
    return rows.repartition("g", "blk").sortWithinPartitions("g", "blk", "kind", "pos").mapInArrow(run, "g string, pos long, digest binary, id long, other binary, path string, top binary")


def _levels(level: DataFrame, height: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels of a forest from its leaves up, until every group has one node."""
    found = [level]
    while (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
        found.append(scratch.stage(block_roots(found[-1], height), f"{name}{len(found)}"))
    return found


def _down(levels: list[DataFrame], paths: DataFrame, height: int, scratch: Scratch, name: str) -> DataFrame:
    """Paths of the lowest level's nodes, from those of the highest."""
    for k, level in reversed(list(enumerate(levels[:-1]))):
        found = with_paths(level, paths, height)
        paths = scratch.stage(found.select("g", "pos", "path", "top"), f"{name}{k}") if k else found
    return paths


def manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), height: int = HEIGHT, ranges: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The first of `columns` is the id, the second the group, the last is replaced by `tampered` where that is
    given and differs. Leaves ascend by id in their group (null first; rows that repeat an id by their digest), groups
    by name (null first). Rows that repeat one another are leaves of their own. proof_sha256 is the digest
    of all siblings on the way to the root, from below, each run's from left to right; folded_root is what
    the leaf of the tampered row and the original siblings give. A null text and an empty one have
    different leaves. A table of one row has its leaf as root and no siblings. Extra columns are not
    read; an empty table gives no rows. A group of any size is spread over ranges and blocks.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    of = [F.col(c) for c in columns]
    leaf = digest(of)
    changed = F.lit(None).cast("binary") if tampered is None else F.when(~tampered.eqNullSafe(of[-1]), digest([*of[:-1], tampered]))
    # "=" before a name keeps null, which has none, apart from and below all names.
    leaves = docs.select(of[0].cast("long").alias("id"), F.concat(F.lit("="), of[1].cast("string")).alias("g"), leaf.alias("digest"), changed.alias("other"))
    leaves = scratch.stage(numbered(leaves.withColumn("g", F.coalesce("g", F.lit(""))), "g", ["id", "digest"], ranges, scratch, "sorted"), "leaves")
    groups = _levels(leaves, height, scratch, "level")
    tops = groups[-1].select(F.col("g").alias("name"), "digest", F.lit("").alias("g"))
    tops = scratch.stage(numbered(tops, "g", ["name"], ranges, scratch, "tops_sorted"), "tops")
    upper = _levels(tops, height, scratch, "top")
    found = upper[-1].select("digest").first()  # one row
    root = bytes(found["digest"]).hex() if found else ""

    whole = _down(upper, upper[-1].select("g", "pos", F.lit("").alias("path"), F.lit(None).cast("binary").alias("top")), height, scratch, "top_path")
    whole = tops.join(whole.select("pos", "path"), "pos").select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("top"))
    whole = scratch.stage(whole, "group_paths")
    if len(groups) == 1:  # every group has one leaf
        whole = leaves.join(whole.drop("pos"), "g").select("g", "pos", "digest", "id", "other", "path", "top")
    else:
        whole = _down(groups, whole, height, scratch, "path")

    def run(batches):
        import pyarrow as pa

        def proofs():
            for i, node, other, path, top in _rows(batches, ("id", "digest", "other", "path", "top")):
                got = folded((node if other is None else other).hex(), path)
                yield i, node.hex(), top.hex(), root, sha256(path.replace("/", "").replace("|", "").encode()).hexdigest(), got, got == root

        kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
        yield from _out(proofs(), ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), kinds)

    return whole.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumnRenamed("doc_id", columns[0])

"""The Merkle manifest against trees built level by level, and the traversal's memory."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from swarmlake.llm.merkle import Traversal, folded, height_over, manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, pos long, g string, kind int"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_path(nodes, at):
    """The root, and the siblings of a leaf: (left, right) of each level."""
    path = []
    while len(nodes) > 1:
        run = at // 3 * 3
        path.append((nodes[run:at], nodes[at + 1 : run + 3]))
        nodes, at = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], at // 3
    return nodes[0], path


def leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def expected(rows, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subs = [plain_path([leaf(r) for r in groups[g]], 0)[0] for g in names]
    out = []
    for k, g in enumerate(names):
        root, above = plain_path(subs, k)
        for at, r in enumerate(groups[g]):
            levels = plain_path([leaf(x) for x in groups[g]], at)[1] + above
            got = leaf((*r[:4], changed(r)))
            for left, right in levels:
                got = h("".join([*left, got, *right]))
            out.append((r[0], leaf(r), subs[k], root, h("".join("".join(a + b) for a, b in levels)), got, got == root))
    return sorted(out, key=str)


def got(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 5, "x", 0) for r in rows], DOCS)
    lost = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in manifest(docs, tampered=lost, **how).collect()), key=str)


def changed(r):
    return r[4].replace("\n", "") if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4]


def corpus(seed, n):
    r = random.Random(seed)
    rows = [(i, "hot" if i % 3 else r.choice([None, "", "a", "ä", "Z", f"s{i}"]), r.choice(["en", None]), r.choice([1, None]), r.choice(["a\nb", "ab", "", None, "ü" * 3000 + "\n"])) for i in range(n)]
    return [*rows, (None, "hot", None, None, None), (None, None, None, None, None), *rows[:3], rows[1]]


@pytest.mark.parametrize(("height", "ranges", "n"), [(1, 3, 100), (2, 9, 200), (6, 4, 60)])
def test_manifest(spark, height, ranges, n):
    rows = corpus(n, n)
    assert got(spark, rows, height=height, ranges=ranges) == expected(rows, changed)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "x\n")], [(2, "a", "en", 1, "x\n")], [(1, s, "en", 1, "x") for s in "abcd"], [(i, None, "en", 1, "x\n") for i in range(10)]])
def test_small_tables(spark, rows):
    assert got(spark, rows, height=1) == (expected(rows, changed) if rows else [])


@pytest.mark.parametrize("n", [*range(1, 31), 80, 81, 82, 243, 300, 728, 729])
def test_traversal(n):
    """The paths of every leaf; no run is hashed late, and few digests are held."""
    leaves = [h(str(i)) for i in range(n)]
    tree = Traversal(leaves, height_over(n))
    most = tree.held()
    for i, levels in enumerate(tree.paths()):
        assert levels == plain_path(leaves, i)[1]
        most = max(most, tree.held())
        path = "/".join(f"{''.join(a)}|{''.join(b)}" for a, b in levels)
        assert folded(leaves[i], path) == plain_path(leaves, i)[0]
    assert most <= 5 * max(1, height_over(n))
    assert tree.late == 0

"""Exact dedup by deterministic block naming, in DataFrame operations only.

Every normalised text is cut into blocks of a fixed number of bytes. Equal blocks get one integer
name: the distinct blocks are dealt to small buckets by a hash and sorted there by their bytes; a
name is the bucket and the rank in it. Names of adjacent blocks are paired and the distinct pairs
named the same way, until one name is left per document. The names come from sorting the exact
content, so equal names mean equal texts; a hash only chooses where a block is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANK_BITS = 22  # distinct items in one bucket; a bucket gets PER_BUCKET on average
PER_BUCKET = 48


def normalised(text: Column) -> Column:
    """Null counts as empty; only A-Z are lower-cased. The result is UTF-8 bytes."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # there both are the same, and lower() is faster
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)).cast("binary")


def hashes(item: Column) -> list[Column]:
    return [F.xxhash64(item), F.xxhash64(F.lit("second"), item)]


def named(items: DataFrame, column: str, expected: int) -> DataFrame:
    """The distinct values of a binary column as rows (column, name, unsure).

    One exchange, combined on the map side, deals them to buckets; there a sort ranks them. unsure
    tells that two values of the bucket share both hashes of `hashes`.
    """
    buckets = max(64, expected // PER_BUCKET)
    sets = items.groupBy(F.pmod(F.xxhash64(column), F.lit(buckets)).alias("_bucket")).agg(F.sort_array(F.collect_set(column)).alias("_all"))
    keys = F.transform("_all", lambda x: F.struct(*hashes(x)))
    return sets.select(
        "_bucket", (F.size(F.array_distinct(keys)) < F.size("_all")).alias("unsure"), F.posexplode("_all").alias("_rank", column)
    ).select(column, (F.shiftleft(F.col("_bucket"), RANK_BITS) + F.col("_rank")).alias("name"), "unsure")


def named_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, total_bytes: int, scratch: Scratch) -> DataFrame:
    """A row (_id, _sha, _len, _pos, name) for each block of each document."""
    src = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_t")).select(
        "_id", F.unhex(F.sha2("_t", 256)).alias("_sha"), F.octet_length("_t").alias("_len"), "_t"
    )
    last = F.greatest(F.lit(0), F.floor((F.col("_len") - 1) / F.lit(block_bytes))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("_t"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = src.select("_id", "_sha", "_len", F.posexplode(cut).alias("_pos", "_block"))
    h1, h2 = hashes(F.col("_block"))
    # A block travels once, in its distinct form. Its occurrences find the name by two hashes, if
    # no distinct blocks of the bucket share them; the blocks of other buckets find it by the bytes.
    names = named(blocks, "_block", total_bytes // block_bytes).select(h1.alias("_h1"), h2.alias("_h2"), "name", F.when(F.col("unsure"), F.col("_block")).alias("_block"))
    names = scratch.stage(names, "blocks")
    keys = ["_id", "_sha", "_len", "_pos"]
    sure = names.filter("_block is null").drop("_block")
    level = blocks.select(*keys, h1.alias("_h1"), h2.alias("_h2")).join(sure, ["_h1", "_h2"]).select(*keys, "name")
    unsure = names.filter("_block is not null").select("_block", "name")
    if not unsure.isEmpty():
        level = level.unionByName(blocks.join(unsure, "_block").select(*keys, "name"))
    return level


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1024) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Of equal texts the row with
    the largest id stays; ids of null stand below all others. Rows that repeat one id and text
    count singly in group_size and are all kept if their id stays. Extra columns are not read; an
    empty table gives an empty result. The SHA-256 of the normalised text is returned, and tells
    the rows of one repeated id apart; the groups come from the names alone.
    """
    scratch = Scratch(docs.sparkSession, "naming")
    size = docs.select(F.octet_length(F.col(text_col).cast("string")).cast("long").alias("n")).agg(F.sum("n"), F.max("n")).first()
    total, longest = size[0] or 0, size[1] or 0
    level = scratch.stage(named_blocks(docs, id_col, text_col, block_bytes, total, scratch), "level0")
    scratch.drop("blocks")
    rows = scratch.stage(level.filter("_pos = 0").groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("_rows")), "rows")

    width, k, done = 1, 0, []
    while width * block_bytes < longest:
        # Documents of one name are finished; the second half of a pair is -1 past a text's end.
        over = F.col("_len") <= width * block_bytes
        done.append(level.filter(over).select("_id", "_sha", "name"))
        odd = F.col("_pos") % 2 == 1
        pairs = level.filter(~over).groupBy("_id", "_sha", "_len", F.floor(F.col("_pos") / 2).cast("int").alias("_pos")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("_left"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("_right")
        )
        joined = F.concat(F.unhex(F.lpad(F.hex("_left"), 16, "0")), F.unhex(F.lpad(F.hex("_right"), 16, "0")))
        pairs = scratch.stage(pairs.select("_id", "_sha", "_len", "_pos", joined.alias("_pair")), f"pairs{k}")
        names = named(pairs, "_pair", total // (2 * width * block_bytes)).drop("unsure")
        level = scratch.stage(pairs.join(names, "_pair").select("_id", "_sha", "_len", "_pos", "name"), f"level{k + 1}")
        scratch.drop(f"pairs{k}")
        width, k = width * 2, k + 1
    done.append(level.select("_id", "_sha", "name"))
    # A name is unique within its level, and a text's length fixes the level where it finishes.
    finished = [part.distinct().withColumn("_level", F.lit(i)) for i, part in enumerate(done)]
    named_docs = finished[0]
    for part in finished[1:]:
        named_docs = named_docs.unionByName(part)
    match = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._sha") == F.col("b._sha"))
    full = scratch.stage(rows.alias("a").join(named_docs.alias("b"), match).select("a._id", "a._sha", "_rows", "_level", "name"), "full")
    groups = full.groupBy("_level", "name").agg(F.max("_id").alias("keep_id"), F.sum("_rows").alias("group_size"), F.count(F.lit(1)).alias("_members"))
    groups = scratch.stage(groups, "groups")
    scratch.drop("rows", *(f"level{i}" for i in range(k + 1)))
    return join_groups(full, groups, ["_level", "name"], "_members", full.count()).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"),
    ).drop("_copy")

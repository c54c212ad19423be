"""Routing-table operators: XOR nearest neighbours, predicates, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import K_NEAREST, LOOKUP_PEERS, MAX_HASHES, MAX_PEERS, NEAR

LIMBS = ((1, 14), (15, 14), (29, 12))  # hex digits of a 20-byte id; each limb fits a signed long


def xor_distance(id_hex: Column, target_hex: Column) -> list[Column]:
    """Limbs whose lexicographic order is that of the bytewise XOR."""
    part = lambda h, a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long")
    return [part(id_hex, a, n).bitwiseXOR(part(target_hex, a, n)) for a, n in LIMBS]


def closest(nodes: DataFrame, target_hex: Column, k: int = K_NEAREST, id_col: str = "id") -> DataFrame:
    """Live nodes nearest to a target; equal distances keep the order of insertion. A top-k, not a sort."""
    return nodes.filter(~F.col("dropped")).orderBy(*xor_distance(F.col(id_col), target_hex), "insert_seq").limit(k)


def evicted(table: DataFrame, arriving: DataFrame, origin_hex: Column, capacity: int = K_NEAREST) -> DataFrame:
    """The table after inserts at capacity: the nodes nearest to its origin."""
    return table.unionByName(arriving).orderBy(*xor_distance(F.col("id"), origin_hex), "insert_seq").limit(capacity)


def stale(nodes: DataFrame, cutoff: int, n: int) -> DataFrame:
    """The first inserted live nodes that last answered before the cutoff."""
    return nodes.filter((F.col("last_responded") < cutoff) & ~F.col("dropped")).orderBy("insert_seq").limit(n)


def sample_ready(nodes: DataFrame, now: int, n: int) -> DataFrame:
    return nodes.filter(F.col("bep51") & (F.col("next_at") <= now) & ~F.col("dropped")).orderBy("insert_seq").limit(n)


def feed(nodes: DataFrame, now: int, cutoff: int, n: int) -> DataFrame:
    """Nodes ready for sampling, topped up with stale ones; a node can come twice."""
    ready, old = sample_ready(nodes, now, n).withColumn("_feed", F.lit(0)), stale(nodes, cutoff, n).withColumn("_feed", F.lit(1))
    return ready.unionByName(old).orderBy("_feed", "insert_seq").limit(n)


def unknown(addresses: DataFrame, nodes: DataFrame) -> DataFrame:
    """Addresses that no node has; order and repeats of the input stay."""
    return addresses.join(nodes.select("ip", "port"), ["ip", "port"], "left_anti")


def upserted(table: DataFrame, seen: DataFrame) -> DataFrame:
    """For each seen node the first table row with its id or its address, by two equi joins."""
    by_id = seen.join(table.groupBy("id").agg(F.min("insert_seq").alias("s1")), "id", "left")
    by_addr = table.groupBy("ip", "port").agg(F.min("insert_seq").alias("s2"))
    return by_id.join(by_addr, ["ip", "port"], "left").withColumn("matched", F.least("s1", "s2")).drop("s1", "s2")


def without(nodes: DataFrame, ids: list[str] = (), ips: list[str] = ()) -> DataFrame:
    """Nodes left after removals by id and by address, whatever the port."""
    return nodes.filter(~F.col("id").isin(list(ids)) & ~F.col("ip").isin(list(ips)))


def last_announced(announces: DataFrame) -> DataFrame:
    """Peers of each hash by its last announce, at most MAX_PEERS."""
    return announces.groupBy("infohash").agg(F.slice(F.max_by("peers", "seq"), 1, MAX_PEERS).alias("peers"))


def peers_or_nodes(asked: DataFrame, announced: DataFrame, table: DataFrame, k: int = K_NEAREST) -> DataFrame:
    """Answers to lookups (asked, infohash hex): the hash's peers, else the `k` live nodes nearest to it; and a token.

    The table is that of one node, at most K_NEAREST rows, and is known to all tasks.
    """
    live = table.filter(~F.col("dropped")).orderBy("insert_seq").limit(K_NEAREST)
    nodes = live.agg(F.array_sort(F.collect_list(F.struct("insert_seq", "id"))).alias("_nodes"))
    found = asked.join(announced, "infohash", "left").join(F.broadcast(nodes))  # a single row
    ranked = F.transform("_nodes", lambda n: F.struct(*(d.alias(f"d{i}") for i, d in enumerate(xor_distance(n["id"], F.col("infohash")))), n["insert_seq"].alias("seq"), n["id"].alias("id")))
    near = F.transform(F.slice(F.array_sort(ranked), 1, k), lambda n: n["id"])
    has = F.col("peers").isNotNull()
    return found.select(
        *asked.columns, F.when(has, "peers").otherwise("nodes").alias("branch"), F.when(has, F.col("peers")).otherwise(F.array().cast("array<string>")).alias("values"),
        F.when(has, F.array().cast("array<string>")).otherwise(near).alias("nodes"), token(F.col("infohash")).alias("token"),
    )


def token(infohash_hex: Column) -> Column:
    """The token of an answer: the hash's first four bytes, in hex."""
    return F.substring(infohash_hex, 1, 8)


def held_hashes(announces: DataFrame, capacity: int = MAX_HASHES) -> DataFrame:
    """The table of announced hashes: a full table rejects new ones; those in it keep the peers of their last announce."""
    first = announces.groupBy("infohash").agg(F.min("seq").alias("_first"))
    kept = first.orderBy("_first", "infohash").limit(capacity)
    return last_announced(announces.join(F.broadcast(kept.select("infohash")), "infohash", "left_semi"))


def lookup_peers(held: DataFrame, n: int = LOOKUP_PEERS) -> DataFrame:
    return held.withColumn("peers", F.slice("peers", 1, n))


def sample(rows: DataFrame, n: int, seed: str, key: str = "id") -> DataFrame:
    """`n` rows drawn without replacement, in the order of a seeded hash of their key: a rerun draws the same, however rows are dealt."""
    return rows.orderBy(F.sha1(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def split_two_ways(rows: DataFrame, seed: str, key: str = "id") -> DataFrame:
    """Adds `way`, find or sample, by an unbiased seeded hash of the key."""
    low = F.conv(F.substring(F.sha1(F.concat(F.col(key).cast("string"), F.lit(seed))), 40, 1), 16, 10).cast("int")
    return rows.withColumn("way", F.when(low < 8, "find").otherwise("sample"))


def bootstrap(known: DataFrame, answers: Callable[[DataFrame], DataFrame], target_hex: Column, fan: int = NEAR, enough: int = 50, rounds: int = 20) -> DataFrame:
    """Nodes (id) that are known after asking, round by round, the `fan` closest to the target for theirs: `answers` maps asked nodes (id) to (id, neighbour).

    It ends once more than `enough` are known. What is known stays small, as each round adds the answers of a few.
    """
    ids = {r["id"] for r in known.select("id").collect()}  # the seeds of a node
    spark = known.sparkSession
    for _ in range(rounds):
        now = spark.createDataFrame([(i,) for i in sorted(ids)], "id string")
        near = now.orderBy(*xor_distance(F.col("id"), target_hex), "id").limit(fan)
        told = {r["neighbour"] for r in answers(near).select("neighbour").distinct().collect()}
        if told <= ids:  # the same nodes would be asked again
            break
        ids |= told
        if len(ids) > enough:
            break
    return spark.createDataFrame([(i,) for i in sorted(ids)], "id string")


def merged(table: DataFrame, seen: DataFrame, origin_hex: Column, capacity: int = K_NEAREST) -> DataFrame:
    """The table after a batch of nodes (id, ip, port, at, responded, insert_seq, event_id).

    A node that is known by its id or its address is renewed in its first row, at the time it responded; a
    new one that did not respond starts an hour old. At capacity the nodes nearest to the origin stay.
    """
    arrived = seen.groupBy("id").agg(F.min(F.struct("event_id", "insert_seq", "ip", "port", "at")).alias("x"), F.max(F.when(F.col("responded"), F.col("at"))).alias("answered"))
    arrived = arrived.select("id", "x.insert_seq", "x.ip", "x.port", F.coalesce("answered", F.col("x.at") - 3600).alias("last_responded"), "answered")
    matched = upserted(table, arrived)
    renewed = matched.filter("matched is not null").groupBy(F.col("matched").alias("insert_seq")).agg(F.max("answered").alias("answered"))
    old = table.join(renewed, "insert_seq", "left").withColumn("last_responded", F.coalesce(F.greatest("last_responded", "answered"), F.col("last_responded"))).drop("answered")
    new = matched.filter("matched is null").select("id", "ip", "port", "last_responded", "insert_seq")
    rows = old.select("id", "ip", "port", "last_responded", "insert_seq").unionByName(new)
    return rows.orderBy(*xor_distance(F.col("id"), origin_hex), "insert_seq").limit(capacity)


def bounded_channel(rows: DataFrame, tick: str, order: str, capacity: int, lossy: Column) -> DataFrame:
    """What passes a channel that takes `capacity` rows a tick: lossy rows beyond it are dropped, others wait and all arrive.

    A tick's lossy rows are ranked in one task; of each earlier task no more than `capacity` of them come there.
    """
    ranked = rows.filter(lossy).withColumn("_n", F.row_number().over(Window.partitionBy(tick).orderBy(order))).filter(F.col("_n") <= capacity).drop("_n")
    return rows.filter(~lossy).unionByName(ranked)


# Seconds between runs of the periodic chores.
TIMERS = {"rotate": 10, "prune": 10, "reseed": 60, "feed": 1}
PRUNE_AGE, PRUNE_MOST = 900, 20


def due(second: Column) -> list[Column]:
    """For a second since the start, which chores run then."""
    return [((second > 0) & (second % every == 0)).alias(name) for name, every in TIMERS.items()]


def pruned(nodes: DataFrame, now: int) -> DataFrame:
    """Nodes a pruning run asks again: the first PRUNE_MOST that were silent for PRUNE_AGE seconds."""
    return stale(nodes, now - PRUNE_AGE, PRUNE_MOST)

"""Which shard or node owns a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T

VIRTUAL = 150


def ring_hash(key: Column) -> Column:
    """The first 8 bytes of MD5 as a signed long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, -10).cast("bigint")


def ring(spark: SparkSession, nodes: list[str], virtual: int = VIRTUAL) -> DataFrame:
    """position, node: the virtual nodes of a consistent-hash ring."""
    rows = spark.createDataFrame([(n,) for n in nodes], "node string").select("node", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("i"))
    return rows.select(ring_hash(F.concat_ws("#", "node", "i")).alias("position"), "node")


def owner(keys: DataFrame, ring_rows: DataFrame, column: str = "key") -> DataFrame:
    """Keys with their node: the first virtual node at or after the key's hash, else the first of all.

    The ring is nodes x 150 rows, sorted into one array; a key finds its place by binary search, so keys aren't shuffled.
    """
    table = ring_rows.agg(F.sort_array(F.collect_list(F.struct("position", "node"))).alias("ring"))
    rows = keys.withColumn("_h", ring_hash(F.col(column))).crossJoin(F.broadcast(table))  # one row
    steps = F.sequence(F.lit(1), F.lit(20))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        open_ = a["lo"] < a["hi"]
        less = F.get(F.col("ring"), mid)["position"] < F.col("_h")
        return F.struct(F.when(open_ & less, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~less, mid).otherwise(a["hi"]).alias("hi"))

    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size("ring").alias("hi")), halve)["lo"]
    return rows.withColumn("node", F.get(F.col("ring"), F.pmod(at, F.size("ring")))["node"]).drop("_h", "ring")


def shard_of(key: Column, shards: int) -> Column:
    return (T.code_hash(key).bitwiseAND(F.lit(2147483647)) % shards).cast("int")


def replicas(sorted_ring: list[tuple[int, str]], position: int, count: int) -> list[str]:
    """The next distinct nodes on a ring from a position on."""
    start = next((i for i, (p, _) in enumerate(sorted_ring) if p >= position), 0)
    found: list[str] = []
    for i in range(len(sorted_ring)):
        node = sorted_ring[(start + i) % len(sorted_ring)][1]
        if node not in found:
            found.append(node)
        if len(found) == count:
            break
    return found


def rebalance(shards: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(shard, from, to): nodes above twice the mean hand shards to those below it, until either side is done. A plan over a few nodes: plain Python."""
    if not shards:
        return []
    load = {n: list(s) for n, s in shards.items()}
    mean = sum(map(len, load.values())) / len(load)
    moves = []
    for n in sorted(load, key=lambda n: (-len(load[n]), n)):
        while len(load[n]) > 2 * mean:
            to = min((x for x in load if len(load[x]) < mean), key=lambda x: (len(load[x]), x), default=None)
            if to is None:
                return moves
            shard = load[n].pop()
            load[to].append(shard)
            moves.append((shard, n, to))
    return moves


def route(shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """shard, node: the primary if it is online, else the first online replica; shards (shard, node, is_primary, replica_no), nodes (node, online)."""
    up = shards.join(nodes.where("online").select("node"), "node")
    return up.groupBy("shard").agg(F.min_by("node", F.struct(~F.col("is_primary"), F.col("replica_no"))).alias("node"))


def migrations(keys: DataFrame, old: int, new: int, column: str = "key") -> DataFrame:
    """Keys that move when a table of ``old`` shards becomes one of ``new``, with from_shard and to_shard. Narrow."""
    rows = keys.withColumns({"from_shard": shard_of(F.col(column), old), "to_shard": shard_of(F.col(column), new)})
    return rows.where("from_shard <> to_shard")


def gather(results: DataFrame, answered: DataFrame) -> DataFrame:
    """Results (.., shard) of the shards that answered in time (shard, in_time), with partial: whether any shard is missing."""
    missing = answered.agg(F.bool_or(~F.col("in_time")).alias("partial"))
    return results.join(answered.where("in_time").select("shard"), "shard", "left_semi").crossJoin(F.broadcast(missing))  # one row

"""Cluster metadata as tables: assignment of partitions, membership, failures, coordinator, quorum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.errors import InvalidArgument
from shardloom.functions.placement import CACHE_PARTITIONS


def assign(spark: SparkSession, nodes: DataFrame, partitions: int = CACHE_PARTITIONS, backups: int = 1) -> DataFrame:
    """partition_id, owner, backups: round robin over the distinct addresses in order.

    Backups are the next nodes, never the owner; with more backups than other nodes they repeat, with one node there
    are none, without nodes there are no rows. A node list is a catalogue: it is small whatever the data.
    """
    if partitions <= 0 or backups < 0:
        raise InvalidArgument("partitions must be above 0 and backups not negative")
    ordered = nodes.where("address IS NOT NULL").agg(F.array_sort(F.collect_set("address")).alias("all"))
    n = F.size("all")
    at = F.col("partition_id") % n
    owner = F.element_at("all", (at + 1).cast("int"))
    next_ones = F.transform(F.sequence(F.lit(1), F.lit(max(backups, 1))), lambda i: F.element_at("all", ((at + i) % n + 1).cast("int")))
    others = F.filter(next_ones, lambda x: x != owner) if backups else F.array().cast("array<string>")
    ids = spark.range(partitions).select(F.col("id").cast("int").alias("partition_id"))
    return ids.crossJoin(F.broadcast(ordered.where(F.size("all") > 0))).select("partition_id", owner.alias("owner"), others.alias("backups"))


def assignment_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """partition_id, old_owner, new_owner where the owner changed or is new. Partitions of old alone are left out."""
    o = old.select(F.col("partition_id").alias("_p"), F.col("owner").alias("old_owner"))
    both = new.select("partition_id", F.col("owner").alias("new_owner")).join(o, F.col("partition_id") == F.col("_p"), "left")
    return both.where(~F.col("old_owner").eqNullSafe(F.col("new_owner"))).select("partition_id", "old_owner", "new_owner")


def lookup(table: DataFrame) -> DataFrame:
    """address, owned, backed_up: how many partitions each node owns and backs up."""
    owned = table.groupBy(F.col("owner").alias("address")).agg(F.count(F.lit(1)).alias("owned"))
    held = table.select(F.explode(F.array_distinct("backups")).alias("address")).groupBy("address").agg(F.count(F.lit(1)).alias("backed_up"))
    return owned.join(held, "address", "full_outer").select("address", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("backed_up", F.lit(0)).alias("backed_up"))


def shard_nodes(shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """shard_name, address: the shard's place in the order of names, modulo the number of nodes.

    Shards and nodes are catalogues. No nodes give no rows.
    """
    ordered = nodes.where("address IS NOT NULL").agg(F.array_sort(F.collect_set("address")).alias("all")).where(F.size("all") > 0)
    place = F.row_number().over(Window.orderBy("shard_name")) - 1
    return shards.select("shard_name").distinct().withColumn("place", place).crossJoin(F.broadcast(ordered)).select("shard_name", F.element_at("all", (F.col("place") % F.size("all") + 1).cast("int")).alias("address"))


def membership(known: DataFrame, provided: DataFrame, self_address: str | None = None) -> DataFrame:
    """address, change: joined, rejoined or left, of known (address, state) against a provider's addresses.

    A known node whose state is dead or leaving and that is provided again has rejoined. The own node never leaves.
    """
    k = known.select("address", "state").dropDuplicates(["address"])
    p = provided.select("address", F.lit(True).alias("_there")).distinct()
    gone = F.col("state").isin("dead", "leaving")
    change = F.when(F.col("state").isNull(), "joined").when(F.col("_there") & gone, "rejoined").when(F.col("_there").isNull() & ~gone, "left")
    out = k.join(p, "address", "full_outer").withColumn("change", change).where("change IS NOT NULL")
    if self_address is not None:
        out = out.where(~((F.col("change") == "left") & (F.col("address") == self_address)))
    return out.select("address", "change")


def dead_nodes(heartbeats: DataFrame, now, timeout_s: float) -> DataFrame:
    """address, last_heartbeat of nodes whose last heartbeat is older than the timeout; exactly the timeout is alive."""
    last = heartbeats.groupBy("address").agg(F.max("ts").alias("last_heartbeat"))
    return last.where(F.unix_micros("last_heartbeat") + int(timeout_s * 1_000_000) < F.unix_micros(now))


def coordinator(nodes: DataFrame) -> DataFrame:
    """address: the smallest active address; null when no node is active."""
    return nodes.where("state = 'active'").agg(F.min("address").alias("address"))


def quorum_timeline(visible: DataFrame, strict_majority: bool = False) -> DataFrame:
    """at, visible, expected, ok: expected is the most nodes seen so far; one or none expected is always enough.

    visible: at, visible - one row a moment, already aggregated, so that the running maximum sees few rows.
    """
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = F.floor(F.col("expected") / 2) + 1 if strict_majority else F.ceil(F.col("expected") / 2)
    return visible.withColumn("expected", F.max("visible").over(w)).withColumn("ok", (F.col("expected") <= 1) | (F.col("visible") >= need))


def settled(changes: DataFrame, gap: str = "10 seconds") -> DataFrame:
    """start, end, changes: bursts of membership changes (ts); a rebalance may run `gap` after the last of one."""
    return changes.groupBy(F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("changes")).select("w.start", "w.end", "changes")


def newer(tables: DataFrame) -> DataFrame:
    """partition_id, owner, backups, version: of all versions received, the newest of each partition.

    tables: the same columns, from any number of senders in any order. Ties of a version go to the greater owner and
    backups, so that every node comes to the same table.
    """
    last = F.max(F.struct("version", "owner", "backups")).alias("last")
    return tables.where("version IS NOT NULL").groupBy("partition_id").agg(last).select("partition_id", "last.owner", "last.backups", "last.version")


def next_version(table: DataFrame, assignment: DataFrame) -> DataFrame:
    """The table after an assignment: partitions whose owner or backups changed, or that are new, get the next version."""
    old = table.select(F.col("partition_id").alias("_p"), F.col("owner").alias("_o"), F.col("backups").alias("_b"), F.col("version").alias("_v"))
    both = assignment.join(old, F.col("partition_id") == F.col("_p"), "left")
    same = F.col("owner").eqNullSafe(F.col("_o")) & F.col("backups").eqNullSafe(F.col("_b"))
    return both.select("partition_id", "owner", "backups", (F.coalesce("_v", F.lit(0)) + F.when(same, 0).otherwise(1)).cast("long").alias("version"))


def promote(table: DataFrame, dead: DataFrame) -> DataFrame:
    """The table after the owners in `dead` (address) are gone: the first live backup owns their partitions.

    Dead backups leave the lists everywhere. Partitions that changed get the next version; one without a live backup has
    no owner. Dead nodes are a catalogue.
    """
    gone = dead.agg(F.collect_set("address").alias("_dead"))
    rows = table.crossJoin(F.broadcast(gone))
    alive = F.filter("backups", lambda b: ~F.array_contains("_dead", b))
    lost = F.coalesce(F.array_contains("_dead", F.col("owner")), F.lit(False))
    owner = F.when(~lost, F.col("owner")).otherwise(F.get(alive, 0))
    rest = F.when(~lost, alive).otherwise(F.filter(alive, lambda b: ~b.eqNullSafe(owner)))
    changed = lost | (F.size(alive) != F.size("backups"))
    return rows.select("partition_id", owner.alias("owner"), rest.alias("backups"), (F.col("version") + changed.cast("int")).alias("version"))


def health(nodes: DataFrame, heartbeats: DataFrame, table: DataFrame, now, timeout_s: float) -> DataFrame:
    """address, state, is_coordinator, owned, backed_up, silent_s: what a health report says of each node.

    A node that is silent for longer than the timeout is dead whatever its state says.
    """
    last = heartbeats.groupBy("address").agg(F.max("ts").alias("_last"))
    silent = (F.unix_micros(now) - F.unix_micros("_last")) / 1e6
    seen = nodes.join(last, "address", "left").withColumn("silent_s", silent)
    state = F.when(F.col("silent_s") > timeout_s, "dead").otherwise(F.col("state"))
    seen = seen.withColumn("state", state).select("address", "state", "silent_s")
    first = coordinator(seen).select(F.col("address").alias("_c"))
    held = lookup(table)
    out = seen.join(held, "address", "left").crossJoin(F.broadcast(first))
    return out.select("address", "state", F.coalesce(F.col("address") == F.col("_c"), F.lit(False)).alias("is_coordinator"), F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("backed_up", F.lit(0)).alias("backed_up"), "silent_s")

"""Cluster, lock and task queries over suppliers (as nodes), events (as heartbeats and lock requests) and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators import cluster as C
from shardloom.operators import locks, tasks
from shardloom.operators.metrics import metered, reported
from shardloom.sources.tables import table

HOLD_S = 3600.0
DEAD_S = 86_400.0


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier", "s_name", "s_acctbal")
    return s.select(F.col("s_name").alias("address"), F.when(F.col("s_acctbal") >= 0, "active").otherwise("dead").alias("state"))


def _active(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).where("state = 'active'")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))


def rebalance_assign(spark: SparkSession, folder: str) -> DataFrame:
    """Owners and two backups of the 271 partitions."""
    a = C.assign(spark, _active(spark, folder), backups=2)
    return a.select("partition_id", "owner", F.array_join("backups", ",").alias("backups"))


def rebalance_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Partitions that move when the dead nodes go."""
    return C.assignment_diff(C.assign(spark, _nodes(spark, folder)), C.assign(spark, _active(spark, folder)))


def partition_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Partitions owned and backed up by node."""
    return C.lookup(C.assign(spark, _active(spark, folder)))


def coordinator(spark: SparkSession, folder: str) -> DataFrame:
    """The coordinator."""
    return C.coordinator(_nodes(spark, folder))


def shard_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node of every shard."""
    return C.shard_nodes(table(spark, folder, "shards"), _active(spark, folder))


def membership_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Users of January's first half against those of the second; an error leaves a node dead."""
    e = _events(spark, folder).withColumn("address", F.col("user_id").cast("string"))
    half = F.lit("2024-01-16").cast("timestamp")
    last = e.where(F.col("ts") < half).groupBy("address").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"))
    known = last.select("address", F.when(F.col("l.event_type") == "error", "dead").otherwise("active").alias("state"))
    return C.membership(known, e.where(F.col("ts") >= half).select("address"))


def dead_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Users that weren't seen for a day at the end of January."""
    e = _events(spark, folder).select(F.col("user_id").cast("string").alias("address"), "ts")
    return C.dead_nodes(e, F.lit("2024-01-30").cast("timestamp"), DEAD_S).select("address", F.unix_micros("last_heartbeat").alias("last_us"))


def quorum_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """By hour, the users seen against the most seen so far."""
    hour = F.floor(F.unix_seconds("ts") / 3600).alias("at")
    return C.quorum_timeline(_events(spark, folder).groupBy(hour).agg(F.count_distinct("user_id").alias("visible")))


def membership_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of signups and errors with less than ten minutes between them."""
    changes = _events(spark, folder).where(F.col("event_type").isin("signup", "error"))
    return C.settled(changes, "10 minutes").select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "changes")


def cluster_health(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by state and events by kind."""
    nodes = _nodes(spark, folder).groupBy(F.concat(F.lit("nodes_"), "state").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(_events(spark, folder).groupBy(F.concat(F.lit("events_"), "event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n")))


def lock_requests(events: DataFrame) -> DataFrame:
    """Lock events (seq, key, op, owner, ts) out of the events of users."""
    e = events.where("event_type <> 'purchase'")
    op = F.when(F.col("event_type").isin("signup", "view"), "acquire").when(F.col("event_type") == "click", "release").otherwise("force")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 10).cast("string").alias("key"), op.alias("op"), (F.floor(F.col("user_id") / 10) % 3).cast("string").alias("owner"), "ts")


def _lock_events(spark: SparkSession, folder: str) -> DataFrame:
    return lock_requests(_events(spark, folder))


def lock_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts, grants, refreshes and denials of each lock."""
    return locks.counts(locks.timeline(_lock_events(spark, folder), HOLD_S))


def lock_holds(spark: SparkSession, folder: str) -> DataFrame:
    """What each lock event did, where every other acquire asks for a tenth of the hold time, and a release by its event's number for a grant."""
    events = _lock_events(spark, folder).withColumn("hold_s", F.when(F.col("seq") % 2 == 0, HOLD_S / 10))
    return locks.timeline(events.withColumn("grant", F.when((F.col("op") == "release") & (F.col("seq") % 3 == 0), F.col("seq"))), HOLD_S)


def partition_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The partition table after two senders' versions, in the wrong order, and an assignment without the dead nodes."""
    first = C.assign(spark, _nodes(spark, folder), backups=2).withColumn("version", F.lit(1).cast("long"))
    second = C.next_version(first, C.assign(spark, _active(spark, folder), backups=2))
    merged = C.newer(second.unionByName(first))
    return merged.select("partition_id", "owner", F.array_join("backups", ",").alias("backups"), "version")


def partition_promotion(spark: SparkSession, folder: str) -> DataFrame:
    """The partition table after the dead nodes went and backups took over."""
    table_ = C.assign(spark, _nodes(spark, folder), backups=2).withColumn("version", F.lit(1).cast("long"))
    after = C.promote(table_, _nodes(spark, folder).where("state = 'dead'"))
    return after.select("partition_id", "owner", F.array_join("backups", ",").alias("backups"), "version")


def node_health(spark: SparkSession, folder: str) -> DataFrame:
    """A report of each user as a node: state after a day of silence, coordinator, partitions."""
    e = _events(spark, folder).select(F.col("user_id").cast("string").alias("address"), "ts")
    nodes = e.select("address", F.lit("active").alias("state")).distinct()
    now = F.lit("2024-01-30").cast("timestamp")
    return C.health(nodes, e, C.assign(spark, nodes), now, DEAD_S).select("address", "state", "is_coordinator", "owned", "backed_up")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and sums of orders and events, observed while they are read for something else."""
    o, orders = metered(table(spark, folder, "orders"), "orders", cents=F.sum(F.round(F.col("o_totalprice") * 100).cast("long")))
    e, events = metered(_events(spark, folder), "events", users=F.max("user_id"))
    o.select("o_orderkey").write.format("noop").mode("overwrite").save()
    e.select("event_id").write.format("noop").mode("overwrite").save()
    return reported(spark, orders, events)


def task_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tasks of the topic of their status; one topic has no handler."""
    topics = tasks.Topics()
    topics.listen("O", lambda key, message: {"cents": round(message["total"] * 100)})
    topics.listen("F", lambda key, message: {"cents": 0})
    o = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    sent = o.select(F.col("o_orderstatus").alias("topic"), F.col("o_orderkey").cast("string").alias("routing_key"), F.to_json(F.struct(F.col("o_totalprice").alias("total"))).alias("message"))
    done = topics.route(sent, C.assign(spark, _active(spark, folder)))
    return done.groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("response", "$.cents").cast("long")).alias("cents"))


def lock_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """What each lock event did, with the fencing token."""
    return locks.timeline(_lock_events(spark, folder), HOLD_S)


def locks_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Locks held at noon of January 20th."""
    events = _lock_events(spark, folder)
    return locks.held_at(locks.timeline(events, HOLD_S), events, F.lit("2024-01-20 12:00:00").cast("timestamp"), HOLD_S)


def _price(key: str, message: dict) -> dict:
    if message["status"] == "P":
        raise ValueError("pending")
    return {"key": key, "cents": round(message["total"] * 100)}


def task_route(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tasks, by owner and status."""
    o = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    sent = o.select(F.col("o_orderkey").cast("string").alias("routing_key"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))).alias("message"))
    done = tasks.route(sent, C.assign(spark, _active(spark, folder)), _price)
    return done.groupBy("owner", "status", "error").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("response", "$.cents").cast("long")).alias("cents"))


def task_broadcast(spark: SparkSession, folder: str) -> DataFrame:
    """A message to all owners."""
    return tasks.to_all(C.assign(spark, _active(spark, folder)), '{"op": "ping"}', lambda key, message: {"pong": message["op"]})


_ACTIVE = "n AS (SELECT address, (row_number() OVER (ORDER BY address) - 1)::INT AS i, (count(*) OVER ())::INT AS c FROM (SELECT DISTINCT s_name AS address FROM supplier WHERE {}))"
_P = "p AS (SELECT range::INT AS partition_id FROM range(271))"
_A = _ACTIVE.format("s_acctbal >= 0")
_LOCKS = """
e AS (SELECT event_id AS seq, (user_id % 10)::VARCHAR AS key, CASE WHEN event_type IN ('signup', 'view') THEN 'acquire' WHEN event_type = 'click' THEN 'release' ELSE 'force' END AS op, ((user_id // 10) % 3)::VARCHAR AS owner, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS rn FROM events WHERE event_type <> 'purchase'),
t AS (
 SELECT DISTINCT key, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS owner, NULL::VARCHAR AS outcome, NULL::VARCHAR AS holder, NULL::BIGINT AS since, NULL::BIGINT AS g, NULL::BIGINT AS tm FROM e
 UNION ALL
 SELECT key, rn, seq, op, owner, outcome, CASE WHEN outcome IN ('granted', 'refreshed') THEN owner WHEN outcome IN ('denied', 'mismatch') THEN held END, CASE WHEN outcome IN ('granted', 'refreshed') THEN tm WHEN outcome IN ('denied', 'mismatch') THEN since END,
  CASE WHEN outcome = 'granted' THEN seq WHEN outcome IN ('refreshed', 'denied', 'mismatch') THEN g END, tm
 FROM (SELECT *, CASE op WHEN 'acquire' THEN CASE WHEN held IS NULL THEN 'granted' WHEN held = owner THEN 'refreshed' ELSE 'denied' END WHEN 'release' THEN CASE WHEN held IS NULL THEN 'free' WHEN held = owner THEN 'released' ELSE 'mismatch' END ELSE CASE WHEN held IS NULL THEN 'none' ELSE 'forced' END END AS outcome
  FROM (SELECT e.*, CASE WHEN e.tm < t.since + 3600000000 THEN t.holder END AS held, t.since, t.g FROM t JOIN e ON e.key = t.key AND e.rn = t.rn + 1))),
n AS (SELECT seq AS g, row_number() OVER (ORDER BY seq) AS token FROM t WHERE outcome = 'granted'),
l AS (SELECT t.*, token FROM t LEFT JOIN n USING (g) WHERE rn > 0)
"""
LOCKS_SQL = _LOCKS
# the same with a hold time of its own for each request, and releases that name a grant
_HOLDS = _LOCKS.replace("epoch_us(ts) AS tm,", "epoch_us(ts) AS tm, CASE WHEN event_id % 2 = 0 THEN 360000000 ELSE 3600000000 END AS hold, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN event_id END AS named,").replace("NULL::BIGINT AS tm FROM e", "NULL::BIGINT AS tm, NULL::BIGINT AS hold FROM e").replace("THEN g END, tm\n", "THEN g END, tm, CASE WHEN outcome IN ('granted', 'refreshed') THEN hold WHEN outcome IN ('denied', 'mismatch') THEN kept END\n").replace("e.tm < t.since + 3600000000 THEN", "e.tm < t.since + t.hold THEN").replace("t.since, t.g FROM t", "t.since, t.g, t.hold AS kept FROM t").replace("WHEN held = owner THEN 'released'", "WHEN held = owner AND (named IS NULL OR named = g) THEN 'released'")
_BACKED = "a AS (SELECT partition_id, o.address AS owner, b1.address AS b1, b2.address AS b2 FROM p JOIN {n} o ON o.i = partition_id % o.c JOIN {n} b1 ON b1.i = (partition_id + 1) % b1.c JOIN {n} b2 ON b2.i = (partition_id + 2) % b2.c)"
_ALL = "m AS (" + _ACTIVE.format("true")[len("n AS ("):]

QUERIES = {f.__name__: f for f in (rebalance_assign, rebalance_diff, partition_lookup, coordinator, shard_nodes, membership_diff, dead_nodes, quorum_timeline, membership_sessions, cluster_health, lock_timeline, locks_asof, lock_counts, lock_holds, partition_versions, partition_promotion, node_health, metrics, task_topics, task_route, task_broadcast)}
SQL = {
    "rebalance_assign": f"WITH {_A}, {_P} SELECT partition_id, o.address AS owner, b1.address || ',' || b2.address AS backups FROM p JOIN n o ON o.i = partition_id % o.c JOIN n b1 ON b1.i = (partition_id + 1) % b1.c JOIN n b2 ON b2.i = (partition_id + 2) % b2.c",
    "rebalance_diff": f"WITH {_A}, m AS ({_ACTIVE.format('true')[len('n AS ('):-1]}), {_P} SELECT partition_id, m.address AS old_owner, n.address AS new_owner FROM p JOIN n ON n.i = partition_id % n.c JOIN m ON m.i = partition_id % m.c WHERE m.address <> n.address",
    "partition_lookup": f"WITH {_A}, {_P}, o AS (SELECT address, count(*) AS owned FROM p JOIN n ON i = partition_id % c GROUP BY 1), b AS (SELECT address, count(*) AS backed_up FROM p JOIN n ON i = (partition_id + 1) % c GROUP BY 1) SELECT address, coalesce(owned, 0) AS owned, coalesce(backed_up, 0) AS backed_up FROM o FULL JOIN b USING (address)",
    "coordinator": "SELECT min(s_name) AS address FROM supplier WHERE s_acctbal >= 0",
    "shard_nodes": f"WITH {_A}, s AS (SELECT shard_name, row_number() OVER (ORDER BY shard_name) - 1 AS r FROM (SELECT DISTINCT shard_name FROM shards)) SELECT shard_name, address FROM s JOIN n ON i = r % c",
    "membership_diff": """WITH k AS (SELECT user_id::VARCHAR AS address, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'dead' ELSE 'active' END AS state FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), p AS (SELECT DISTINCT user_id::VARCHAR AS address, true AS there FROM events WHERE ts >= TIMESTAMP '2024-01-16')
SELECT address, CASE WHEN state IS NULL THEN 'joined' WHEN there AND state = 'dead' THEN 'rejoined' ELSE 'left' END AS change FROM k FULL JOIN p USING (address) WHERE state IS NULL OR (there AND state = 'dead') OR (there IS NULL AND state <> 'dead')""",
    "dead_nodes": "SELECT user_id::VARCHAR AS address, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1 HAVING epoch_us(max(ts)) + 86400000000 < epoch_us(TIMESTAMP '2024-01-30')",
    "quorum_timeline": 'WITH h AS (SELECT floor(epoch_us(ts) / 3600000000)::BIGINT AS "at", count(DISTINCT user_id) AS visible FROM events GROUP BY 1), r AS (SELECT *, max(visible) OVER (ORDER BY "at") AS expected FROM h) SELECT "at", visible, expected, expected <= 1 OR visible >= ceil(expected / 2) AS ok FROM r',
    "membership_sessions": "WITH e AS (SELECT epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (ORDER BY ts) AS l FROM events WHERE event_type IN ('signup', 'error')), g AS (SELECT t, sum(CASE WHEN l IS NULL OR t - l > 600000000 THEN 1 ELSE 0 END) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT min(t) AS start_us, max(t) + 600000000 AS end_us, count(*) AS changes FROM g GROUP BY s",
    "cluster_health": "SELECT CASE WHEN s_acctbal >= 0 THEN 'nodes_active' ELSE 'nodes_dead' END AS metric, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT 'events_' || event_type, count(*) FROM events GROUP BY 1",
    "lock_timeline": f"WITH RECURSIVE {_LOCKS} SELECT seq, key, op, owner, outcome, holder, token FROM l",
    "locks_asof": f"WITH RECURSIVE {_LOCKS} SELECT key, holder, token FROM (SELECT * FROM l WHERE tm <= epoch_us(TIMESTAMP '2024-01-20 12:00:00') QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE holder IS NOT NULL AND since + 3600000000 > epoch_us(TIMESTAMP '2024-01-20 12:00:00')",
    "lock_counts": f"WITH RECURSIVE {_LOCKS} SELECT key, count(*) FILTER (WHERE op = 'acquire') AS attempts, count(*) FILTER (WHERE outcome = 'granted') AS grants, count(*) FILTER (WHERE outcome = 'refreshed') AS refreshes, count(*) FILTER (WHERE outcome = 'denied') AS denials FROM l GROUP BY key",
    "lock_holds": f"WITH RECURSIVE {_HOLDS} SELECT seq, key, op, owner, outcome, holder, token FROM l",
    "partition_versions": f"WITH {_A}, {_ALL}, {_P}, {_BACKED.format(n='n')}, old AS (SELECT * FROM ({'WITH ' + _BACKED.format(n='m') + ' SELECT * FROM a'})) SELECT a.partition_id, a.owner, a.b1 || ',' || a.b2 AS backups, CASE WHEN a.owner = old.owner AND a.b1 = old.b1 AND a.b2 = old.b2 THEN 1 ELSE 2 END AS version FROM a JOIN old USING (partition_id)",
    "partition_promotion": f"WITH {_A}, {_ALL}, {_P}, {_BACKED.format(n='m')}, s AS (SELECT partition_id, list_filter([owner, b1, b2], lambda x: list_contains(alive, x)) AS l FROM a, (SELECT list(address) AS alive FROM n)) SELECT partition_id, l[1] AS owner, array_to_string(l[2:], ',') AS backups, CASE WHEN len(l) = 3 THEN 1 ELSE 2 END AS version FROM s",
    "node_health": f"WITH n AS (SELECT address, (row_number() OVER (ORDER BY address) - 1)::INT AS i, (count(*) OVER ())::INT AS c FROM (SELECT DISTINCT user_id::VARCHAR AS address FROM events)), {_P}, o AS (SELECT address, count(*) AS owned FROM p JOIN n ON i = partition_id % c GROUP BY 1), b AS (SELECT address, count(*) AS backed_up FROM p JOIN n ON i = (partition_id + 1) % c GROUP BY 1), s AS (SELECT user_id::VARCHAR AS address, CASE WHEN epoch_us(TIMESTAMP '2024-01-30') - epoch_us(max(ts)) > 86400000000 THEN 'dead' ELSE 'active' END AS state FROM events GROUP BY 1) SELECT address, state, coalesce(address = (SELECT min(address) FROM s WHERE state = 'active'), false) AS is_coordinator, coalesce(owned, 0) AS owned, coalesce(backed_up, 0) AS backed_up FROM s LEFT JOIN o USING (address) LEFT JOIN b USING (address)",
    "metrics": "SELECT 'orders' AS source, 'rows' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'orders', 'cents', sum(round(o_totalprice * 100)::BIGINT)::DOUBLE FROM orders UNION ALL SELECT 'events', 'rows', count(*)::DOUBLE FROM events UNION ALL SELECT 'events', 'users', max(user_id)::DOUBLE FROM events",
    "task_topics": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'no handler for topic P' END AS error, count(*) AS n, sum(CASE o_orderstatus WHEN 'O' THEN round_even(o_totalprice * 100, 0)::BIGINT WHEN 'F' THEN 0 END)::BIGINT AS cents FROM orders GROUP BY ALL",
    "task_route": f"WITH {_A} SELECT address AS owner, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS error, count(*) AS n, sum(CASE WHEN o_orderstatus <> 'P' THEN round_even(o_totalprice * 100, 0)::BIGINT END)::BIGINT AS cents FROM orders JOIN n ON i = (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 271) % c GROUP BY ALL",
    "task_broadcast": f"""WITH {_A}, {_P} SELECT DISTINCT '' AS routing_key, address AS owner, 'completed' AS status, '{{"pong": "ping"}}' AS response, NULL::VARCHAR AS error FROM p JOIN n ON i = partition_id % c""",
}

"""Queries p2_ and p4_: the entries after all changes, and references without a live target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.changelog import fold_changes, live_entries
from shardloom.operators.orphans import MATCHES, orphan_references
from shardloom.sources.scratch import materialize
from shardloom.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Live entries with the seq of the put that set them."""
    log = table(spark, folder, "kv_log", "pid", "col", "key", "seq", "op")
    return live_entries(fold_changes(log, payload=())).select("pid", "col", "key", "seq")


def p2_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Live entries with value and time to live, rebuilt from a base state and a later, overlapping change batch."""
    log = table(spark, folder, "kv_log", "pid", "col", "key", "seq", "op", "val", "ttl", "received_at")
    payload = ("val", "ttl")
    # every row is in one batch at least, those received in June in both
    base = fold_changes(log.where("received_at < timestamp'2025-07-01 00:00:00' OR received_at IS NULL"), payload=payload)
    later = log.where("received_at >= timestamp'2025-06-01 00:00:00'")
    return live_entries(fold_changes(later, base, payload=payload)).select("pid", "col", "key", "seq", "val", "ttl")


P2_SQL = """
WITH c AS (SELECT * FROM kv_log WHERE seq IS NOT NULL AND op IN ('put','delete','clear') AND (op = 'clear' OR key IS NOT NULL)),
k AS (SELECT pid, col, key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(coalesce(val, '\\x00'), seq) AS val, arg_max(coalesce(ttl, -1e300), seq) AS ttl FROM c WHERE op <> 'clear' GROUP BY ALL),
x AS (SELECT pid, col, max(seq) AS cleared FROM c WHERE op = 'clear' GROUP BY ALL)
SELECT k.pid, k.col, k.key, k.seq{more} FROM k LEFT JOIN x ON k.pid IS NOT DISTINCT FROM x.pid AND k.col IS NOT DISTINCT FROM x.col
WHERE k.op = 'put' AND (x.cleared IS NULL OR k.seq > x.cleared)
"""

_CHUNK = ("index_name", "shard_number", "target_key")


def _references(spark: SparkSession, folder: str) -> DataFrame:
    """All references: ref_table, ref_field, index_name, shard_number, ref_key, target_key, loaded_at."""
    child = table(spark, folder, "child_chunks", "index_name", "shard_number", "child_chunk_id", "parent_chunk_id", "loaded_at", "deleted_at")
    refs = child.where(F.col("deleted_at").isNull() & F.col("parent_chunk_id").isNotNull()).select(
        F.lit("child_chunks").alias("ref_table"), F.lit("parent_chunk_id").alias("ref_field"), "index_name", "shard_number",
        F.col("child_chunk_id").cast("string").alias("ref_key"), F.col("parent_chunk_id").cast("string").alias("target_key"), "loaded_at")
    for field in ("parent_chunk_ids", "child_chunk_ids"):
        docs = table(spark, folder, "document_store", "index_name", "shard_number", "document_id", field, "loaded_at")
        refs = refs.unionByName(docs.select(
            F.lit("document_store").alias("ref_table"), F.lit(field).alias("ref_field"), "index_name", "shard_number",
            F.col("document_id").alias("ref_key"), F.explode(F.array_compact(F.array_distinct(field))).alias("target_key"), "loaded_at"))
    return refs


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    """All target rows: kind, index_name, shard_number, target_key, loaded_at, deleted_at."""
    out = None
    for name, column in (("parent_chunks", "parent_chunk_id"), ("child_chunks", "child_chunk_id")):
        rows = table(spark, folder, name, "index_name", "shard_number", column, "loaded_at", "deleted_at").withColumnRenamed(column, "target_key")
        rows = rows.withColumn("target_key", F.col("target_key").cast("string")).withColumn("kind", F.lit(column))
        out = rows if out is None else out.unionByName(rows)
    return out


def _with_kind(refs: DataFrame) -> DataFrame:
    return refs.withColumn("kind", F.when(F.col("ref_field") == "child_chunk_ids", "child_chunk_id").otherwise("parent_chunk_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each reference without a live target at the end of the data, once."""
    refs = _with_kind(_references(spark, folder)).drop("loaded_at")
    live = _targets(spark, folder).where("deleted_at IS NULL")
    lost = orphan_references(refs, live, ("kind", *_CHUNK), match="strict", nullable=("index_name", "shard_number"))
    return lost.select("ref_table", "ref_field", "index_name", "shard_number", "ref_key", "target_key").distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """References per table, field, UTC day of the referrer's first loading, and status.

    missing: no row of the target; deleted: only deleted rows; late: the live target was loaded after the referrer.
    """
    key = ("kind", *_CHUNK)
    refs = _with_kind(_references(spark, folder)).groupBy("ref_table", "ref_field", "ref_key", *key).agg(F.min("loaded_at").alias("loaded_at"))
    refs, targets = materialize(refs, "references"), _targets(spark, folder)
    live = targets.where("deleted_at IS NULL")
    orphans = lambda among: orphan_references(refs, among, key, match="strict", nullable=("index_name", "shard_number"))
    # without a live target; of these, those of which there is no row at all, are missing and not deleted
    each = [(orphans(live), "deleted", 1), (orphans(targets), "deleted", -1), (orphans(targets), "missing", 1)]
    since = live.groupBy(*key).agg(F.min("loaded_at").alias("live_from"))
    each.append((refs.join(since, list(key)).where("live_from > loaded_at"), "late", 1))
    out = None
    for rows, status, n in each:
        day = F.date_format("loaded_at", "yyyy-MM-dd").alias("day")
        rows = rows.groupBy("ref_table", "ref_field", day).agg((F.count(F.lit(1)) * n).alias("n")).withColumn("status", F.lit(status))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("ref_table", "ref_field", "day", "status").agg(F.sum("n").alias("n")).where("n > 0")


def p4_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans by index under each match semantics, of references from children to parents that leave shard 0 unsaid."""
    child = table(spark, folder, "child_chunks", "index_name", "shard_number", "parent_chunk_id")
    refs = materialize(child.withColumn("shard_number", F.when(F.col("shard_number") != 0, F.col("shard_number"))), "references")
    parents = table(spark, folder, "parent_chunks", "index_name", "shard_number", "parent_chunk_id", "deleted_at").where("deleted_at IS NULL")
    key, out = ("index_name", "shard_number", "parent_chunk_id"), None
    for match in MATCHES:
        lost = orphan_references(refs, parents, key, match=match, nullable=("shard_number", "parent_chunk_id")).groupBy("index_name").agg(F.count(F.lit(1)).alias("n"))
        lost = lost.select(F.lit(match).alias("match"), "index_name", "n")
        out = lost if out is None else out.unionByName(lost)
    return out


_P4_REFS = """
r AS (
 SELECT 'child_chunks' AS ref_table, 'parent_chunk_id' AS ref_field, index_name, shard_number, child_chunk_id::VARCHAR AS ref_key, parent_chunk_id::VARCHAR AS target_key, 'p' AS kind, loaded_at FROM child_chunks WHERE deleted_at IS NULL AND parent_chunk_id IS NOT NULL
 UNION ALL SELECT 'document_store', 'parent_chunk_ids', index_name, shard_number, document_id, u, 'p', loaded_at FROM (SELECT *, unnest(parent_chunk_ids) AS u FROM document_store) WHERE u IS NOT NULL
 UNION ALL SELECT 'document_store', 'child_chunk_ids', index_name, shard_number, document_id, u, 'c', loaded_at FROM (SELECT *, unnest(child_chunk_ids) AS u FROM document_store) WHERE u IS NOT NULL),
t AS (
 SELECT 'p' AS kind, index_name, shard_number, parent_chunk_id::VARCHAR AS target_key, loaded_at, deleted_at FROM parent_chunks
 UNION ALL SELECT 'c', index_name, shard_number, child_chunk_id::VARCHAR, loaded_at, deleted_at FROM child_chunks)
"""
P4_FOUND_SQL = f"""WITH {_P4_REFS}
SELECT DISTINCT ref_table, ref_field, index_name, shard_number, ref_key, target_key FROM r
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.deleted_at IS NULL AND t.kind = r.kind AND t.index_name = r.index_name AND t.shard_number = r.shard_number AND t.target_key = r.target_key)"""
P4_REPORT_SQL = f"""WITH {_P4_REFS},
g AS (SELECT ref_table, ref_field, ref_key, kind, index_name, shard_number, target_key, min(loaded_at) AS loaded_at FROM r GROUP BY ALL),
h AS (SELECT kind, index_name, shard_number, target_key, min(loaded_at) FILTER (WHERE deleted_at IS NULL) AS live_from, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT g.*, CASE WHEN h.n IS NULL THEN 'missing' WHEN live_from IS NULL THEN 'deleted' WHEN live_from > g.loaded_at THEN 'late' END AS status FROM g LEFT JOIN h USING (kind, index_name, shard_number, target_key))
SELECT ref_table, ref_field, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, status, count(*) AS n FROM s WHERE status IS NOT NULL GROUP BY ALL"""

QUERIES = {"p2_found": p2_found, "p2_entries": p2_entries, "p4_found": p4_found, "p4_report": p4_report, "p4_masks": p4_masks}
SQL = {
    "p2_found": P2_SQL.format(more=""),
    "p2_entries": P2_SQL.format(more=", nullif(k.val, '\\x00') AS val, nullif(k.ttl, -1e300) AS ttl"),
    "p4_found": P4_FOUND_SQL,
    "p4_report": P4_REPORT_SQL,
    "p4_masks": """WITH r AS (SELECT index_name, nullif(shard_number, 0) AS shard_number, parent_chunk_id FROM child_chunks),
t AS (SELECT DISTINCT index_name, shard_number, parent_chunk_id FROM parent_chunks WHERE deleted_at IS NULL),
f AS (SELECT r.*, shard_number IS NULL OR parent_chunk_id IS NULL AS has_null, EXISTS (SELECT 1 FROM t WHERE t.index_name = r.index_name AND t.shard_number = r.shard_number AND t.parent_chunk_id = r.parent_chunk_id) AS fits,
 EXISTS (SELECT 1 FROM t WHERE t.index_name = r.index_name AND (r.shard_number IS NULL OR t.shard_number = r.shard_number) AND (r.parent_chunk_id IS NULL OR t.parent_chunk_id = r.parent_chunk_id)) AS fits_part FROM r)
SELECT m AS match, index_name, count(*) AS n FROM f, (VALUES ('simple'), ('partial'), ('full'), ('strict')) v(m)
WHERE CASE m WHEN 'simple' THEN NOT has_null AND NOT fits WHEN 'partial' THEN NOT fits_part ELSE has_null OR NOT fits END GROUP BY ALL""",
}

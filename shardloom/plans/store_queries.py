"""Catalogue and document operations over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.embed import DIM, DOCUMENT, hash_embedder
from shardloom.functions.text import from_urlsafe, urlsafe
from shardloom.operators import catalog, documents, paging
from shardloom.plans.retrieval_queries import _features_sql
from shardloom.sources.tables import table

NOW = "2026-01-01 00:00:00"
INDEX = "kb-main"


def _now():
    return F.lit(NOW).cast("timestamp")


def _indices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "indices")


def _docs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row a document, the one loaded last."""
    store = table(spark, folder, "document_store", "index_name", "document_id", "loaded_at", *columns)
    return documents.once(store, columns)


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus as documents to bring in; one in an index of the store keeps its name there."""
    c = table(spark, folder, "documents", "doc_id", "text", "index_name", "source")
    return c.select("index_name", F.format_string("corpus-%d", "doc_id").alias("document_id"), F.col("source").alias("title"), F.col("text").alias("content"))


# ---- catalogue


def create_index_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards that creating every index makes."""
    return catalog.shards_of(_indices(spark, folder))


def create_index(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue after copies of its valid indices are created under new names; names that exist would raise."""
    indices = _indices(spark, folder)
    new = catalog.valid(indices).withColumn("index_name", F.concat("index_name", F.lit("-copy")))
    made = catalog.create(indices, new, _now())
    return made.select("index_name", "number_of_shards", F.coalesce(F.col("creation_timestamp") == _now(), F.lit(False)).alias("new"))


def list_indices(spark: SparkSession, folder: str) -> DataFrame:
    """A page of ten from the name k on, and the row that begins the next."""
    return paging.keyset(_indices(spark, folder).select("index_name", "number_of_shards"), "index_name", "k", 10)


def get_index(spark: SparkSession, folder: str) -> DataFrame:
    """One index."""
    return catalog.get(_indices(spark, folder), INDEX).select("index_name", "number_of_shards", "max_parent_chunk_size")


def index_exists(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the indices that the corpus names exist."""
    return catalog.exist(_indices(spark, folder), table(spark, folder, "documents", "index_name"))


def update_index(spark: SparkSession, folder: str) -> DataFrame:
    """Indices that hold documents, described by their number."""
    counts = _docs(spark, folder).groupBy("index_name").agg(F.count(F.lit(1)).alias("n"))
    new = catalog.update(_indices(spark, folder), counts.select("index_name", F.format_string("%d documents", "n").alias("description")), _now())
    return new.select("index_name", "description", F.date_format("modification_timestamp", "yyyy-MM-dd").alias("modified"))


def delete_index(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left by table when the indices without valid settings are deleted with all that they hold."""
    indices = _indices(spark, folder)
    bad = indices.select("index_name").join(catalog.valid(indices).select("index_name"), "index_name", "left_anti")
    kept = catalog.delete({n: table(spark, folder, n) for n in ("indices", "shards", "document_store", "parent_chunks", "child_chunks")}, bad)
    out = None
    for name, df in kept.items():
        row = df.groupBy(F.lit(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- documents


def shard_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document by hash."""
    return documents.placed(_docs(spark, folder), _indices(spark, folder)).select("index_name", "document_id", "shard_number")


def get_document(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of an index, read by its key."""
    docs = table(spark, folder, "document_store", "index_name", "document_id", "shard_number", "title", "content", "loaded_at")
    first = docs.where(F.col("index_name") == INDEX).agg(F.min("document_id")).first()[0]
    return documents.once(documents.get(docs, _indices(spark, folder), INDEX, first), ("title", "content"))


def document_exists(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the documents that chunks name exist in the chunk's index."""
    named = table(spark, folder, "child_chunks", "index_name", "document_id")
    return documents.exist(table(spark, folder, "document_store", "index_name", "document_id"), named)


def list_documents_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of twenty of an index, from shard 2 and the key `i` on, and the row that begins the next."""
    docs = _docs(spark, folder, "shard_number").where(F.col("index_name") == INDEX).select("shard_number", "document_id")
    return paging.sharded(docs, "shard_number", "document_id", (2, "i"), 20)


def page_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The token of a page that begins at each document, and what it reads back as."""
    docs = _docs(spark, folder, "shard_number")
    token = F.concat_ws(".", urlsafe(F.col("shard_number").cast("string")), urlsafe(F.col("document_id")))
    rows = docs.select("document_id", token.alias("token"))
    return rows.select("document_id", "token", from_urlsafe(F.element_at(F.split("token", r"\."), 2)).alias("back"))


def _ingested(spark: SparkSession, folder: str, embed=None) -> dict[str, DataFrame]:
    taken = lambda name, c: table(spark, folder, name, "index_name", "shard_number", c).withColumnRenamed(c, "id")
    existing = table(spark, folder, "document_store", "index_name", "document_id")
    incoming = _corpus(spark, folder).where("index_name IS NOT NULL")
    again = _docs(spark, folder, "title", "content")
    return documents.ingest(existing, catalog.valid(_indices(spark, folder)), incoming.unionByName(again.select(incoming.columns)), taken("parent_chunks", "parent_chunk_id"), taken("child_chunks", "child_chunk_id"), embed)


def ingest_children(spark: SparkSession, folder: str) -> DataFrame:
    """Child chunks with their hashed vectors: the first of the buckets with the greatest weight, and that weight."""
    made = _ingested(spark, folder, hash_embedder(DIM))["child_chunks"]
    size = F.transform("embedding", F.abs)
    peak = made.select("index_name", "shard_number", "child_chunk_id", "parent_chunk_id", "document_id", "child_index", F.length("text").alias("n_chars"), size.alias("s")).withColumn("most", F.array_max("s"))
    return peak.select("index_name", "shard_number", "child_chunk_id", "parent_chunk_id", "document_id", "child_index", "n_chars", (F.array_position("s", F.col("most")) - 1).cast("int").alias("bucket"), F.round(F.col("most").cast("double"), 4).alias("weight"))


def _rebuilt(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The store after the contents of an index are written twice in a row, one after the other."""
    docs = table(spark, folder, "document_store", "index_name", "document_id", "title", "content", "metadata", "modification_timestamp").dropDuplicates(["index_name", "document_id"])
    null = lambda kind: F.lit(None).cast(kind)
    twice = docs.where((F.col("index_name") == INDEX) & F.col("content").isNotNull()).select("index_name", "document_id", null("string").alias("title"), F.concat("content", F.lit("\n"), "content").alias("content"), null("map<string,string>").alias("metadata"))
    parents = table(spark, folder, "parent_chunks", "index_name", "shard_number", "document_id", "chunk_index", "content", "parent_chunk_id")
    children = table(spark, folder, "child_chunks", "index_name", "shard_number", "document_id", "parent_chunk_id", "child_index", "text", "child_chunk_id", "embedding")
    return documents.rebuild(docs, catalog.valid(_indices(spark, folder)), parents, children, twice, _now(), hash_embedder(64))


def update_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Parent chunks after an update that cuts the documents of an index again."""
    return _rebuilt(spark, folder)["parent_chunks"].select("index_name", "shard_number", "parent_chunk_id", "document_id", "chunk_index", F.length("content").alias("n_chars"))


def update_children(spark: SparkSession, folder: str) -> DataFrame:
    """Child chunks after that update, with the length of their vectors."""
    kids = _rebuilt(spark, folder)["child_chunks"]
    return kids.select("index_name", "shard_number", "child_chunk_id", "parent_chunk_id", "document_id", "child_index", F.length("text").alias("n_chars"), F.greatest(F.size("embedding"), F.lit(0)).alias("dims"))


def ingest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Parent chunks that the corpus makes in the store's valid indices; documents that exist are conflicts."""
    return _ingested(spark, folder)["parent_chunks"].select("index_name", "shard_number", "parent_chunk_id", "document_id", "chunk_index", F.length("content").alias("n_chars"))


def ingest_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming documents that exist."""
    return _ingested(spark, folder)["conflicts"].select("index_name", "document_id")


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """Titles from the documents' own metadata, where they name an owner; a new content for blank ones."""
    m = table(spark, folder, "document_store", "index_name", "document_id", "content", "metadata", "loaded_at")
    owner = F.element_at("metadata", "owner")
    blank = F.when(F.trim("content") == "", F.lit(""))
    flat = m.select("index_name", "document_id", "loaded_at", owner.alias("title"), blank.alias("content"))
    return documents.once(flat, ("title", "content")).where("title IS NOT NULL OR content IS NOT NULL").withColumn("metadata", F.lit(None).cast("map<string,string>"))


def update_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after the changes, and whether they must be cut again."""
    docs = table(spark, folder, "document_store", "index_name", "document_id", "title", "content", "metadata", "modification_timestamp").dropDuplicates(["index_name", "document_id"])
    out = documents.update(docs, _changes(spark, folder), _now())
    return out.select("index_name", "document_id", "title", "rechunk", (F.col("modification_timestamp") == _now()).alias("touched"))


def upsert_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The store's documents and the corpus, which replaces documents of the same key."""
    docs = _docs(spark, folder, "title", "content")
    out = documents.upsert(docs, _corpus(spark, folder).unionByName(_changes(spark, folder).select("index_name", "document_id", "title", "content")))
    return out.select("index_name", "document_id", "title")


def delete_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left by table when documents without content are deleted with their chunks."""
    docs = table(spark, folder, "document_store", "index_name", "document_id", "content")
    gone = docs.where(F.coalesce(F.trim("content"), F.lit("")) == "")
    left = documents.delete(docs, *[table(spark, folder, n, "index_name", "document_id") for n in ("parent_chunks", "child_chunks")], gone)
    out = None
    for name, df in zip(("document_store", "parent_chunks", "child_chunks"), left):
        row = df.groupBy(F.lit(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


_VALID = "valid AS (SELECT * FROM indices WHERE index_name <> '' AND number_of_shards > 0 AND max_parent_chunk_size > 0 AND parent_chunk_overlap_size >= 0 AND parent_chunk_overlap_size < max_parent_chunk_size AND max_child_chunk_size > 0 AND child_chunk_overlap_size >= 0 AND child_chunk_overlap_size < max_child_chunk_size)"
_ONCE = "d AS (SELECT DISTINCT index_name, document_id, shard_number, title, content FROM document_store)"
_SHARD = "list_reduce(list_prepend(0::BIGINT, [('0x' || substr(sha256(index_name || '/' || document_id), i * 8 + 1, 8))::BIGINT FOR i IN range(8)]), lambda a, x: (a * 4294967296 + x) % number_of_shards)::INTEGER"
_B64 = "replace(replace(to_base64({}::BLOB), '+', '-'), '/', '_')"
_CORPUS = "c AS (SELECT index_name, 'corpus-' || doc_id AS document_id, source AS title, text AS content FROM documents)"
_CH = "ch AS (SELECT * FROM (SELECT DISTINCT index_name, document_id, metadata['owner'] AS title, CASE WHEN trim(content) = '' THEN '' END AS content FROM document_store) WHERE title IS NOT NULL OR content IS NOT NULL)"
_CUT = "[t[i * (max_parent_chunk_size - parent_chunk_overlap_size) + 1 : i * (max_parent_chunk_size - parent_chunk_overlap_size) + max_parent_chunk_size] FOR i IN range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= max_parent_chunk_size THEN 1 ELSE ceil((len(t) - max_parent_chunk_size) / (max_parent_chunk_size - parent_chunk_overlap_size)::DOUBLE)::BIGINT + 1 END)]"

_FOUND = r"regexp_extract_all(coalesce(content, ''), '[ \t\n\r\f]*[^ \t\n\r\f]+')"
_JOINED = r"regexp_replace(array_to_string({x}, ''), '^[ \t\n\r\f]+', '')"
_NEXT = "{c} + row_number() OVER (PARTITION BY index_name, shard_number ORDER BY {by}) - 1"
# parents (i) and children (g) of the tokens in n, numbered after those that the shard has
_KIDS = f"""mp AS (SELECT index_name, shard_number, max(parent_chunk_id) AS most FROM parent_chunks GROUP BY ALL), mc AS (SELECT index_name, shard_number, max(child_chunk_id) AS most FROM child_chunks GROUP BY ALL),
p AS (SELECT index_name, shard_number, document_id, max_child_chunk_size AS cs, child_chunk_overlap_size AS co, {_CUT} AS p FROM n), u AS (SELECT index_name, shard_number, document_id, cs, co, unnest(p) AS t, unnest(range(len(p)))::INTEGER AS chunk_index FROM p),
i AS (SELECT u.*, {_NEXT.format(c='coalesce(most + 1, 0)', by='document_id, chunk_index')} AS parent_chunk_id, {_JOINED.format(x='t')} AS content FROM u LEFT JOIN mp USING (index_name, shard_number)),
k AS (SELECT * EXCLUDE (t, content), [t[j * (cs - co) + 1 : j * (cs - co) + cs] FOR j IN range(CASE WHEN len(t) <= cs THEN 1 ELSE ceil((len(t) - cs) / (cs - co)::DOUBLE)::BIGINT + 1 END)] AS c FROM i),
g AS (SELECT * EXCLUDE (x), {_JOINED.format(x='x')} AS text FROM (SELECT * EXCLUDE (c), unnest(c) AS x, unnest(range(len(c)))::INTEGER AS child_index FROM k))"""
_TWICE = f"""{_VALID}, tw AS (SELECT DISTINCT index_name, document_id, content || chr(10) || content AS content FROM document_store WHERE index_name = '{INDEX}' AND content IS NOT NULL),
n AS (SELECT tw.*, v.* EXCLUDE (index_name), {_SHARD.replace('index_name', 'tw.index_name')} AS shard_number, {_FOUND} AS t FROM tw JOIN valid v ON tw.index_name = v.index_name)"""

QUERIES = {f.__name__: f for f in (create_index_shards, create_index, list_indices, get_index, index_exists, update_index, delete_index, shard_assignment, get_document, document_exists, list_documents_page, page_tokens, ingest_documents, ingest_children, update_parents, update_children, ingest_conflicts, update_documents, upsert_documents, delete_documents)}
SQL = {
    "create_index_shards": "SELECT printf('%s_%06d', index_name, n) AS shard_name, index_name, n::INTEGER AS shard_number FROM (SELECT index_name, unnest(range(number_of_shards)) AS n FROM indices)",
    "create_index": f"WITH {_VALID} SELECT index_name, number_of_shards, false AS new FROM indices UNION ALL SELECT index_name || '-copy', number_of_shards, true FROM valid",
    "list_indices": "SELECT index_name, number_of_shards FROM indices WHERE index_name >= 'k' ORDER BY index_name LIMIT 11",
    "get_index": f"SELECT index_name, number_of_shards, max_parent_chunk_size FROM indices WHERE index_name = '{INDEX}'",
    "index_exists": "SELECT DISTINCT index_name, index_name IN (SELECT index_name FROM indices) AS found FROM documents WHERE index_name IS NOT NULL",
    "update_index": "WITH n AS (SELECT index_name, count(DISTINCT document_id) AS n FROM document_store GROUP BY 1) SELECT index_name, CASE WHEN n IS NOT NULL THEN n || ' documents' ELSE description END AS description, CASE WHEN n IS NOT NULL THEN '2026-01-01' ELSE strftime(modification_timestamp AT TIME ZONE 'UTC', '%Y-%m-%d') END AS modified FROM indices LEFT JOIN n USING (index_name)",
    "delete_index": f"WITH {_VALID}, bad AS (SELECT index_name FROM indices ANTI JOIN valid USING (index_name)) " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n} ANTI JOIN bad USING (index_name)" for n in ("indices", "shards", "document_store", "parent_chunks", "child_chunks")),
    "shard_assignment": f"WITH {_ONCE} SELECT index_name, document_id, {_SHARD} AS shard_number FROM d JOIN indices USING (index_name) WHERE number_of_shards > 0",
    "get_document": f"SELECT DISTINCT index_name, document_id, title, content FROM document_store WHERE index_name = '{INDEX}' AND document_id = (SELECT min(document_id) FROM document_store WHERE index_name = '{INDEX}')",
    "document_exists": "SELECT index_name, document_id, EXISTS (SELECT 1 FROM document_store s WHERE s.index_name = c.index_name AND s.document_id = c.document_id) AS found FROM (SELECT DISTINCT index_name, document_id FROM child_chunks) c",
    "list_documents_page": f"WITH {_ONCE} SELECT shard_number, document_id FROM d WHERE index_name = '{INDEX}' AND (shard_number > 2 OR (shard_number = 2 AND document_id >= 'i')) ORDER BY shard_number, document_id LIMIT 21",
    "page_tokens": f"WITH {_ONCE} SELECT document_id, {_B64.format('shard_number::VARCHAR')} || '.' || {_B64.format('document_id')} AS token, document_id AS back FROM d",
    "ingest_documents": rf"""WITH {_VALID}, {_CORPUS}, n AS (SELECT c.*, v.* EXCLUDE (index_name), {_SHARD.replace('index_name', 'c.index_name')} AS shard_number, regexp_extract_all(coalesce(content, ''), '[ \t\n\r\f]*[^ \t\n\r\f]+') AS t FROM c JOIN valid v ON c.index_name = v.index_name),
p AS (SELECT index_name, shard_number, document_id, {_CUT} AS p FROM n), u AS (SELECT index_name, shard_number, document_id, unnest(p) AS t, unnest(range(len(p)))::INTEGER AS chunk_index FROM p),
m AS (SELECT index_name, shard_number, max(parent_chunk_id) AS most FROM parent_chunks GROUP BY ALL)
SELECT index_name, shard_number, coalesce(most + 1, 0) + row_number() OVER (PARTITION BY index_name, shard_number ORDER BY document_id, chunk_index) - 1 AS parent_chunk_id, document_id, chunk_index, length(regexp_replace(array_to_string(t, ''), '^[ \t\n\r\f]+', ''))::INTEGER AS n_chars FROM u LEFT JOIN m USING (index_name, shard_number)""",
    "ingest_children": rf"""WITH {_VALID}, {_CORPUS}, n AS (SELECT c.*, v.* EXCLUDE (index_name), {_SHARD.replace('index_name', 'c.index_name')} AS shard_number, {_FOUND} AS t FROM c JOIN valid v ON c.index_name = v.index_name), {_KIDS},
f AS {_features_sql('g', 'index_name, shard_number, document_id, chunk_index, child_index, ', f"('{DOCUMENT}' || text)")},
w AS (SELECT index_name, shard_number, document_id, chunk_index, child_index, min(bucket) AS bucket, any_value(m) AS weight FROM (SELECT *, abs(weight)::FLOAT AS x, max(abs(weight)::FLOAT) OVER (PARTITION BY index_name, shard_number, document_id, chunk_index, child_index) AS m FROM f) WHERE x = m GROUP BY ALL)
SELECT index_name, shard_number, {_NEXT.format(c='coalesce(mc.most + 1, 0)', by='document_id, chunk_index, child_index')} AS child_chunk_id, parent_chunk_id, document_id, child_index, length(text)::INTEGER AS n_chars, bucket, round(weight::DOUBLE, 4) AS weight FROM g JOIN w USING (index_name, shard_number, document_id, chunk_index, child_index) LEFT JOIN mc USING (index_name, shard_number)""",
    "update_parents": rf"""WITH {_TWICE}, {_KIDS} SELECT index_name, shard_number, parent_chunk_id, document_id, chunk_index, length(content)::INTEGER AS n_chars FROM i UNION ALL
SELECT index_name, shard_number, parent_chunk_id, document_id, chunk_index, length(content)::INTEGER FROM parent_chunks ANTI JOIN tw USING (index_name, document_id)""",
    "update_children": rf"""WITH {_TWICE}, {_KIDS} SELECT index_name, shard_number, {_NEXT.format(c='coalesce(mc.most + 1, 0)', by='document_id, chunk_index, child_index')} AS child_chunk_id, parent_chunk_id, document_id, child_index, length(text)::INTEGER AS n_chars, 64 AS dims FROM g LEFT JOIN mc USING (index_name, shard_number) UNION ALL
SELECT index_name, shard_number, child_chunk_id, parent_chunk_id, document_id, child_index, length(text)::INTEGER, coalesce(len(embedding), 0)::INTEGER FROM child_chunks ANTI JOIN tw USING (index_name, document_id)""",
    "ingest_conflicts": "SELECT DISTINCT index_name, document_id FROM document_store",
    "update_documents": f"WITH {_ONCE}, {_CH} SELECT index_name, document_id, coalesce(ch.title, d.title) AS title, coalesce(ch.content IS NOT NULL, false) AS rechunk, ch.document_id IS NOT NULL AS touched FROM d LEFT JOIN ch USING (index_name, document_id)",
    "upsert_documents": f"WITH {_ONCE}, {_CORPUS}, {_CH}, n AS (SELECT index_name, document_id, title FROM c UNION ALL SELECT index_name, document_id, title FROM ch) SELECT * FROM n UNION ALL SELECT index_name, document_id, title FROM d ANTI JOIN n USING (index_name, document_id)",
    "delete_documents": "WITH gone AS (SELECT DISTINCT index_name, document_id FROM document_store WHERE coalesce(trim(content), '') = '') " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n} ANTI JOIN gone USING (index_name, document_id)" for n in ("document_store", "parent_chunks", "child_chunks")),
}

"""Vector retrieval, text chunking, hashed embedding and the full chain, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.embed import DIM, DOCUMENT, QUERY, features
from shardloom.functions.placement import shard_of
from shardloom.functions.text import bare, chunk_text, chunks, tokens
from shardloom.operators import retrieval as R
from shardloom.operators.documents import counted
from shardloom.operators.numbering import running_sums
from shardloom.sources.tables import table

K = 10
THRESHOLD = 1.5
SHARD = ("index_name", "shard_number")
INDEX = "kb-main"
QUERY_TEXT = "the backlog cleared on its own after the restart"


def _query(spark: SparkSession, folder: str) -> DataFrame:
    """The vector asked for: that of the smallest probe id."""
    probe = table(spark, folder, "knn_probes").agg(F.min("vec_id").alias("vec_id"))
    rows = table(spark, folder, "child_chunks", "vec_id", "embedding")
    return rows.join(F.broadcast(probe), "vec_id", "left_semi").select(F.col("embedding").alias("q")).limit(1)  # copies of one row are equal


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "child_chunks", *SHARD, "child_chunk_id", "parent_chunk_id", "embedding", "loaded_at", "deleted_at")
    return R.score_live(rows, _query(spark, folder), (*SHARD, "child_chunk_id"), ("parent_chunk_id",))


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest labelled vectors of vector 0, over one shard."""
    v = table(spark, folder, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return R.score_exact(v, q, ("vec_id", "label")).orderBy("score", "vec_id").limit(K).withColumn("score", F.round("score", 6))


def knn_sharded(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest children of every shard."""
    return R.top_by_shard(_scored(spark, folder), SHARD, K, ("child_chunk_id",)).select(*SHARD, "child_chunk_id", F.round("score", 6).alias("score"))


def knn_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The same, up to a distance."""
    return R.within(R.top_by_shard(_scored(spark, folder), SHARD, K, ("child_chunk_id",)), THRESHOLD).select(*SHARD, "child_chunk_id", F.round("score", 6).alias("score"))


def knn_dedup_parent(spark: SparkSession, folder: str) -> DataFrame:
    """The same, with the best child of each parent."""
    hits = R.within(R.top_by_shard(_scored(spark, folder), SHARD, K, ("child_chunk_id",)), THRESHOLD).where("parent_chunk_id IS NOT NULL")
    return R.best_child(hits, (*SHARD, "parent_chunk_id"), ("child_chunk_id",)).select(*SHARD, "parent_chunk_id", "child_chunk_id", F.round("score", 6).alias("score"))


def retrieve(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: search all shards, merge, threshold, best child a parent, contents of the 10 best."""
    found = R.retrieve(None, table(spark, folder, "parent_chunks"), _scored(spark, folder), K, 2.0)
    return found.withColumn("score", F.round("score", 6))


def retrieve_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same in one index by its name, which must exist."""
    scored, parents = _scored(spark, folder), table(spark, folder, "parent_chunks")
    found = R.retrieve(None, *R.of_index(table(spark, folder, "indices"), INDEX, parents, scored), K)
    return found.withColumn("score", F.round("score", 6))


def knn_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest labelled vectors of each label, scored by Arrow batches."""
    v = table(spark, folder, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()[0]
    return R.top_by_shard(R.score_blocks(v, q, ("label", "vec_id"), K, ("label",)), ("label",), K, ("vec_id",)).withColumn("score", F.round("score", 6))


_LIVE = """
child AS (SELECT index_name, shard_number, child_chunk_id, arg_max(coalesce(parent_chunk_id, -1), (loaded_at, coalesce(parent_chunk_id, -1))) AS p, arg_max(coalesce(embedding, []), (loaded_at, coalesce(parent_chunk_id, -1))) AS e FROM child_chunks WHERE deleted_at IS NULL GROUP BY ALL),
q AS (SELECT embedding AS q FROM child_chunks WHERE vec_id = (SELECT min(vec_id) FROM knn_probes) LIMIT 1),
scored AS (SELECT index_name, shard_number, child_chunk_id, nullif(p, -1) AS parent_chunk_id, list_sum(list_transform(list_zip(e, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS score FROM child, q WHERE len(e) = len(q)),
top AS (SELECT * FROM scored WHERE NOT isnan(score) QUALIFY row_number() OVER (PARTITION BY index_name, shard_number ORDER BY score, child_chunk_id) <= 10)
"""
_BEST = "SELECT * FROM top WHERE score <= {t} AND parent_chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index_name, shard_number, parent_chunk_id ORDER BY score, child_chunk_id) = 1"


# ---- text -----------------------------------------------------------------------------------------------------------


def _store(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the chunk sizes of their index; copies of a row once."""
    docs = table(spark, folder, "document_store", "document_id", "index_name", "shard_number", "content").dropDuplicates(["document_id"])
    sizes = table(spark, folder, "indices").select("index_name", "max_parent_chunk_size", "parent_chunk_overlap_size", "max_child_chunk_size", "child_chunk_overlap_size")
    return docs.join(sizes, "index_name")


def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens of each text, and its longest token."""
    docs = table(spark, folder, "documents", "doc_id", "text").select("doc_id", tokens(F.col("text")).alias("t"))
    longest = F.aggregate("t", F.lit(0), lambda a, x: F.greatest(a, F.length(bare(x))))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), longest.alias("longest"))


def _parents(spark: SparkSession, folder: str) -> DataFrame:
    # tokens are a column of their own: inside a lambda they would be found again for every chunk
    found = _store(spark, folder).withColumn("all", tokens(F.col("content"))).drop("content")
    cut = chunks(F.col("all"), F.col("max_parent_chunk_size"), F.col("parent_chunk_overlap_size"))
    return found.select("*", F.posexplode(cut).alias("chunk_index", "t")).drop("all")


def chunk_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Parent chunks of all documents, by the sizes of their index."""
    return _parents(spark, folder).select("document_id", "chunk_index", chunk_text(F.col("t")).alias("content"))


def chunk_children(spark: SparkSession, folder: str) -> DataFrame:
    """Child chunks of all parent chunks."""
    cut = chunks(F.col("t"), F.col("max_child_chunk_size"), F.col("child_chunk_overlap_size"))
    rows = _parents(spark, folder).select("document_id", "chunk_index", F.posexplode(cut).alias("child_index", "c"))
    return rows.select("document_id", "chunk_index", "child_index", F.size("c").alias("n_tokens"), chunk_text(F.col("c")).alias("content"))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids for parent chunks: consecutive within a shard, after the ids that it has."""
    made = counted(_store(spark, folder).select(*SHARD, "document_id", "content"), table(spark, folder, "indices")).select(*SHARD, "document_id", "n_parents")
    taken = table(spark, folder, "parent_chunks").groupBy(*SHARD).agg(F.max("parent_chunk_id").alias("most"))
    rows = running_sums(made, SHARD, ("document_id",), {"n": F.col("n_parents")}).join(taken, list(SHARD), "left").where("n_parents > 0")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_parents") - 1)).alias("chunk_index"))
    return each.select(*SHARD, "document_id", "chunk_index", (F.coalesce(F.col("most") + 1, F.lit(0)) + F.col("n") + F.col("chunk_index")).alias("parent_chunk_id"))


_CUT = "[{t}[i * ({size} - {lap}) + 1 : i * ({size} - {lap}) + {size}] FOR i IN range(CASE WHEN len({t}) = 0 THEN 0 WHEN len({t}) <= {size} THEN 1 ELSE ceil((len({t}) - {size}) / ({size} - {lap})::DOUBLE)::BIGINT + 1 END)]"
_JOINED = r"regexp_replace(array_to_string({x}, ''), '^[ \t\n\r\f]+', '')"
_DOCS = r"""
docs AS (SELECT DISTINCT document_id, index_name, shard_number, content FROM document_store),
tok AS (SELECT d.document_id, d.index_name, d.shard_number, i.max_parent_chunk_size AS ps, i.parent_chunk_overlap_size AS po, i.max_child_chunk_size AS cs, i.child_chunk_overlap_size AS co,
 regexp_extract_all(coalesce(content, ''), '[ \t\n\r\f]*[^ \t\n\r\f]+') AS t FROM docs d JOIN indices i USING (index_name) WHERE i.max_parent_chunk_size > 0 AND i.parent_chunk_overlap_size >= 0 AND i.parent_chunk_overlap_size < i.max_parent_chunk_size),
pc AS (SELECT * EXCLUDE (t), """ + _CUT.format(t="t", size="ps", lap="po") + """ AS p FROM tok),
par AS (SELECT * EXCLUDE (p), unnest(p) AS t, unnest(range(len(p)))::INTEGER AS chunk_index FROM pc)
"""
_CHILD = "cc AS (SELECT * EXCLUDE (t), " + _CUT.format(t="t", size="cs", lap="co") + " AS c FROM par WHERE cs > 0 AND co >= 0 AND co < cs), ch AS (SELECT * EXCLUDE (c), unnest(c) AS t, unnest(range(len(c)))::INTEGER AS child_index FROM cc)"


# ---- hashed embedding and the chain from text -----------------------------------------------------------------------


def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    """The hashed vector of every text, sparse."""
    rows = features(table(spark, folder, "documents", "doc_id", "text"), F.col("text"), "doc_id")
    return rows.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def retrieve_text(spark: SparkSession, folder: str) -> DataFrame:
    """The chain from text: place, chunk twice (64/8 and 16/4), hash, search by shard, best child a parent, 10 best."""
    docs = table(spark, folder, "documents", "doc_id", "text").withColumn("shard", shard_of(F.lit("docs"), F.col("doc_id").cast("string"), F.lit(4)))
    found = docs.select("shard", "doc_id", tokens(F.col("text")).alias("all"))
    parents = found.select("shard", "doc_id", F.posexplode(chunks(F.col("all"), F.lit(64), F.lit(8))).alias("chunk_index", "t"))
    kids = parents.select("shard", "doc_id", "chunk_index", F.posexplode(chunks(F.col("t"), F.lit(16), F.lit(4))).alias("child_index", "c"))
    key = ("shard", "doc_id", "chunk_index", "child_index")
    vectors = features(kids.select(*key, chunk_text(F.col("c")).alias("text")), F.concat(F.lit(DOCUMENT), "text"), *key)
    query = features(spark.range(1).select("id", F.lit(QUERY + QUERY_TEXT).alias("text")), F.col("text"), "id", dim=DIM).select("bucket", F.col("weight").alias("qw"))
    near = vectors.join(F.broadcast(query), "bucket", "left").groupBy(*key).agg((2 - 2 * F.sum(F.coalesce(F.col("weight") * F.col("qw"), F.lit(0.0)))).alias("score"))
    near = near.withColumn("score", F.round("score", 6))
    hits = R.within(R.top_by_shard(near, ("shard",), K, ("doc_id", "chunk_index", "child_index")), THRESHOLD)
    best = R.best_child(hits, ("shard", "doc_id", "chunk_index"), ("child_index",))
    full = best.join(parents, ["shard", "doc_id", "chunk_index"])
    return full.orderBy("score", "shard", "doc_id", "chunk_index").limit(K).select("doc_id", "chunk_index", chunk_text(F.col("t")).alias("content"), "score")


def _features_sql(source: str, keys: str, text: str) -> str:
    return rf"""(WITH w0 AS (SELECT {keys}unnest(regexp_extract_all(coalesce({text}, ''), '[^ \t\n\r\f]+')) AS tok FROM {source}),
w1 AS (SELECT {keys}('0x' || substr(md5(lower(tok)), 1, 8))::BIGINT AS h FROM w0),
w2 AS (SELECT {keys}(h % 256)::INTEGER AS bucket, sum(CASE WHEN (h // 256) % 2 = 0 THEN 1 ELSE -1 END) AS w FROM w1 GROUP BY ALL HAVING sum(CASE WHEN (h // 256) % 2 = 0 THEN 1 ELSE -1 END) <> 0)
SELECT {keys}bucket, w / sqrt((sum(w * w) OVER ({'PARTITION BY ' + keys.rstrip(', ') if keys else ''}))::DOUBLE) AS weight FROM w2)"""


_TEXT_SQL = (
    r"""WITH tok AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, [('0x' || substr(sha256('docs/' || doc_id), i * 8 + 1, 8))::BIGINT FOR i IN range(8)]), lambda a, x: (a * 4294967296 + x) % 4) AS shard, regexp_extract_all(coalesce(text, ''), '[ \t\n\r\f]*[^ \t\n\r\f]+') AS t FROM documents),
pc AS (SELECT shard, doc_id, """ + _CUT.format(t="t", size="64", lap="8") + """ AS p FROM tok),
par AS (SELECT shard, doc_id, unnest(p) AS t, unnest(range(len(p)))::INTEGER AS chunk_index FROM pc),
cc AS (SELECT shard, doc_id, chunk_index, """ + _CUT.format(t="t", size="16", lap="4") + """ AS c FROM par),
ch AS (SELECT shard, doc_id, chunk_index, unnest(c) AS t, unnest(range(len(c)))::INTEGER AS child_index FROM cc),
kid AS (SELECT shard, doc_id, chunk_index, child_index, '""" + DOCUMENT + r"""' || array_to_string(t, '') AS text FROM ch),
v AS """ + _features_sql("kid", "shard, doc_id, chunk_index, child_index, ", "text") + f""",
one AS (SELECT '{QUERY}{QUERY_TEXT}' AS text), qv AS """ + _features_sql("one", "", "text") + """,
near AS (SELECT shard, doc_id, chunk_index, child_index, round(2 - 2 * sum(coalesce(v.weight * qv.weight, 0)), 6) AS score FROM v LEFT JOIN qv USING (bucket) GROUP BY ALL),
top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY shard ORDER BY score, doc_id, chunk_index, child_index) <= 10),
best AS (SELECT * FROM top WHERE score <= 1.5 QUALIFY row_number() OVER (PARTITION BY shard, doc_id, chunk_index ORDER BY score, child_index) = 1)
SELECT doc_id, chunk_index, """ + _JOINED.format(x="par.t") + """ AS content, score FROM best JOIN par USING (shard, doc_id, chunk_index) ORDER BY score, shard, doc_id, chunk_index LIMIT 10"""
)

QUERIES = {f.__name__: f for f in (retrieve, knn_topk, knn_sharded, knn_threshold, knn_dedup_parent, retrieve_index, knn_blocks, tokenize_documents, chunk_parents, chunk_children, chunk_ids, hash_embed, retrieve_text)}
SQL = {
    "knn_topk": "SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY score, vec_id LIMIT 10",
    "knn_sharded": f"WITH {_LIVE} SELECT index_name, shard_number, child_chunk_id, round(score, 6) AS score FROM top",
    "knn_threshold": f"WITH {_LIVE} SELECT index_name, shard_number, child_chunk_id, round(score, 6) AS score FROM top WHERE score <= 1.5",
    "knn_dedup_parent": f"WITH {_LIVE} SELECT index_name, shard_number, parent_chunk_id, child_chunk_id, round(score, 6) AS score FROM ({_BEST.format(t=1.5)})",
    "retrieve": f"""WITH {_LIVE}, best AS ({_BEST.format(t=2.0)}),
par AS (SELECT index_name, shard_number, parent_chunk_id, max(struct_pack(l := loaded_at, document_id := document_id, chunk_index := chunk_index, content := content)) AS s FROM parent_chunks WHERE deleted_at IS NULL GROUP BY ALL)
SELECT s.document_id AS document_id, s.chunk_index AS chunk_index, s.content AS content, round(score, 6) AS score FROM best JOIN par USING (index_name, shard_number, parent_chunk_id) ORDER BY best.score, index_name, shard_number, child_chunk_id LIMIT 10""",
    "retrieve_index": f"""WITH {_LIVE}, best AS ({_BEST.format(t="'infinity'::DOUBLE")}),
par AS (SELECT index_name, shard_number, parent_chunk_id, max(struct_pack(l := loaded_at, document_id := document_id, chunk_index := chunk_index, content := content)) AS s FROM parent_chunks WHERE deleted_at IS NULL GROUP BY ALL)
SELECT s.document_id AS document_id, s.chunk_index AS chunk_index, s.content AS content, round(score, 6) AS score FROM best JOIN par USING (index_name, shard_number, parent_chunk_id) WHERE index_name = '{INDEX}' ORDER BY best.score, index_name, shard_number, child_chunk_id LIMIT 10""",
    "knn_blocks": "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT label, vec_id, list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS score FROM embeddings, q) SELECT label, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score, vec_id) <= 10",
    "tokenize_documents": r"SELECT doc_id, len(t)::INTEGER AS n_tokens, coalesce(list_max(list_transform(t, lambda x: length(x))), 0)::INTEGER AS longest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+') AS t FROM documents)",
    "chunk_parents": f"WITH {_DOCS} SELECT document_id, chunk_index, {_JOINED.format(x='t')} AS content FROM par",
    "chunk_children": f"WITH {_DOCS}, {_CHILD} SELECT document_id, chunk_index, child_index, len(t)::INTEGER AS n_tokens, {_JOINED.format(x='t')} AS content FROM ch",
    "chunk_ids": f"WITH {_DOCS}, taken AS (SELECT index_name, shard_number, max(parent_chunk_id) AS most FROM parent_chunks GROUP BY ALL) SELECT index_name, shard_number, document_id, chunk_index, coalesce(most + 1, 0) + row_number() OVER (PARTITION BY index_name, shard_number ORDER BY document_id, chunk_index) - 1 AS parent_chunk_id FROM par LEFT JOIN taken USING (index_name, shard_number)",
    "hash_embed": f"SELECT doc_id, bucket, round(weight, 6) AS weight FROM {_features_sql('documents', 'doc_id, ', 'text')}",
    "retrieve_text": _TEXT_SQL,
}

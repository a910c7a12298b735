"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.leakage import leaked_passages
from shardloom.llm.mixing import SHORTFALLS, mix_sources, promised_totals, reached_shares, reached_totals, sized_texts
from shardloom.llm.neardup import NearDuplicates
from shardloom.llm.residue import residue
from shardloom.llm.splitting import split_oversized
from shardloom.llm.vectors import most_similar
from shardloom.sources.scratch import materialize
from shardloom.sources.tables import table


def _near(spark: SparkSession, folder: str) -> NearDuplicates:
    return NearDuplicates(table(spark, folder, "document_store", "document_id", "title", "content", "loaded_at"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of near-duplicate records."""
    return _near(spark, folder).pairs()


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record with its group and its number of links."""
    return _near(spark, folder).groups()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all oversized contents."""
    documents = table(spark, folder, "document_store", "document_id", "index_name", "content", "loaded_at")
    return split_oversized(documents, table(spark, folder, "indices"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose content had to be split."""
    return p3_pieces(spark, folder).select("document_id").distinct()


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar vectors of each vec_id that is divisible by 100, with cosine and rank."""
    vectors = table(spark, folder, "child_chunks", "vec_id", "embedding")
    return most_similar(vectors, vectors.select("vec_id").where("vec_id % 100 = 0"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Unordered pairs of a probe and one of its 10 nearest."""
    found = most_similar(table(spark, folder, "child_chunks", "vec_id", "embedding"), table(spark, folder, "knn_probes", "vec_id"))
    return found.select(F.least("query", "vec_id").alias("vec_id_a"), F.greatest("query", "vec_id").alias("vec_id_b")).distinct()


def p6_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked passages with their place in the original text."""
    return leaked_passages(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items that they contain."""
    return p6_passages(spark, folder).select("doc_id", "item_id").distinct()


def _sized(spark: SparkSession, folder: str, **how) -> DataFrame:
    return materialize(sized_texts(table(spark, folder, "documents", "doc_id", "text", "source"), **how), "sized")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of each mix with their copies; sizes in tokens of the public byte-level vocabulary."""
    return mix_sources(_sized(spark, folder), table(spark, folder, "mix_targets"), shortfall="fill")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of each mix and source."""
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return reached_shares(mix_sources(sized, targets, shortfall="fill"), sized, targets)


def p7_shares_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The same with sizes in runs of characters without white space."""
    sized, targets = _sized(spark, folder, vocabulary=None), table(spark, folder, "mix_targets")
    return reached_shares(mix_sources(sized, targets), sized, targets)


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Under each way with shortfalls, in runs without white space: texts beyond their repeats, and the mix's size, which is what the way promises up to one text a source."""
    sized, targets = _sized(spark, folder, vocabulary=None), table(spark, folder, "mix_targets")
    out = None
    for way in SHORTFALLS:
        rows = reached_totals(mix_sources(sized, targets, shortfall=way), targets)
        rows = rows.select(F.lit(way).alias("shortfall"), "mix_name", "over", F.col("reached_tokens").alias("tokens"))
        out = rows if out is None else out.unionByName(rows)
    promised = promised_totals(sized, targets)
    near = (F.abs(F.col("tokens") - F.col("promised")) <= F.col("slack")).alias("near")
    return out.join(promised, ["shortfall", "mix_name"]).select("shortfall", "mix_name", "over", F.round("promised").cast("long").alias("promised"), near)


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each split record: tokens less the overlaps, first and last character, whether all pieces are within the limit."""
    sizes = table(spark, folder, "indices").select("index_name", F.col("max_parent_chunk_size").alias("most"), F.coalesce("parent_chunk_overlap_size", F.lit(0)).alias("lap"))
    pieces = p3_pieces(spark, folder).join(sizes, "index_name")
    lap = F.least(F.greatest("lap", F.lit(0)), F.col("most") - 1)
    return pieces.groupBy("document_id").agg(
        (F.sum(F.col("n_tokens") - lap) + F.max(lap)).cast("long").alias("n_tokens"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"),
        (F.max(F.col("n_tokens") - F.col("most")) <= 0).alias("fits"), (F.max("piece") + 1 == F.count(F.lit(1))).alias("numbered"))


def p8_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to exclude, with the reason."""
    return residue(table(spark, folder, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with unfilled slots, or of filler, error page or script notice alone."""
    return p8_reasons(spark, folder).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_pieces, p3_checks, p5_found, p5_neighbours, p6_found, p6_passages, p7_mix, p7_shares, p7_shares_plain, p7_totals, p8_found, p8_reasons)}
_WORDS = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_PAIRS = f"""WITH RECURSIVE d AS (SELECT DISTINCT document_id, {_WORDS.format('title')} AS t, {_WORDS.format('content')} AS c FROM document_store),
w AS (SELECT document_id, list_concat(t, c) AS w FROM d WHERE len(c) >= 20),
s AS (SELECT DISTINCT document_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM w),
n AS (SELECT document_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.document_id AS document_id_a, b.document_id AS document_id_b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.document_id < b.document_id GROUP BY ALL),
near AS (SELECT document_id_a, document_id_b FROM p JOIN n x ON x.document_id = document_id_a JOIN n y ON y.document_id = document_id_b WHERE 2 * o >= x.n + y.n - o)"""
_LEAKED = f"""WITH i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(12, len(w)) AS n, unnest([array_to_string(w[j : j + least(12, len(w)) - 1], ' ') FOR j IN range(1, len(w) - least(12, len(w)) + 2)]) AS g FROM i WHERE len(w) > 0),
t AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM t),
x AS (SELECT doc_id, text, n, unnest([{{'j': j, 'g': array_to_string(w[j : j + n - 1], ' ')}} FOR j IN range(1, len(w) - n + 2)], recursive := true) FROM d, (SELECT DISTINCT n FROM g)),
m AS (SELECT doc_id, text, item_id, n, j, j - row_number() OVER (PARTITION BY doc_id, text, item_id, n ORDER BY j) AS run FROM (SELECT DISTINCT doc_id, text, item_id, n, j FROM x JOIN g USING (n, g)))
SELECT doc_id, text, item_id, min(j) AS a, max(j) + n - 1 AS b FROM m GROUP BY doc_id, text, item_id, n, run"""
SQL = {
    "p6_passages": rf"""WITH p AS ({_LEAKED}),
o AS (SELECT *, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w, regexp_extract_all(text, '[^\p{{L}}\p{{N}}]+') AS s, regexp_matches(text, '^[^\p{{L}}\p{{N}}]')::INT AS lead FROM p)
SELECT doc_id, item_id, (coalesce(list_sum([length(z) FOR z IN w[1 : a - 1]]), 0) + coalesce(list_sum([length(z) FOR z IN s[1 : a - 1 + lead]]), 0))::INT AS start_char,
(list_sum([length(z) FOR z IN w[1 : b]]) + coalesce(list_sum([length(z) FOR z IN s[1 : b - 1 + lead]]), 0))::INT AS end_char, (b - a + 1)::INT AS n_words FROM o""",
    "p1_found": f"""{_PAIRS}
SELECT document_id_a, document_id_b FROM near""",
    "p1_groups": f"""{_PAIRS},
e AS (SELECT document_id_a AS a, document_id_b AS b FROM near UNION ALL SELECT document_id_b, document_id_a FROM near),
r AS (SELECT document_id, document_id AS g FROM w UNION SELECT r.document_id, e.b FROM r JOIN e ON r.g = e.a),
k AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT document_id, min(g) AS group_id, coalesce(any_value(links), 0) AS links FROM r LEFT JOIN k ON k.a = document_id GROUP BY document_id""",
    "p3_found": r"""SELECT DISTINCT d.document_id FROM document_store d JOIN indices i ON d.index_name = i.index_name
WHERE i.max_parent_chunk_size > 0 AND len(regexp_extract_all(d.content, '[^ \t\n\r\f]+')) > i.max_parent_chunk_size""",
    "p3_checks": r"""WITH d AS (SELECT DISTINCT document_id, index_name, content FROM document_store), j AS (SELECT d.*, len(regexp_extract_all(d.content, '[^ \t\n\r\f]+')) AS n, max_parent_chunk_size AS m FROM d JOIN indices i USING (index_name))
SELECT document_id, n AS n_tokens, length(regexp_extract(content, '^[ \t\n\r\f]*'))::INTEGER AS start_char, length(regexp_replace(content, '[ \t\n\r\f]+$', ''))::INTEGER AS end_char, true AS fits, true AS numbered FROM j WHERE m > 0 AND n > m""",
    "p7_totals": r"""WITH t AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT mix_name, source, greatest(coalesce(max_repeats, 1), 0) AS most, coalesce(target_share, 0) * coalesce(budget_ratio, 0) * (SELECT sum(n) FROM t) AS wanted FROM mix_targets),
u AS (SELECT w.mix_name, arg_min(t.source, doc_id) AS source, any_value(n) AS n FROM t JOIN w USING (source) WHERE n > 0 GROUP BY w.mix_name, text),
b AS (SELECT w.mix_name, w.source, wanted, most * coalesce(held, 0) AS bound FROM w LEFT JOIN (SELECT mix_name, source, sum(n) AS held FROM u GROUP BY ALL) USING (mix_name, source)),
s AS (SELECT mix_name, sum(wanted) AS wanted, sum(CASE WHEN wanted > 0 THEN bound END) AS bound, sum(least(wanted, bound)) AS kept, least(1, min(CASE WHEN bound > 0 AND wanted > 0 THEN bound / wanted END)) * sum(CASE WHEN bound > 0 THEN wanted END) AS scaled FROM b GROUP BY mix_name)
SELECT v.k AS shortfall, mix_name, 0::BIGINT AS over, round(CASE v.k WHEN 'leave' THEN kept WHEN 'fill' THEN least(wanted, bound) ELSE scaled END)::BIGINT AS promised, true AS near FROM s, (VALUES ('leave'), ('fill'), ('scale')) v(k)""",
    "p5_found": """WITH v AS (SELECT vec_id, any_value(embedding)::DOUBLE[] AS e FROM child_chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
c AS (SELECT a.vec_id AS q, b.vec_id AS o, list_cosine_similarity(a.e, b.e) AS s FROM knn_probes k JOIN v a ON a.vec_id = k.vec_id JOIN v b ON b.vec_id <> a.vec_id),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, o) <= 10)
SELECT DISTINCT least(q, o) AS vec_id_a, greatest(q, o) AS vec_id_b FROM t""",
    "p6_found": f"""WITH i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(12, len(w)) AS n, unnest([array_to_string(w[j : j + least(12, len(w)) - 1], ' ') FOR j IN range(1, len(w) - least(12, len(w)) + 2)]) AS g FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
x AS (SELECT DISTINCT doc_id, n, unnest([array_to_string(w[j : j + n - 1], ' ') FOR j IN range(1, len(w) - n + 2)]) AS g FROM d, (SELECT DISTINCT n FROM g))
SELECT DISTINCT doc_id, item_id FROM x JOIN g USING (n, g)""",
}

"""Documents of an index: ingest, update, delete, reads. Chunks follow their document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.errors import NotFound
from shardloom.functions.placement import shard_of
from shardloom.functions.text import chunk_count, chunk_text, chunks, tokens
from shardloom.operators.numbering import running_sums
from shardloom.sources.scratch import materialize

KEY = ("index_name", "document_id")
Embedder = Callable[[Column], Column]


def once(documents: DataFrame, columns: Sequence[str], key: Sequence[str] = KEY, order: str = "loaded_at") -> DataFrame:
    """One row a key: the one loaded last; copies of a row are one. Ties go to the greater columns."""
    last = F.max(F.struct(order, *columns)).alias("last")
    return documents.groupBy(*key).agg(last).select(*key, *[F.col(f"last.{c}").alias(c) for c in columns])


def placed(documents: DataFrame, indices: DataFrame) -> DataFrame:
    """documents with the shard_number that their index gives them; rows of unknown indices are left out."""
    shards = indices.select("index_name", F.col("number_of_shards").alias("_n"))
    both = documents.drop("shard_number").join(shards, "index_name")
    return both.withColumn("shard_number", shard_of(F.col("index_name"), F.col("document_id"), F.col("_n"))).where("shard_number IS NOT NULL").drop("_n")


def new_documents(documents: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to ingest, rows that conflict with an existing document). Of rows that repeat a key one is kept."""
    rows = incoming.dropDuplicates(list(KEY))
    known = documents.select(*KEY)
    return rows.join(known, list(KEY), "left_anti"), rows.join(known, list(KEY), "left_semi")


_SIZES = ("max_parent_chunk_size", "parent_chunk_overlap_size", "max_child_chunk_size", "child_chunk_overlap_size")


def counted(documents: DataFrame, indices: DataFrame) -> DataFrame:
    """documents with the sizes of their index and the numbers of parent and child chunks, n_parents and n_children.

    The numbers follow from that of tokens: every parent but the last is full.
    """
    rows = documents.join(indices.select("index_name", *_SIZES), "index_name")
    size, lap, child, child_lap = (F.col(c) for c in _SIZES)
    n = F.size(tokens(F.col("content")))
    rows = rows.withColumn("_n", n).withColumn("n_parents", F.coalesce(chunk_count(F.col("_n"), size, lap), F.lit(0)))
    k = F.col("n_parents")
    rest = F.col("_n") - (k - 1) * (size - lap)
    full = F.when(k > 1, (k - 1) * chunk_count(size, child, child_lap)).otherwise(0)
    return rows.withColumn("n_children", F.when(k > 0, full + chunk_count(rest, child, child_lap)).otherwise(0)).drop("_n")


def cut(documents: DataFrame, indices: DataFrame) -> DataFrame:
    """documents (key columns and content) with `pieces`, the parents' texts and those of their children, and their numbers.

    Tokens are found once. Columns: those of documents but content, pieces array<struct<content, children array<string>>>,
    n_parents, n_children. Settings that chunks() doesn't take, and texts without tokens, give no pieces.
    """
    head = [c for c in documents.columns if c != "content"]
    # tokens are a column of their own: inside a lambda they would be found again for every chunk
    rows = documents.join(indices.select("index_name", *_SIZES), "index_name").withColumn("_t", tokens(F.col("content")))
    rows = rows.withColumn("_p", chunks(F.col("_t"), F.col("max_parent_chunk_size"), F.col("parent_chunk_overlap_size")))
    inner = lambda p: F.transform(chunks(p, F.col("max_child_chunk_size"), F.col("child_chunk_overlap_size")), chunk_text)
    pieces = F.transform("_p", lambda p: F.struct(chunk_text(p).alias("content"), F.coalesce(inner(p), F.array().cast("array<string>")).alias("children")))
    rows = rows.select(*head, F.coalesce(pieces, F.array().cast("array<struct<content:string,children:array<string>>>")).alias("pieces"))
    return rows.select("*", F.size("pieces").alias("n_parents"), F.aggregate("pieces", F.lit(0), lambda n, p: n + F.size(p["children"])).alias("n_children"))


def chunked(documents: DataFrame, indices: DataFrame, parents_taken: DataFrame, children_taken: DataFrame, embed: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(parent_chunks, child_chunks) of placed documents (index_name, shard_number, document_id, content).

    Ids continue after the greatest number that the shard has (index_name, shard_number, id in the taken tables), by
    document_id and place. Numbers are given to documents, not to chunks: a document's chunks follow one another.
    """
    shard = ("index_name", "shard_number")
    made = materialize(cut(documents.select(*shard, "document_id", "content"), indices), "pieces")
    narrow = made.select(*shard, "document_id", "n_parents", "n_children").where("n_parents > 0")
    first = running_sums(narrow, shard, ("document_id",), {"_first_parent": F.col("n_parents"), "_first_child": F.col("n_children")})
    for name, taken in (("_first_parent", parents_taken), ("_first_child", children_taken)):
        most = taken.groupBy(*shard).agg(F.max("id").alias("_most"))
        first = first.join(most, list(shard), "left").withColumn(name, F.col(name) + F.coalesce(F.col("_most") + 1, F.lit(0))).drop("_most")
    rows = made.join(first.select(*shard, "document_id", "_first_parent", "_first_child"), [*shard, "document_id"])
    parents = rows.select("*", F.posexplode("pieces").alias("chunk_index", "piece"))
    parent_id = (F.col("_first_parent") + F.col("chunk_index")).alias("parent_chunk_id")
    every = F.flatten(F.transform("pieces", lambda p, i: F.transform(p["children"], lambda c, j: F.struct(i.alias("chunk_index"), j.alias("child_index"), c.alias("text")))))
    children = rows.select(*shard, "document_id", "_first_parent", "_first_child", F.posexplode(every).alias("nth", "c")).select("*", "c.*")
    embedding = embed(F.col("text")) if embed else F.lit(None).cast("array<float>")
    children = children.select(*shard, "document_id", parent_id, "child_index", "text", (F.col("_first_child") + F.col("nth")).alias("child_chunk_id"), embedding.alias("embedding"))
    return parents.select(*shard, "document_id", "chunk_index", "piece.content", parent_id), children


def ingest(documents: DataFrame, indices: DataFrame, incoming: DataFrame, parents_taken: DataFrame, children_taken: DataFrame, embed: Embedder | None = None) -> dict[str, DataFrame]:
    """Tables to append: parent_chunks, child_chunks, documents, conflicts.

    incoming: index_name, document_id, title, content. Chunks are numbered as in chunked(). Documents without text are
    kept without chunks.
    """
    fresh, conflicts = new_documents(documents, incoming)
    rows = placed(fresh, indices)
    parents, children = chunked(rows, indices, parents_taken, children_taken, embed)
    return {"parent_chunks": parents, "child_chunks": children, "documents": rows, "conflicts": conflicts}


def upsert(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """documents with the incoming rows in the place of rows of the same key. Columns are those of documents."""
    new = incoming.dropDuplicates(list(KEY)).select(documents.columns)
    return documents.join(new.select(*KEY), list(KEY), "left_anti").unionByName(new)


def update(documents: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """documents after changes (title, content, metadata, each kept where null), with `rechunk` where content is given.

    Metadata is replaced, not merged; empty content is content. Changes to unknown documents have no effect.
    """
    new = changes.dropDuplicates(list(KEY)).select(*KEY, *[F.col(c).alias(f"_{c}") for c in ("title", "content", "metadata")], F.lit(True).alias("_hit"))
    both = documents.join(new, list(KEY), "left")
    hit = F.coalesce("_hit", F.lit(False))
    kept = [c for c in documents.columns if c not in ("title", "content", "metadata", "modification_timestamp")]
    return both.select(*kept, *[F.coalesce(f"_{c}", c).alias(c) for c in ("title", "content", "metadata")], F.when(hit, now).otherwise(F.col("modification_timestamp")).alias("modification_timestamp"), (hit & F.col("_content").isNotNull()).alias("rechunk"))


def rebuild(documents: DataFrame, indices: DataFrame, parents: DataFrame, children: DataFrame, changes: DataFrame, now: Column, embed: Embedder | None = None) -> dict[str, DataFrame]:
    """The tables documents, parent_chunks and child_chunks after changes; where content is given, chunks are made again.

    The old chunks and vectors of such documents go, and the new ones are numbered after the greatest ids of their shard,
    the old ones included, so that no id is used twice. Chunks of other documents stay. Chunk tables have the columns that
    chunked() gives, and others, which are null in new rows.
    """
    after = materialize(update(documents, changes, now), "updated")
    again = after.where("rechunk")
    taken = lambda t, c: t.select("index_name", "shard_number", F.col(c).alias("id"))
    fresh = chunked(placed(again.select("index_name", "document_id", "content"), indices), indices, taken(parents, "parent_chunk_id"), taken(children, "child_chunk_id"), embed)
    keys = again.select(*KEY)
    kept = [old.join(keys, list(KEY), "left_anti").unionByName(new, allowMissingColumns=True) for old, new in zip((parents, children), fresh)]
    return {"documents": after.drop("rechunk"), "parent_chunks": kept[0], "child_chunks": kept[1]}


def delete(documents: DataFrame, parents: DataFrame, children: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents (index_name, document_id), their chunks and vectors."""
    keys = gone.select(*KEY).distinct()
    return tuple(t.join(keys, list(KEY), "left_anti") for t in (documents, parents, children))


def get(documents: DataFrame, indices: DataFrame, index: str, document_id: str) -> DataFrame:
    """The document's row. The shard is computed first, so that the scan reads one partition. Raises NotFound."""
    row = indices.where(F.col("index_name") == index).select("number_of_shards").first()
    if row is None:
        raise NotFound(f"no index {index}")
    spark = documents.sparkSession
    shard = spark.range(1).select(shard_of(F.lit(index), F.lit(document_id), F.lit(row[0]))).first()[0] if row[0] else None
    found = documents.where((F.col("index_name") == index) & (F.col("document_id") == document_id))
    return found.where(F.col("shard_number") == shard) if shard is not None else found


def exist(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """index_name, document_id, found of the distinct wanted keys."""
    known = documents.select(*KEY, F.lit(True).alias("found")).distinct()
    return wanted.select(*KEY).distinct().join(known, list(KEY), "left").withColumn("found", F.coalesce("found", F.lit(False)))

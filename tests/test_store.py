import pytest
from pyspark.sql import functions as F

from shardloom.errors import AlreadyExists, InvalidArgument, NotFound
from shardloom.operators import catalog, documents
from shardloom.sources.store import Store

INDEX = "index_name string, description string, number_of_shards int, max_parent_chunk_size int, max_child_chunk_size int, parent_chunk_overlap_size int, child_chunk_overlap_size int, creation_timestamp timestamp, modification_timestamp timestamp"

def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def index(spark, *rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], INDEX)


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0
    with pytest.raises(NotFound):
        store.read("t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, index_name string")
    store.commit({"t": df}, partition_by=("index_name",))
    store.commit({"t": df.where("id = 1")}, append=True, partition_by=("index_name",))
    assert store.read("t").count() == 3 and store.read("t", 1).count() == 2
    plan = store.read("t").where("index_name = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(index_name" in plan
    other = Store(spark, str(tmp_path / "s"))
    other.version = lambda: 1  # a writer that started earlier
    with pytest.raises(AlreadyExists):
        other.commit({"u": df})
    store.commit({}, drop=("t",))
    with pytest.raises(NotFound):
        store.read("t")


def test_empty_tables_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.vacuum() == 0
    df = spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")
    store.create({"vectors": df.schema, "other": df.schema})
    assert store.read("vectors").count() == 0 and store.read("vectors").schema == df.schema
    with pytest.raises(AlreadyExists):
        store.create({"vectors": df.schema})
    store.commit({"vectors": df}, append=True)
    store.commit({"vectors": df})
    store.commit({}, drop=("other",))
    assert store.vacuum() == 3 and store.read("vectors").count() == 1 and store.version() == 4
    with pytest.raises(NotFound):
        store.read("other")


def test_catalogue(spark):
    have = index(spark, ("a", "old", 2, 10, 4, 2, 1))
    with pytest.raises(AlreadyExists):
        catalog.create(have, have, now())
    for bad in (("n", "", 0, 10, 4, 2, 1), ("n", "", None, 10, 4, 2, 1), ("n", "", 1, 10, 4, 10, 1), ("n", "", 1, 0, 4, 0, 1), ("", "", 1, 10, 4, 2, 1)):
        with pytest.raises(InvalidArgument):
            catalog.create(have, index(spark, bad), now())
    two = catalog.create(have, index(spark, ("b", None, 3, 10, 4, 2, 1)), now())
    assert catalog.shards_of(two).count() == 5
    changed = catalog.update(two, spark.createDataFrame([("a", None), ("b", "new"), ("z", "x")], "index_name string, description string"), now())
    assert {(r.index_name, r.description) for r in changed.collect()} == {("a", "old"), ("b", "new")}
    with pytest.raises(NotFound):
        catalog.get(two, "z")


def test_document_life(spark):
    have = index(spark, ("a", "", 2, 4, 2, 1, 0))
    docs = spark.createDataFrame([("a", "d1", "t", "w " * 3, {"k": "v"}, None)], "index_name string, document_id string, title string, content string, metadata map<string,string>, modification_timestamp timestamp")
    incoming = spark.createDataFrame([("a", "d1", "t", "x"), ("a", "d2", "t", "1 2 3 4 5 6 7"), ("a", "d2", "t", "1 2 3 4 5 6 7"), ("a", "d3", None, " "), ("a", "d4", None, None), ("zz", "d5", "t", "x")], "index_name string, document_id string, title string, content string")
    taken = spark.createDataFrame([("a", s, i) for s in (0, 1) for i in (8, 9, 10, 11)], "index_name string, shard_number int, id long")
    made = documents.ingest(docs, have, incoming, taken, taken)
    assert [r.document_id for r in made["conflicts"].collect()] == ["d1"]
    parents = made["parent_chunks"].orderBy("chunk_index").collect()
    assert [(r.document_id, r.content, r.parent_chunk_id) for r in parents] == [("d2", "1 2 3 4", 12), ("d2", "4 5 6 7", 13)]
    kids = made["child_chunks"].orderBy("child_chunk_id").collect()
    assert [(r.text, r.parent_chunk_id, r.child_chunk_id) for r in kids] == [("1 2", 12, 12), ("3 4", 12, 13), ("4 5", 13, 14), ("6 7", 13, 15)]
    assert {r.document_id for r in made["documents"].collect()} == {"d2", "d3", "d4"}
    change = spark.createDataFrame([("a", "d1", None, "", None), ("a", "no", "x", None, None)], "index_name string, document_id string, title string, content string, metadata map<string,string>")
    r = documents.update(docs, change, now()).first()
    assert (r.title, r.content, r.metadata, r.rechunk) == ("t", "", {"k": "v"}, True)
    left = documents.delete(docs, made["parent_chunks"], made["child_chunks"], spark.createDataFrame([("a", "d2")], "index_name string, document_id string"))
    assert [t.count() for t in left] == [1, 0, 0]
    with pytest.raises(NotFound):
        documents.get(docs, have, "zz", "d1")


def test_update_cuts_again(spark):
    have = index(spark, ("a", "", 1, 4, 2, 1, 0))
    docs = spark.createDataFrame([("a", "d1", "t", "1 2 3", None, None), ("a", "d2", "t", "x y", None, None)], "index_name string, document_id string, title string, content string, metadata map<string,string>, modification_timestamp timestamp")
    parents = spark.createDataFrame([("a", 0, "d1", 0, "1 2 3", 4), ("a", 0, "d2", 0, "x y", 5)], "index_name string, shard_number int, document_id string, chunk_index int, content string, parent_chunk_id long")
    children = spark.createDataFrame([("a", 0, "d1", 4, 0, "1 2", 7), ("a", 0, "d1", 4, 1, "3", 8), ("a", 0, "d2", 5, 0, "x y", 9)], "index_name string, shard_number int, document_id string, parent_chunk_id long, child_index int, text string, child_chunk_id long")
    change = spark.createDataFrame([("a", "d1", None, "5 6 7 8 9", None), ("a", "d2", "new", None, None)], "index_name string, document_id string, title string, content string, metadata map<string,string>")
    after = documents.rebuild(docs, have, parents, children, change, now())
    assert {(r.document_id, r.title, r.content) for r in after["documents"].collect()} == {("d1", "t", "5 6 7 8 9"), ("d2", "new", "x y")}
    assert [(r.document_id, r.parent_chunk_id, r.content) for r in after["parent_chunks"].orderBy("parent_chunk_id").collect()] == [("d2", 5, "x y"), ("d1", 6, "5 6 7 8"), ("d1", 7, "8 9")]
    assert [(r.parent_chunk_id, r.child_chunk_id, r.text) for r in after["child_chunks"].orderBy("child_chunk_id").collect()] == [(5, 9, "x y"), (6, 10, "5 6"), (6, 11, "7 8"), (7, 12, "8 9")]

"""A write-ahead log in segments of framed records, read by Spark from its bytes.

A record is `length` (4 bytes, big-endian), `crc` (4 bytes, CRC-32 of the payload) and the payload, a change as JSON.
A record whose checksum doesn't hold is skipped; a record that the file doesn't hold to its end (a crash while writing)
ends its segment. Segments are numbered files and hold whole records; one is closed when it reaches its size.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 64 << 20
_HEAD = struct.Struct(">II")
FIELDS = "seq long, ts double, op string, pid int, col string, key string, val string, ttl double"


def frame(payload: bytes) -> bytes:
    return _HEAD.pack(len(payload), zlib.crc32(payload)) + payload


def frames(raw: bytes) -> Iterator[tuple[bytes | None, bool]]:
    """(payload, intact) of the records of a segment; (None, False) at last where it is cut off."""
    at = 0
    while at < len(raw):
        if at + _HEAD.size > len(raw):
            yield None, False
            return
        n, crc = _HEAD.unpack_from(raw, at)
        payload = raw[at + _HEAD.size : at + _HEAD.size + n]
        if len(payload) < n:
            yield None, False
            return
        yield payload, zlib.crc32(payload) == crc
        at += _HEAD.size + n


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path, fs


def segments(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the segments in order of writing."""
    path, fs = _files(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().endswith(".wal"))


def append(log: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> int:
    """Append changes (the columns of FIELDS) to the log in new segments; returns how many segments it wrote.

    Every task writes segments of its own, rotated by size, so that a log of any length is appended in parallel; order
    is that of seq, not of files. Segments appear by a rename, so that readers see none that is being written. A task
    that runs again writes files of the same names.
    """
    spark = log.sparkSession
    path, fs = _files(spark, folder)
    fs.mkdirs(path)
    first = len(segments(spark, folder))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                record = frame(json.dumps(row, ensure_ascii=False, separators=(",", ":")).encode())
                if held and size + len(record) > segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["segment"])
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["segment"])

    columns = [c.split()[0] for c in FIELDS.split(", ")]
    rows = log.select(*[(F.unix_micros("ts") / 1e6).alias(c) if c == "ts" and dict(log.dtypes)["ts"] == "timestamp" else F.col(c) for c in columns])
    # numbered by place, so that names don't depend on the task that writes
    packed = rows.mapInArrow(pack, "segment binary").select("segment", F.monotonically_increasing_id().alias("n"))
    conf = spark.sparkContext.broadcast({"folder": folder.removeprefix("file://"), "first": first})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        store, root = arrow_fs.FileSystem.from_uri(conf.value["folder"]) if "://" in conf.value["folder"] else (arrow_fs.LocalFileSystem(), conf.value["folder"])
        for batch in batches:
            done = 0
            for raw, n in zip(batch.column(0), batch.column(1).to_pylist()):
                name = f"{root}/{conf.value['first']:012d}-{n:020d}"
                with store.open_output_stream(f"{name}.part") as out:
                    out.write(raw.as_py())
                store.move(f"{name}.part", f"{name}.wal")
                done += 1
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int32())], ["written"])

    return packed.mapInArrow(write, "written int").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The intact records of all segments: segment (its name) and the columns of FIELDS, parsed from the stored bytes.

    A segment is one file and one row of the reader, at most a segment's size in memory. A folder without segments gives
    no rows.
    """
    found = segments(spark, folder)
    if not found:
        return spark.createDataFrame([], f"segment string, {FIELDS}")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                good = [p.decode() for p, ok in frames(raw.as_py()) if ok]
                name = path.rsplit("/", 1)[-1]
                for i in range(0, len(good), 10_000):
                    part = good[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part)], ["segment", "payload"])

    files = spark.read.format("binaryFile").load(found).select("path", "content")
    return files.mapInArrow(parse, "segment string, payload string").select("segment", F.from_json("payload", FIELDS).alias("r")).select("segment", "r.*")


def compact(spark: SparkSession, folder: str, segment_bytes: int = SEGMENT_BYTES) -> int:
    """Replace the segments by those of the log that rebuilds the same state; returns how many there are then.

    The new segments are written before the old ones go: a reader in between sees both, which gives the same state, since
    replaying is idempotent.
    """
    from shardloom.operators.cache import compact as shortest

    old = segments(spark, folder)
    log = scan(spark, folder).withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    wrote = append(shortest(log), folder, segment_bytes)
    path, fs = _files(spark, folder)
    for p in old:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p), False)
    return wrote

"""Tables in versions: a write makes a new version directory, and a manifest makes it visible."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from shardloom.errors import AlreadyExists, NotFound


class Store:
    """Named tables under one root, on file systems whose rename is atomic and refuses a target that exists (HDFS, local).

    commit() writes every table of a change and then a manifest that names their directories, by renaming it into
    place; readers take the newest manifest, so that they see all of a change or nothing. Two writers that start from
    the same version can't both commit. Tables may be partitioned, by default by index and shard.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        if not self._fs.exists(self._path(f"{self.root}/_manifests")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_manifests"))]
        return max([int(n[:-5]) for n in names if n.endswith(".json")], default=0)

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table at a version, the newest by default. Its schema is that of the commit, never inferred."""
        found = self._manifest(self.version() if version is None else version).get(name)
        if found is None:
            raise NotFound(f"no table {name}")
        schema = StructType.fromJson(found["schema"])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*found["paths"])
        return rows.select(schema.fieldNames())  # without the directory of the commit

    def create(self, schemas: dict[str, StructType], partition_by: tuple[str, ...] = ()) -> int:
        """Empty tables of the given schemas; names that exist raise."""
        known = self._manifest(self.version())
        for name in schemas:
            if name in known:
                raise AlreadyExists(f"table {name} exists")
        return self.commit({name: self.spark.createDataFrame([], schema) for name, schema in schemas.items()}, partition_by=partition_by)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the newest `keep` versions names, and older manifests; returns how many directories went.

        Tables that were dropped or replaced go with them. Readers of older versions, and writers at work, must be done.
        """
        newest = self.version()
        kept = {p.rsplit("/", 1)[-1] for v in range(max(1, newest - keep + 1), newest + 1) for t in self._manifest(v).values() for p in t["paths"]}
        gone = 0
        for table in self._fs.listStatus(self._path(self.root)) if newest else ():
            if table.getPath().getName() == "_manifests":
                continue
            for part in self._fs.listStatus(table.getPath()):
                if part.getPath().getName() not in kept:
                    gone += bool(self._fs.delete(part.getPath(), True))
        for v in range(1, max(1, newest - keep + 1)):
            self._fs.delete(self._path(f"{self.root}/_manifests/{v:012d}.json"), False)
        return gone

    def commit(self, tables: dict[str, DataFrame], append: bool = False, partition_by: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> int:
        """Write the tables as the next version, in the place of their rows or after them; the other tables stay."""
        base = self.version()
        manifest = {k: v for k, v in self._manifest(base).items() if k not in drop}
        for name, df in tables.items():
            path = f"{self.root}/{name}/commit=c{uuid.uuid4().hex}"
            by = [c for c in partition_by if c in df.columns]
            (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
            before = manifest.get(name, {}).get("paths", []) if append else []
            columns = [f for f in df.schema if f.name not in by] + [f for f in df.schema if f.name in by]
            manifest[name] = {"paths": [*before, path], "schema": StructType(columns).jsonValue()}
        new = f"{self.root}/_manifests/{base + 1:012d}.json"
        part = f"{self.root}/_manifests/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(part), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(self._path(new)) or not self._fs.rename(self._path(part), self._path(new)):
            self._fs.delete(self._path(part), False)
            raise AlreadyExists("another writer committed this version")
        return base + 1

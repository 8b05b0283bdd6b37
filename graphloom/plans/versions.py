"""Versioned tables in a folder: parts are files of numbered buckets, a version is a small manifest.

A writer puts new part files beside the old ones and then a manifest under the next number,
by a rename that fails if the number is taken. The newest manifest is the state: readers see
one version or the next, a writer that dies leaves the old one whole, and two writers can't
both win. Files that only manifests before the last two name are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Versions:
    """``schemas`` gives each table's columns, ``keys`` those whose hash says the bucket."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, list[str]]):
        self.spark, self.root, self.schemas, self.keys = spark, root.rstrip("/"), schemas, keys
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def files(self, name: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._path(name))] if self._fs.exists(self._path(name)) else []

    def versions(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self.files("manifests") if x.endswith(".json") and not x.startswith("_"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, tables: {name: {buckets, parts: {bucket: folder}}}} of a version, the newest by default."""
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {t: {"buckets": 0, "parts": {}} for t in self.schemas}}
        stream = self._fs.open(self._path(f"manifests/{known[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @staticmethod
    def folder(version: int) -> str:
        return f"v{version:08d}-{uuid.uuid4().hex[:8]}"

    def commit(self, manifest: dict) -> None:
        name = f"manifests/{manifest['version']:08d}.json"
        draft = self._path(f"manifests/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(draft, self._path(name)):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.root}: another update wrote version {manifest['version']}")
        self._prune()

    def _prune(self) -> None:
        known = self.versions()
        held = [{(t, b, f) for t, x in self.manifest(v)["tables"].items() for b, f in x["parts"].items()} for v in known[-3:]]
        for t, b, folder in held[0] - held[1] - held[2] if len(held) == 3 else ():
            self._fs.delete(self._path(f"{folder}/{t}/bucket={b}"), True)
        for v in known[:-2]:
            self._fs.delete(self._path(f"manifests/{v:08d}.json"), False)

    def bucket(self, table: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(buckets)).cast("int")

    def touched(self, table: str, buckets: int, rows: DataFrame) -> set[int]:
        """The buckets that ``rows`` (with the table's key columns) fall into, at most ``buckets`` numbers."""
        return {r[0] for r in rows.select(self.bucket(table, buckets)).distinct().collect()}

    def read(self, table: str, at: set[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table of the state, or only its buckets ``at``."""
        parts = (manifest or self.manifest())["tables"][table]["parts"]
        paths = [f"{self.root}/{f}/{table}/bucket={b}" for b, f in parts.items() if at is None or int(b) in at]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).option("recursiveFileLookup", "true").parquet(*paths)

    def write(self, old: dict, new: dict, folder: str, table: str, rows: DataFrame, buckets: int, at: set[int], *spread: Column) -> None:
        """Put ``rows``, the new contents of the buckets ``at`` (of all, if their number changes), into ``new``."""
        was, columns = old["tables"][table], self.spark.createDataFrame([], self.schemas[table]).columns
        out = rows.select(*columns).withColumn("bucket", self.bucket(table, buckets)).repartition("bucket", *spread)
        out.write.partitionBy("bucket").parquet(f"{self.root}/{folder}/{table}")
        made = {x.split("=")[1]: folder for x in self.files(f"{folder}/{table}") if x.startswith("bucket=")}
        kept = {b: f for b, f in was["parts"].items() if int(b) not in at} if buckets == was["buckets"] else {}
        new["tables"][table] = {"buckets": buckets, "parts": kept | made}

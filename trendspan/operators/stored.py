"""Tables that are merged into: rows lie in parts by a hash of their key, and a merge rewrites only the parts that its keys fall into.

New versions of parts are written beside the old ones; what counts is named by a manifest, and a merge takes effect as a whole by
the rename of one small file, which fails if another merge took its number. The manifest lists the batches that went in, so a batch that is
sent again, as a restarted stream does, changes nothing. Readers of an older manifest still find their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a table; a merge reads and writes whole parts.
PARTS = 32

Change = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another merge was committed in between."""


class StoredTable:
    """A table below a folder that the driver and all executors see; ``key`` are the columns that tell rows apart."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: list[str], parts: int = PARTS):
        self.spark, self.root, self.key, self.parts = spark, root.rstrip("/"), key, parts
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def manifest(self) -> dict:
        """The newest manifest: its version, where each part lies, and the batches that went in."""
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return {"version": 0, "parts": {}, "batches": []}
        newest = max((s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")), default=None)
        if newest is None:
            return {"version": 0, "parts": {}, "batches": []}
        stream = fs.open(self._path(f"manifests/{newest}"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, manifest: dict | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows, of all parts or only of some."""
        at = (manifest or self.manifest())["parts"]
        paths = [f"{self.root}/{where}" for part, where in sorted(at.items()) if only is None or int(part) in only]
        if not paths:
            # An empty list would be read by Python workers.
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, batch: DataFrame, change: Change, batch_id: str) -> bool:
        """Replace the rows of the parts that ``batch`` touches by ``change(their rows, batch)``; whether anything was done.

        ``batch`` has the key's columns. ``change`` gives rows of the table whose keys are of those parts. A batch id that went in before is passed over.
        """
        before = self.manifest()
        if batch_id in before["batches"]:
            return False
        part = F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")
        # There are no more of these than the table has parts.
        touched = sorted(r.part for r in batch.select(part.alias("part")).distinct().collect())
        version = before["version"] + 1
        at = dict(before["parts"])
        if touched:
            folder = f"data/{version:08d}-{uuid.uuid4().hex[:8]}"
            after = change(self.read(before, touched), batch).select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
            after.withColumn("part", part).write.partitionBy("part").parquet(f"{self.root}/{folder}")
            written = {s.getPath().getName() for s in self._fs().listStatus(self._path(folder))}
            for p in touched:
                at.pop(str(p), None)
                if f"part={p}" in written:
                    at[str(p)] = f"{folder}/part={p}"
        self._commit({"version": version, "parts": at, "batches": [*before["batches"], batch_id]})
        return True

    def vacuum(self) -> None:
        """Delete the files that the newest manifest doesn't name; nobody may read an older one."""
        fs, kept = self._fs(), set(self.manifest()["parts"].values())
        for version in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            for part in fs.listStatus(version.getPath()):
                if f"data/{version.getPath().getName()}/{part.getPath().getName()}" not in kept:
                    fs.delete(part.getPath(), True)

    def _commit(self, manifest: dict) -> None:
        fs, jvm = self._fs(), self.spark.sparkContext._jvm
        target, staged = self._path(f"manifests/{manifest['version']:08d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        jvm.org.apache.commons.io.IOUtils.write(json.dumps(manifest), out, "UTF-8")
        out.close()
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, False)
            raise Conflict(f"version {manifest['version']} is taken")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def absent_only(old: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Insert what isn't there; of equal keys in a batch any one."""
    return old.unionByName(batch.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))

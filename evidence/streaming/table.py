"""A keyed table that batches are merged into: data in hash buckets, versions named by manifests.

    data/v7/bucket=3/*.parquet    the rows of bucket 3 as batch 7 left them
    manifests/0000000007.json     which version each bucket has, and the batch that made it

A merge rewrites the buckets that the batch touches and no others. A version exists once its manifest does, which
is written aside and renamed, so readers see a whole version or the one before; what a failed merge leaves is
written over by the next. Manifests have a row a bucket, so they stay small however large the table is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.incremental import upsert_latest


class VersionedTable:
    """One row a key; of several the one of the latest `order`, and of those the largest."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets
        self._conf = spark._jsc.hadoopConfiguration()

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self._conf), path

    def versions(self) -> list[int]:
        fs, folder = self._file("manifests")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or of the latest; an empty one before the first."""
        known = self.versions()
        version = version if version is not None else max(known, default=None)
        if version is None:
            return {"version": 0, "batch": -1, "buckets": {}}
        fs, path = self._file(f"manifests/{version:010}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _rows(self, held: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version that is still kept, or the latest."""
        return self._rows(self.manifest(version)["buckets"])

    def merge(self, rows: DataFrame, batch: int, keep: int = 2) -> bool:
        """Merge the rows of a numbered batch; False where that batch, or a later one, is in the table already.

        Batches come one at a time and in order. The last `keep` versions stay for readers that have begun.
        """
        now = self.manifest()
        if batch <= now["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        names = [f.name for f in self.schema]
        touched = [str(r["b"]) for r in rows.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets
        version = now["version"] + 1
        held = dict(now["buckets"])
        if touched:
            old = self._rows({b: v for b, v in held.items() if b in touched})
            merged = upsert_latest(old, rows.select(*names), self.key, self.order)
            merged.withColumn("bucket", bucket).repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
            held |= dict.fromkeys(touched, version)
        self._commit({"version": version, "batch": batch, "buckets": held})
        self._clean(keep)
        return True

    def _commit(self, manifest: dict) -> None:
        fs, aside = self._file(f"manifests/.{manifest['version']:010}")
        _, final = self._file(f"manifests/{manifest['version']:010}.json")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not fs.rename(aside, final):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another merge")

    def _clean(self, keep: int) -> None:
        """Delete manifests before the last `keep`, and data that none of these name."""
        known = self.versions()
        for old in known[:-keep]:
            fs, path = self._file(f"manifests/{old:010}.json")
            fs.delete(path, False)
        used = {(b, v) for version in known[-keep:] for b, v in self.manifest(version)["buckets"].items()}
        fs, data = self._file("data")
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            version = int(folder.getPath().getName()[1:])
            for part in fs.listStatus(folder.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and (name[7:], version) not in used:
                    fs.delete(part.getPath(), True)
            if not any(v == version for _, v in used):
                fs.delete(folder.getPath(), True)

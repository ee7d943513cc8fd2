"""A stored table with keys: hash buckets, copy on write, one visible version.

Rows lie in a fixed number of buckets by the hash of their key.  A change writes
the buckets it touches as folders of a new version and then a manifest that
names the folder of every bucket; readers take the newest finished manifest, so
they see a change whole or not at all, and older versions stay readable.
Buckets that a change does not touch keep their files.  A change that names its
batch is applied once: running the batch again does nothing.

    store = KeyedStore.create(spark, path, "id string, name string", ["id"])
    store.apply(rows, lambda old, new: vectors.upsert(old, new), batch="2024-05-01")
    store.delete(gone)
    store.read()
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a store; the driver handles one manifest row for each.
BUCKETS = 64
_BUCKET = "__bucket"


class DuplicateKeys(ValueError):
    """A write that would have stored a key twice; nothing of it is visible."""


def finished_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions below ``path`` whose write has finished."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(root)
                  if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str):
        meta = spark.read.parquet(f"{path}/meta").first()
        self.spark, self.path = spark, path
        self.keys, self.buckets, self.schema = list(meta["keys"]), meta["buckets"], StructType.fromJson(json.loads(meta["schema"]))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = BUCKETS) -> KeyedStore:
        """An empty store; an error if there is one."""
        fields = spark.createDataFrame([], schema).schema
        spark.createDataFrame([(keys, buckets, fields.json())], "keys array<string>, buckets int, schema string").coalesce(1).write.parquet(f"{path}/meta")
        return cls(spark, path)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
        return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)

    # --- reading

    def versions(self) -> list[int]:
        return finished_versions(self.spark, f"{self.path}/manifest")

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """(version, folder of each bucket that has rows); at most one row a bucket."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return 0, {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/v={known[-1]}").filter("bucket >= 0").collect()
        return known[-1], {r["bucket"]: r["folder"] for r in rows}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the newest version or of an earlier one."""
        return self._read(sorted(set(self._manifest(version)[1].values())))

    # --- writing

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _applied(self, batch: str | None) -> bool:
        if batch is None or not self.versions():
            return False
        return bool(self.spark.read.parquet(f"{self.path}/manifest").filter(F.col("batch") == batch).limit(1).count())

    def _change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None, unique: bool) -> int:
        """Write the touched buckets as ``merge`` gives them, then the manifest; returns the version."""
        before, folders = self._manifest()
        if self._applied(batch):
            return before
        # one number a bucket
        touched = [r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()]
        if not touched:
            return before
        version = before + 1
        old = self._read(sorted(folders[b] for b in touched if b in folders))
        merged = merge(old, rows).select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(_BUCKET, self._bucket())
        seen = Observation()
        if unique:  # counted while the rows are written
            merged = merged.withColumn("__n", F.lit(1)).groupBy(*self.keys).agg(
                F.sum("__n").alias("__n"), F.first(F.struct(*[c for c in merged.columns if c not in self.keys])).alias("__r"))
            merged = merged.observe(seen, F.coalesce(F.sum((F.col("__n") > 1).cast("bigint")), F.lit(0)).alias("repeated"))
            merged = merged.select(*[F.col(k) for k in self.keys], "__r.*")
        data = f"{self.path}/data/v={version}"
        merged.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(data)
        if unique and seen.get["repeated"]:
            raise DuplicateKeys(f"{seen.get['repeated']} keys occur more than once")
        written = self._folders(data)
        new = {b: f for b, f in folders.items() if b not in touched} | {b: f"v={version}/{_BUCKET}={b}" for b in written}
        # a version that another writer finished meanwhile makes this write fail
        manifest = [(b, f, batch) for b, f in sorted(new.items())] or [(-1, "", batch)]
        self.spark.createDataFrame(manifest, "bucket int, folder string, batch string").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/v={version}")
        return version

    def _folders(self, data: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(data)
        names = [s.getPath().getName() for s in root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}=")]

    def apply(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None = None) -> int:
        """Merge ``rows`` (with the key columns) into the store: ``merge(old, rows)`` gives the new rows of the touched buckets.

        ``merge`` sees the stored rows of those buckets only and must decide key
        by key.
        """
        return self._change(rows, merge, batch, False)

    def insert(self, rows: DataFrame, batch: str | None = None) -> int:
        """Add rows whose keys are new; ``DuplicateKeys`` if one is stored already or comes twice, and then no row is visible."""
        names = self.schema.names
        return self._change(rows, lambda old, new: old.select(*names).unionByName(new.select(*names)), batch, True)

    def delete(self, keys: DataFrame, batch: str | None = None) -> int:
        """Remove the rows of these keys; rows with a null key stay."""
        return self._change(keys, lambda old, gone: old.join(gone.select(*self.keys).distinct(), self.keys, "left_anti"), batch, False)

"""Versioned tables: each write is a new folder of Parquet, and a pointer row says which one is current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators.hygiene import upsert


class StaleVersion(RuntimeError):
    """Another writer was first."""


class VersionedTable:
    """A table below a root that the cluster shares. Readers see whole versions; a failed write leaves the old one current; each writer has a version of its own."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{name}"

    def versions(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        done = lambda s: store.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in store.listStatus(path) if s.getPath().getName().startswith("v") and done(s))

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            raise FileNotFoundError(self.base)
        return self.spark.read.parquet(f"{self.base}/v{known[-1] if version is None else version}")

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Write a version. after: the version that df was made from (0: none); if another follows it or is being written, StaleVersion."""
        version = self._claimed(after)
        try:
            df.write.parquet(f"{self.base}/v{version}")
        except Exception:
            self._remove(f"_claim{version}")
            raise
        return version

    def _remove(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _claimed(self, after: int | None = None) -> int:
        """A number that no other writer has: its file is created by one alone, and goes if the write fails."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        store = path(self.base).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path(self.base))
        if after is not None:
            if (self.versions() or [0])[-1] != after or not store.createNewFile(path(f"{self.base}/_claim{after + 1}")):
                raise StaleVersion(f"{self.base} has gone on from version {after}")
            return after + 1
        version = (self.versions() or [0])[-1] + 1
        while not store.createNewFile(path(f"{self.base}/_claim{version}")):
            version += 1
        return version

    def upsert(self, new: DataFrame, key: str, hash_col: str) -> int:
        """Rows of an unchanged hash stay as they are; others replace or join the table."""
        payload = [c for c in new.columns if c not in (key, hash_col)]
        if not self.versions():
            return self.write(new.select(key, hash_col, *payload))
        return self.write(upsert(self.read(), new, key, hash_col, payload).drop("changed"))

    def delete(self, keys: DataFrame, key: str) -> int:
        return self.write(self.read().join(keys.select(key).distinct(), key, "left_anti"))

    def drop_old(self, keep: int = 2) -> None:
        for version in self.versions()[:-keep]:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/v{version}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class TableSet:
    """Tables that change together: a version names a folder of each, and is written when all of them are.

    Readers see all tables of one version. A commit that fails on the way, or that was prepared on an older
    version, leaves the last one as it is; tables that a commit doesn't give keep their folders.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = VersionedTable(spark, self.root, "versions")

    def version(self) -> int:
        """The last version; 0 before the first."""
        return (self.versions.versions() or [0])[-1]

    def folders(self, version: int | None = None) -> dict[str, str]:
        if not self.version():
            return {}
        return {r.table: r.folder for r in self.versions.read(version).collect()}

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table; None where there is none yet."""
        folder = self.folders(version).get(name)
        return self.spark.read.parquet(folder) if folder else None

    def commit(self, tables: dict[str, DataFrame], after: int | None = None) -> int:
        """Write tables and make them current together. after: the version that they were made from."""
        after = self.version() if after is None else after
        folders = self.folders()
        for name, df in tables.items():
            folders[name] = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(folders[name])
        rows = self.spark.createDataFrame(sorted(folders.items()), "table string, folder string").coalesce(1)
        return self.versions.write(rows, after=after)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """One row: the number of rows and a digest that does not depend on their order."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    parts = rows.select(*[F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(5)])
    return parts.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("-", *[F.sum(f"p{i}").cast("string") for i in range(5)]), 256).alias("digest"))


def newest_per_key(df: DataFrame, key: str, order: str, keep: int = 1) -> DataFrame:
    """The newest rows of each key; a single one by an aggregate, more by a ranked window."""
    if keep == 1:
        return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__rn") <= keep).drop("__rn")

"""Learned state as Parquet tables under one folder, by name.

A table is a folder of versions; a reader takes the newest complete one, a writer
adds one. So a job that is lost leaves the last version as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("examples", "generators", "generator_stats", "key_paths", "unsure_key_paths", "documents", "ledger", "versions")


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        if name not in TABLES:
            raise ValueError(f"no table {name!r}")
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self, name: str) -> list[str]:
        folder = self._folder(name)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in files.listStatus(folder) if s.isDirectory()]
        done = [n for n in names if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self, name: str, schema: str) -> DataFrame:
        """The newest version; an empty table of the schema if there is none."""
        found = self.versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{found[-1]}") if found else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame) -> None:
        self._folder(name)
        rows.write.parquet(f"{self.path}/{name}/{len(self.versions(name)):08d}-{uuid.uuid4()}")

    def append(self, name: str, rows: DataFrame, schema: str) -> None:
        self.write(name, self.read(name, schema).unionByName(rows))

    def upsert(self, name: str, rows: DataFrame, schema: str, keys: Sequence[str]) -> None:
        """The rows replace those of their keys."""
        order = Window.partitionBy(*keys).orderBy(F.desc("__new"))
        both = self.read(name, schema).withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
        self.write(name, both.withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at", "__new"))


def open_store(spark: SparkSession, url: str) -> Store:
    """A store by its URL: a path, or one of a file system Spark knows."""
    if url.startswith(("postgres", "sqlite", "jdbc:")):
        raise ValueError("a store is a folder of Parquet tables")
    return Store(spark, url.removeprefix("parquet:"))


def healthy(store: Store) -> str | None:
    """What is wrong with a store, or null."""
    try:
        store.versions(TABLES[0])
    except Exception as error:  # noqa: BLE001 - the answer is what went wrong
        return str(error).split("\n", 1)[0]
    return None

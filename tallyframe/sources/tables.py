"""Parquet scans by name and a catalog of named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# those from which the ledger's frames are made
LEDGER_TABLES = ("region", "nation", "supplier", "part", "orders", "lineitem", "events")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3: a parquet scan. Projection and filters written later reach the scan."""
    return spark.read.parquet(path)


def snapshot(spark: SparkSession, folder: str) -> tuple:
    """(path, size, time of change) of each of the ledger's table files in a folder: a key of what frames over it hold.

    Listed by Spark's own file system classes, so it works for any store that Spark reads. No data is read.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = []
    for table in LEDGER_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(root, f"{table}.parquet")
        if fs.exists(path):
            files = fs.listFiles(path, True)
            while files.hasNext():
                f = files.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


class Tables:
    """Lazy name -> DataFrame map over ``{root}/{name}.parquet``.

    Nothing is read until a table is used, and each scan is created once per
    catalog so a plan that uses a table twice shares one relation.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_parquet(self.spark, self.path(name))
        return self._cache[name]


def register_views(spark: SparkSession, frames: dict[str, DataFrame | str]) -> list[str]:
    """Register a set of tables (frames or parquet paths) under names."""
    names = []
    for name, src in frames.items():
        df = read_parquet(spark, src) if isinstance(src, str) else src
        df.createOrReplaceTempView(name)
        names.append(name)
    return names

"""S6/S7 parquet sinks and S11 stage counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", mode: str = "overwrite",
                  partition_by: tuple[str, ...] = ()) -> str:
    """S6 (zstd) / S7 (snappy): a distributed parquet write, one file per task (and partition value).

    ``partition_by`` lays out directories by low-cardinality columns so that
    equality filters on them prune whole directories at scan time.
    """
    w = df.write.mode(mode).option("compression", codec)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# The detail's most common filter (line-item pages by expense category) is on a
# 5-value column: partition the published detail by it.
DETAIL_PARTITIONS = ("expense_category",)


def publish(tables: dict[str, DataFrame], root: str, codec: str = "zstd") -> dict[str, str]:
    """Write each named frame to ``{root}/{name}.parquet``; returns the paths."""
    out = {}
    for name, df in tables.items():
        out[name] = write_parquet(df, f"{root.rstrip('/')}/{name}.parquet", codec)
    return out


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One (stage, rows) row per named frame, as one union plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
             for name, df in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def ingest_stage_counts(counts: DataFrame, rollups: dict[str, DataFrame]) -> DataFrame:
    """S11 for the ingest: raw, cleaned, removed (castable - cleaned), final, and each roll-up.

    ``counts`` is the one row of ``clean.ingest_counts``.
    """
    rows = [F.struct(F.lit(stage).alias("stage"), value.alias("rows")) for stage, value in (
        ("raw", F.col("raw")), ("cleaned", F.col("final")), ("final", F.col("final")),
        ("removed", F.col("castable") - F.col("final")))]
    own = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return own.unionByName(stage_counts(rollups))

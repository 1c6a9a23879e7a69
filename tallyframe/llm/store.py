"""Table access and the shared folder for intermediate tables."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and return the table read back.

    Cuts the lineage: a lost executor re-reads the files, it does not recompute.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exact(df: DataFrame, *names: str) -> DataFrame:
    """These columns by their exact names (of equal ones the first); no other column reaches an operator.

    Columns are picked by position, so names that differ only by case or that an operator uses itself don't clash.
    """
    at = [df.columns.index(c) for c in names]
    by_place = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"_{i}").alias(c) for i, c in zip(at, names, strict=True)])


def packed(df: DataFrame, *names: str) -> DataFrame:
    """These columns by their exact names, and all others in one struct, so that no name of theirs can clash."""
    at = [df.columns.index(c) for c in names]
    by_place = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    others = [F.col(f"_{i}") for i in range(len(df.columns)) if i not in at]
    return by_place.select(*[F.col(f"_{i}").alias(c) for i, c in zip(at, names, strict=True)],
                           F.struct(F.lit(0).alias("_"), *others).alias("other_columns"))


def unpacked(rows: DataFrame, df: DataFrame, *names: str) -> DataFrame:
    """``packed`` rows in the columns of ``df`` again, with what ``names`` hold now."""
    at = {df.columns.index(c): c for c in names}
    return rows.select(*[F.col(at[i] if i in at else f"other_columns._{i}").alias(c) for i, c in enumerate(df.columns)])


def text_columns(df: DataFrame) -> tuple[str, ...]:
    """The columns that a change of the text changes."""
    return ("text", "n_chars") if "n_chars" in df.columns else ("text",)


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """The columns an operator on documents works on."""
    return exact(df, "doc_id", "text", *extra)


def per_worker(key, make):
    """An object made once in each Python worker and kept for its later tasks.

    It is held by the interpreter, since functions are shipped to workers by value.
    """
    held = sys.__dict__.setdefault("_per_worker", {})
    if key not in held:
        held[key] = make()
    return held[key]

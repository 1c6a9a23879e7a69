"""All-text edge scans. No type inference at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_text(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV with a header row, every column read as text, header names trimmed.

    ``inferSchema`` stays off; Spark keeps padded header names, so they are
    trimmed here (``'  amount '`` becomes ``amount``). Empty fields, quoted
    or not, read as NULL; cell whitespace is kept. A quote inside a quoted
    cell is doubled. ``multiline`` lets quoted cells hold line breaks (a file is
    then one task); a record with surplus or malformed fields aborts the read.
    """
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("escape", '"').option("multiLine", multiline).option("mode", "FAILFAST")
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(path))
    return df.toDF(*[c.strip() for c in df.columns])


def as_text(df: DataFrame) -> DataFrame:
    """Cast every column to string (the raw ledger's all-text edge)."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def read_parquet_text(spark: SparkSession, path: str) -> DataFrame:
    """All-text scan of a parquet source."""
    return as_text(spark.read.parquet(path))

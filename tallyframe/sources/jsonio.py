"""Chart series and briefs as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_series(df: DataFrame, path: str) -> str:
    """A chart series (the data rows only) as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def brief_json(df: DataFrame, column: str = "executive_brief") -> DataFrame:
    """The brief as a one-field JSON document per row."""
    return df.select(F.to_json(F.struct(F.col(column).alias(column))).alias("value"))


def write_brief(df: DataFrame, path: str, column: str = "executive_brief") -> str:
    brief_json(df, column).write.mode("overwrite").text(path)
    return path

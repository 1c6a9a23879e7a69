"""Profiling a raw all-text table (Q1-Q6, D3) in single passes.

The reference scans once per column; here every per-column measure is one
``count_if`` inside a single aggregation, unpivoted afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.money import pct

# Text sentinels that count as missing.
MISSING_SENTINELS = ("N/A", "NA", "NULL")


def schema_listing(df: DataFrame) -> DataFrame:
    """Q1: (position, column_name, data_type) of a frame, from its schema (no scan)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)]
    schema = T.StructType([T.StructField("position", T.IntegerType()),
                           T.StructField("column_name", T.StringType()),
                           T.StructField("data_type", T.StringType())])
    return df.sparkSession.createDataFrame(rows, schema)


def sample(df: DataFrame, n: int = 10) -> DataFrame:
    """Q1: a small sample for display (a limit is the feature here)."""
    return df.limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """Q2."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def _unpivot(agg: DataFrame, names: list[str], value: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"),
                             F.col(f"_{i}").alias(value)) for i, n in enumerate(names, start=1)])
    return agg.select("*", F.explode(arr).alias("_u")).select("_u.*", *[c for c in agg.columns if not c.startswith("_")])


def missingness(df: DataFrame, columns=None, sentinels=MISSING_SENTINELS) -> DataFrame:
    """Q3: per column, rows that are NULL, blank or a sentinel; count and % (1 dp)."""
    names = list(columns or df.columns)
    return _missing_rows(df.agg(F.count(F.lit(1)).alias("total"), *_missing_counts(names, sentinels)), names)


def _missing_counts(names, sentinels=MISSING_SENTINELS):
    return [F.count_if(F.col(c).isNull() | (F.trim(F.col(c)) == "") | F.upper(F.trim(F.col(c))).isin(*sentinels)).alias(f"_{i}")
            for i, c in enumerate(names, start=1)]


def _missing_rows(agg: DataFrame, names: list[str]) -> DataFrame:
    return _unpivot(agg, names, "missing").select(
        "position", "column_name", "missing", "total", pct(F.col("missing"), F.col("total"), 1).alias("pct"))


def whitespace(df: DataFrame, columns=("department", "category")) -> DataFrame:
    """Q4: per column, rows whose value differs from its trimmed value."""
    names = list(columns)
    return _unpivot(df.agg(*_padded_counts(names)), names, "rows")


def _padded_counts(names):
    return [F.count_if(F.col(c) != F.trim(F.col(c))).alias(f"_{i}") for i, c in enumerate(names, start=1)]


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Q5: distinct non-null raw values, sorted."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def non_numeric(df: DataFrame, column: str = "amount") -> DataFrame:
    """Q6: present, non-blank values that do not parse as a number after comma removal."""
    return df.agg(_bad_amounts(column))


def _bad_amounts(column: str):
    c = F.col(column)
    bad = c.isNotNull() & (F.trim(c) != "") & F.replace(c, F.lit(","), F.lit("")).try_cast("double").isNull()
    return F.count_if(bad).alias("bad_amounts")


def normalized_key(department="department", agency="agency", amount="amount", category="category"):
    """D3's business key: lower/trim parts joined by '|' (NULL department -> NULL key)."""
    def low(c):
        return F.lower(F.trim(c))
    amt = F.replace(F.replace(F.coalesce(F.trim(F.col(amount)), F.lit("")), F.lit(","), F.lit("")),
                    F.lit(" "), F.lit(""))
    return F.concat(low(F.col(department)), F.lit("|"), low(F.coalesce(F.col(agency), F.lit(""))), F.lit("|"),
                    amt, F.lit("|"), low(F.coalesce(F.col(category), F.lit(""))))


def duplicate_count(df: DataFrame) -> DataFrame:
    """D3: COUNT(*) - COUNT(DISTINCT normalized key); a NULL key counts as a duplicate."""
    return df.agg(_repeated_rows())


def _repeated_rows():
    return (F.count(F.lit(1)) - F.count_distinct(normalized_key())).alias("duplicate_rows")


def report(df: DataFrame, padded=("department", "category"), category: str = "category") -> dict[str, DataFrame]:
    """Q2, Q3, D3, Q4 and Q6 of a table from one pass over it (one row), and Q5, which lists values, from its own."""
    names, spark = list(df.columns), df.sparkSession
    one = df.agg(F.count(F.lit(1)).alias("total"), *_missing_counts(names),
                 *[c.alias(f"p{i}") for i, c in enumerate(_padded_counts(padded))], _bad_amounts("amount"), _repeated_rows())
    facts = spark.createDataFrame([one.first()], one.schema)
    padding = facts.select(*[F.col(f"p{i}").alias(f"_{i + 1}") for i in range(len(padded))])
    return {"row_count": facts.select(F.col("total").alias("rows")),
            "missingness": _missing_rows(facts.select("total", *[f"_{i}" for i in range(1, len(names) + 1)]), names),
            "duplicates": facts.select("duplicate_rows"), "whitespace": _unpivot(padding, list(padded), "rows"),
            "categories": distinct_values(df, category), "non_numeric": facts.select("bad_amounts")}

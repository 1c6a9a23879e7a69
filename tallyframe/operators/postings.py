"""P13 by an index: trigrams of the searched columns, posted for each group of files.

Rows are stored in ``blocks`` directories of neighbouring rows. A needle of three characters or more can only
be in a block that holds all its trigrams, so a search reads those directories (partition pruning) and
checks every row of theirs as the plain search does. Shorter needles and wildcards read all. Trigrams are
those of the lower-cased text, as the search compares it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.explore import SEARCH_COLUMNS, search

BLOCK = "search_block"
GRAM = 3
_AT = rf"(?s)(?=({'.' * GRAM}))"


def trigrams(text: Column) -> Column:
    """The runs of three characters of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_AT), F.lit(1)))


@dataclass(frozen=True)
class Postings:
    """Stored ``rows`` (with their block) and ``grams`` (gram, block)."""

    rows: DataFrame
    grams: DataFrame
    columns: tuple[str, ...]

    def blocks(self, text: str) -> list[int] | None:
        """The blocks that hold every trigram of the needle; None for all. At most one number a block is collected."""
        spark = self.rows.sparkSession
        wanted = spark.range(1).select(trigrams(F.lit(text.strip()))).first()[0]
        if not wanted:
            return None
        held = (self.grams.where(F.col("gram").isin(wanted)).groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") == len(wanted)).select(BLOCK))
        return sorted(r[0] for r in held.collect())

    def search(self, text: str | None, wildcards: bool = False) -> DataFrame:
        """``explore.search`` over the rows, from the blocks that can hold a match."""
        rows = self.rows
        if text is not None and text.strip() and not wildcards:
            blocks = self.blocks(text)
            if blocks is not None:
                rows = rows.where(F.col(BLOCK).isin(blocks)) if blocks else rows.where(F.lit(False))
        return search(rows.drop(BLOCK), text, self.columns, wildcards)


def build(rows: DataFrame, path: str, columns=SEARCH_COLUMNS, blocks: int = 64) -> Postings:
    """Store ``rows`` in blocks of neighbours by ``columns`` under ``path``, and the trigrams of each block.

    Ranges end in a hash of the whole row, so a value that many rows share is spread over blocks.
    """
    if BLOCK in rows.columns:
        raise ValueError(f"a column is already named {BLOCK}")
    columns = tuple(columns)
    spark = rows.sparkSession
    near = rows.repartitionByRange(blocks, *[F.col(c).asc_nulls_last() for c in reversed(columns)], F.xxhash64(*rows.columns))
    stored = near.withColumn(BLOCK, F.spark_partition_id())
    stored.write.mode("overwrite").partitionBy(BLOCK).parquet(f"{path}/rows")
    stored = spark.read.schema(stored.schema).parquet(f"{path}/rows")
    # values first: a value that many rows share is cut into trigrams once for each block
    values = reduce(DataFrame.unionByName, [stored.select(BLOCK, F.col(c).alias("value")).distinct() for c in columns])
    grams = values.select(BLOCK, F.explode(trigrams(F.col("value"))).alias("gram")).distinct()
    grams.repartitionByRange("gram", BLOCK).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    return Postings(stored, spark.read.schema(grams.schema).parquet(f"{path}/grams"), columns)

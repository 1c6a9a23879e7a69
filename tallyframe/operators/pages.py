"""T4 for any page: an index of page boundaries, so that a page number becomes a keyset read.

Rows alike in all displayed columns are one key with a count. Keys are numbered in the order of the pages, and
the index has a row for every ``EVERY`` keys: the first of them, and how many rows lie before it. A
page reads only the keys between the boundaries around it, so its heap holds at most ``EVERY`` keys and the
page's end, whatever its number and however many rows share a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.explore import PAGE_SIZE, beyond
from tallyframe.operators.selection import row_numbers

EVERY = 10_000


@dataclass(frozen=True)
class PageIndex:
    """The boundaries of ``rows``, a stored table, by a number column ``order_by`` and then ``tie`` ascending, nulls last."""

    rows: DataFrame
    blocks: DataFrame                 # block, before, n, and the first key's columns
    order_by: str
    tie: tuple[str, ...]
    desc: bool = True

    @property
    def columns(self) -> list[str]:
        return [self.order_by, *self.tie]

    def page(self, page_no: int, page_size: int = PAGE_SIZE) -> DataFrame:
        """Rows page_no * page_size and on (page_no from 0); none beyond the end. Two index rows reach the driver."""
        start = page_no * page_size
        at = F.col("before")
        # the block that holds the page's first row, those that hold its others, and the one behind them
        near = (self.blocks.where((at + F.col("n") > start) & (at <= start + page_size))
                .agg(F.min("before").alias("before"), F.max("block").alias("last"), F.min("block").alias("first")).first())
        if near.before is None or near.before > start:
            return self._ordered(self.rows.select(*self.columns).limit(0))
        edges = {r.block: r for r in self.blocks.where(F.col("block").isin(near.first, near.last + 1)).collect()}
        keys = self.rows.select(*self.columns).where(self._from(edges[near.first], inclusive=True))
        first, low = F.col(self.order_by), edges[near.first][self.order_by]
        if low is not None:                 # plain bounds, which reach the scan
            keys = keys.where((first <= F.lit(low) if self.desc else first >= F.lit(low)) | first.isNull())
        if near.last + 1 in edges:
            high = edges[near.last + 1][self.order_by]
            keys = keys.where(~self._from(edges[near.last + 1], inclusive=True))
            if high is not None:
                keys = keys.where(first >= F.lit(high) if self.desc else first <= F.lit(high))
        skip = start - near.before
        copies = F.sequence(F.lit(1), F.least("c", F.lit(skip + page_size)).cast("int"))    # more of a key don't reach the page
        rows = keys.groupBy(*self.columns).agg(F.count(F.lit(1)).alias("c")).select(*self.columns, F.explode(copies).alias("_"))
        return self._ordered(rows.drop("_")).offset(skip).limit(page_size)

    def _from(self, key, inclusive: bool):
        return beyond(self.columns, [key[c] for c in self.columns], self.desc, inclusive)

    def _ordered(self, rows: DataFrame) -> DataFrame:
        first = F.col(self.order_by)
        return rows.orderBy(first.desc_nulls_last() if self.desc else first.asc_nulls_last(),
                            *[F.col(c).asc_nulls_last() for c in self.tie])


def build(rows: DataFrame, path: str, order_by: str, tie, desc: bool = True, every: int = EVERY) -> PageIndex:
    """Write the index of ``rows`` to ``path``: one row for every ``every`` keys.

    The counted keys are written first: numbering reads them three times, each time other columns of them, and
    would shuffle and combine all rows anew for each.
    """
    tie = tuple(tie)
    columns = [order_by, *tie]
    keys = rows.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_c"))
    keys.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/keys")
    keys = rows.sparkSession.read.schema(keys.schema).parquet(f"{path}/keys")
    numbered = row_numbers(keys, order_by, tie, "_g", ascending=not desc)
    block = F.expr(f"(_g - 1) div {every}")
    blocks = numbered.groupBy(block.alias("block")).agg(
        F.sum("_c").alias("n"), F.min(F.struct("_g", *columns)).alias("k"))
    blocks = blocks.withColumn("part", F.expr(f"block div {every}"))
    blocks.write.mode("overwrite").parquet(f"{path}/counts")
    blocks = rows.sparkSession.read.schema(blocks.schema).parquet(f"{path}/counts")
    # rows before a block: those of the parts before (a part is every * every keys) and of its part's blocks before
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("part", "n")).alias("a"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = (blocks.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
           .withColumn("_a", parts.scalar())
           .withColumn("before", F.expr("aggregate(filter(_a, e -> e.part < part), 0L, (s, e) -> s + e.n) + _in"))
           .select("block", "before", "n", *[F.col(f"k.{c}").alias(c) for c in columns]))
    out.write.mode("overwrite").parquet(f"{path}/blocks")
    return PageIndex(rows, rows.sparkSession.read.schema(out.schema).parquet(f"{path}/blocks"), order_by, tie, desc)

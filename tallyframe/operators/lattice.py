"""A lattice of roll-ups: sums of one table at several grains, and the choice of the smallest that answers a question.

A grain is a set of dimensions; its table has a row for each of their combinations with the number of rows
and the sums of the measures. ``build`` makes the finest grain in one pass over the detail, counts every
coarser one from it, and keeps those that are a good deal smaller than what they would be read from. A question
(grouping columns and filters) goes to the smallest kept grain that has all its columns; one that no
grain covers goes to the detail, with the same rows as its result.

The counts of all grains also tell which columns determine others: where the grain of a question's columns
has as many rows as the one that is read, the rows are the groups already and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT = "line_items"
SHARE = 0.5                  # a grain is kept if it has at most this share of the rows it would be read from
MAX_DIMENSIONS = 8           # 2^8 grains are counted

Dims = tuple[str, ...]


def grain_id(keys, dims: Dims) -> int:
    """The grouping id: a bit for each dimension that is summed over, the first dimension highest."""
    return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in keys)


def all_grains(dims: Dims) -> list[Dims]:
    return [c for n in range(len(dims), -1, -1) for c in combinations(dims, n)]


def choose(sizes: dict[Dims, int], dims: Dims, share: float = SHARE) -> list[Dims]:
    """The grains to keep: the finest, and each that is small beside the smallest kept one that covers it."""
    kept = [dims]
    for keys in all_grains(dims)[1:]:
        source = min(sizes[k] for k in kept if set(keys) <= set(k))
        if 0 < sizes[keys] <= share * source:
            kept.append(keys)
    return kept


def _sums(measures: dict[str, str]) -> list[Column]:
    return [F.sum(COUNT).alias(COUNT), *[F.sum(F.col(m).cast(kind)).cast(kind).alias(m) for m, kind in measures.items()]]


def _at(frame: DataFrame, grains: list[Dims], dims: Dims, measures: dict[str, str]) -> DataFrame:
    """``frame`` at several grains at once, with ``grain``, the grouping id."""
    return frame.groupingSets(grains, *dims).agg(*_sums(measures), F.grouping_id().alias("grain"))


def build(detail: DataFrame, root: str, dims: Dims, measures: dict[str, str], share: float = SHARE) -> Lattice:
    """Write the lattice of ``detail`` under ``root`` and open it.

    ``measures``: column to the type of its sums. Reads the detail once; the finest grain is bounded
    by combinations of dimensions, and all others are made from it in two passes (sizes, tables).
    """
    dims = tuple(dims)
    if len(dims) > MAX_DIMENSIONS:
        raise ValueError(f"{len(dims)} dimensions; at most {MAX_DIMENSIONS}")
    spark, root = detail.sparkSession, root.rstrip("/")
    base = detail.groupBy(*dims).agg(F.count(F.lit(1)).alias(COUNT), *_sums(measures)[1:])
    base.write.mode("overwrite").parquet(f"{root}/finest")
    base = spark.read.schema(base.schema).parquet(f"{root}/finest")
    counted = _at(base, all_grains(dims), dims, measures).groupBy("grain").agg(F.count(F.lit(1)).alias("rows"))
    by_id = {r["grain"]: r["rows"] for r in counted.collect()}                      # at most 2^8 rows
    sizes = {keys: by_id.get(grain_id(keys, dims), 0) for keys in all_grains(dims)}
    kept = choose(sizes, dims, share)
    if kept[1:]:
        _at(base, kept[1:], dims, measures).write.mode("overwrite").partitionBy("grain").parquet(f"{root}/grains")
    rows = [(list(keys), n, keys in kept) for keys, n in sizes.items()]
    (spark.createDataFrame(rows, "keys array<string>, rows long, kept boolean").coalesce(1)
     .write.mode("overwrite").parquet(f"{root}/sizes"))
    return Lattice(detail, root, dims, measures, sizes, kept)


def load(detail: DataFrame, root: str, dims: Dims, measures: dict[str, str]) -> Lattice:
    """Open a lattice that ``build`` wrote of this detail."""
    rows = detail.sparkSession.read.parquet(f"{root.rstrip('/')}/sizes").collect()           # at most 2^8 rows
    sizes = {tuple(r["keys"]): r["rows"] for r in rows}
    return Lattice(detail, root.rstrip("/"), tuple(dims), measures, sizes, [tuple(r["keys"]) for r in rows if r["kept"]])


@dataclass
class Lattice:
    detail: DataFrame
    root: str
    dims: Dims
    measures: dict[str, str]
    sizes: dict[Dims, int]
    kept: list[Dims]

    def __post_init__(self):
        self._open: dict[Dims, DataFrame] = {}

    def in_order(self, columns) -> Dims:
        return tuple(d for d in self.dims if d in set(columns))

    def route(self, columns) -> Dims | None:
        """The kept grain with the fewest rows that has all the columns; None: only the detail has them."""
        covering = [k for k in self.kept if set(columns) <= set(k)]
        return min(covering, key=lambda k: (self.sizes[k], len(k), k)) if covering else None

    def grain(self, keys: Dims) -> DataFrame:
        """The table of a kept grain, held for later questions."""
        if keys not in self._open:
            types = {f.name: f for f in self.detail.schema.fields}
            schema = ", ".join([*[f"`{d}` {types[d].dataType.simpleString()}" for d in self.dims], f"{COUNT} bigint",
                                *[f"`{m}` {t}" for m, t in self.measures.items()]])
            path = f"{self.root}/finest" if keys == self.dims else f"{self.root}/grains/grain={grain_id(keys, self.dims)}"
            self._open[keys] = self.detail.sparkSession.read.schema(schema).parquet(path)
        return self._open[keys]

    def totals(self, group=(), filters: dict | None = None, where: Column | None = None, where_columns=()) -> DataFrame:
        """``group``, the number of rows and the sums, of the rows that pass the filters.

        ``filters``: column to the value it must equal; ``where``: a further condition on ``where_columns``.
        """
        group, filters = list(group), dict(filters or {})
        conditions = [F.col(c) == F.lit(v) for c, v in filters.items()] + ([where] if where is not None else [])
        keys = self.route({*group, *filters, *where_columns})
        rows = self.grain(keys) if keys is not None else self.detail.withColumn(COUNT, F.lit(1).cast("bigint"))
        if conditions:
            rows = rows.where(reduce(Column.__and__, conditions))
        if keys is not None and group and self.sizes[self.in_order({*group, *filters})] == self.sizes[keys]:
            return rows.select(*group, COUNT, *self.measures)
        return rows.groupBy(*group).agg(*_sums(self.measures))

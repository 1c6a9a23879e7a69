"""Exact order statistics and row numbers without a sort of all rows, a checkpoint or a job while a plan is built.

Both start from the bounds of a quantile sketch and then count exactly. Bounds are compared as doubles, which keep
the order of any number; rows that share a double share a range. What one part of a plan hands to the next is one
scalar subquery, so bounds and counts come from one evaluation and a retried task sees the same ones.

Expressions are SQL text where they are long: a plan of a hundred ``Column`` calls takes longer to build than
a roll-up takes to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 100_000                 # ranks of the sketch are off by at most rows / ACCURACY
WHOLE = 100_000                    # up to so many rows no range is left out
MARGIN = 4 / ACCURACY              # sure beyond WHOLE rows: 3 * rows / ACCURACY > 2 ranks of rounding
_NULLS = 2 ** 31 - 1               # the last slot


def order_statistics(df: DataFrame, value: str, qs) -> DataFrame:
    """One row: ``n`` rows and ``b``, the values at the 0-based indexes floor(q * (n - 1)), nulls last.

    Selection by narrowing: a sketch gives for each q a range of values that is sure to hold its index.
    Values inside these ranges are counted one by one, those between two ranges as one number, and the
    sorted counts are added up to the wanted indexes. At most 10 * len(qs) / ACCURACY of the rows'
    values, or ``WHOLE``, are in the one array; equal values are one entry.
    """
    low = ", ".join(f"{max(0.0, q - MARGIN)!r}D" for q in qs)
    high = ", ".join(f"{min(1.0, q + MARGIN)!r}D" for q in qs)
    kind = df.schema[value].dataType.simpleString()
    start = ", ".join(f"CAST(NULL AS {kind}) AS b{j}" for j in range(len(qs)))
    step = ", ".join(
        f"""CASE WHEN floor({float(q)!r}D * (n - 1)) >= acc.before AND floor({float(q)!r}D * (n - 1)) < acc.before + e.c
            THEN if(e.v IS NULL AND e.slot <> {_NULLS}, raise_error('an index lies outside the range of its sketch'), e.v)
            ELSE acc.b{j} END AS b{j}""" for j, q in enumerate(qs))
    return df.sparkSession.sql(f"""
      WITH rows AS (SELECT `{value}` AS v, CAST(`{value}` AS DOUBLE) AS x FROM {{df}}),
      bounds AS (SELECT CASE WHEN count(1) > {WHOLE} THEN struct(percentile_approx(x, array({low}), {ACCURACY}) AS lo,
                                                                 percentile_approx(x, array({high}), {ACCURACY}) AS hi) END FROM rows),
      slots AS (SELECT v, x, (SELECT * FROM bounds) AS s FROM rows),
      counted AS (SELECT slot, v, count(1) AS c FROM (
        SELECT CASE WHEN x IS NULL THEN {_NULLS} WHEN s IS NULL THEN 0
                    ELSE size(filter(s.lo, b -> b < x)) + size(filter(s.hi, b -> b < x)) END AS slot,
               CASE WHEN s IS NULL OR size(filter(s.lo, b -> b <= x)) > size(filter(s.hi, b -> b < x)) THEN v END AS v
        FROM slots) GROUP BY slot, v),
      listed AS (SELECT coalesce(sum(c), 0L) AS n, sort_array(collect_list(struct(slot, v, c))) AS a FROM counted),
      picked AS (SELECT n, aggregate(a, struct(0L AS before, {start}),
                                     (acc, e) -> struct(acc.before + e.c AS before, {step})) AS p FROM listed)
      SELECT n, array({", ".join(f"p.b{j}" for j in range(len(qs)))}) AS b FROM picked""", df=df)


def row_numbers(df: DataFrame, value: str, tie=(), out: str = "rank", ascending: bool = False) -> DataFrame:
    """``out``: the 1-based place of each row by ``value`` (descending, nulls last), then ``tie`` ascending.

    Rows are counted by ranges of the order, and a range's last row becomes its bound, so the rows can be
    dealt by the counted ranges themselves: one shuffle puts range k into partition k, where a place is the
    position in it plus the rows of the ranges before. A value that many rows share is split over several
    ranges by its ties. Rows equal in value and ties get distinct numbers in no defined order.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = F.col(value).cast("double")
    first = _prefix_number(df, tie[0]) if tie else F.lit(0.0)
    named = ", ".join(f"t{i} IS NULL AS n{i}, t{i}" for i in range(len(tie)))
    keyed = df.select("*", (x if ascending else -x).alias("_x"), first.alias("_t"),
                      F.struct(x.isNull().alias("no"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)]).alias("_k"))
    fields = ", ".join(f"_k.t{i} IS NULL AS n{i}, _k.t{i} AS t{i}" for i in range(len(tie)))
    keyed = keyed.withColumn("_k", F.expr(f"struct(_k.no AS no, _x AS x{', ' + fields if named else ''})"))
    steps = [k / (parts - 1) for k in range(1, parts - 1)] or [0.5]
    points = f"array({', '.join(f'{p}D' for p in steps)})"
    bounds = keyed.agg(F.expr(f"struct(percentile_approx(_x, {points}) AS x, percentile_approx(_t, {points}) AS t)"))
    # bounds that are a row's very value: that many ranges share the value's rows, by their ties
    counted = (keyed.select("_x", "_t", "_k").withColumn("s", bounds.scalar()).selectExpr("_k", f"""
        CASE WHEN _x IS NULL OR s.x IS NULL THEN {parts - 1} ELSE size(filter(s.x, b -> b < _x))
             + CASE WHEN size(filter(s.x, b -> b = _x)) > 1 THEN
               size(filter(s.t, b -> b < _t)) * size(filter(s.x, b -> b = _x)) div {len(steps) + 1} ELSE 0 END END AS r""")
        .groupBy("r").agg(F.count(F.lit(1)).alias("c"), F.max("_k").alias("last"))
        .agg(F.expr("sort_array(collect_list(struct(r, c, last))) AS a")))                  # at most ``parts`` entries
    ranges = counted.selectExpr("""struct(transform(a, e -> e.last) AS last, aggregate(a, array(0L),
        (acc, e) -> concat(acc, array(element_at(acc, -1) + e.c))) AS before)""")
    dealt = (keyed.drop("_x", "_t").withColumn("_s", ranges.scalar())
             .withColumn("_p", F.expr("size(filter(_s.last, b -> b < _k))")).withColumn("_b", F.expr("_s.before[_p]")).drop("_s"))
    dealt = dealt.repartitionById(parts, F.col("_p")).sortWithinPartitions("_k")
    place = F.expr("_b + monotonically_increasing_id() - shiftleft(CAST(spark_partition_id() AS BIGINT), 33) + 1")
    return dealt.select(*df.columns, place.alias(out))


def _prefix_number(df: DataFrame, column: str) -> Column:
    """A double that grows with the column: a number itself, of other values the first 6 bytes of their text."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return F.col(column).cast("double")
    head = F.rpad(F.substring(F.hex(F.encode(F.col(column).cast("string"), "utf-8")), 1, 12), 12, "0")
    return F.conv(head, 16, 10).cast("double")

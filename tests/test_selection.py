"""Order statistics and row numbers by counted ranges, against sorting."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import concentration, selection

QS = (0.2, 0.4, 0.6, 0.8)


def frames(spark):
    third = "CASE WHEN id % 3 = 0 THEN 7 ELSE pmod(xxhash64(id), 100003) - 50000 END"
    return {
        "hot value, many rows": spark.range(0, 250_000, 1, 6).selectExpr("id AS k", f"CAST({third} AS decimal(38,0)) AS v"),
        "all equal, many rows": spark.range(0, 120_000, 1, 4).selectExpr("id AS k", "5L AS v"),
        "beyond 2^53": spark.range(0, 120_000, 1, 4).selectExpr("id AS k", "9007199254740992L + id % 7 AS v"),
        "mostly null": spark.range(0, 110_000, 1, 4).selectExpr("id AS k", "CASE WHEN id % 10 = 0 THEN id END AS v"),
        "few": spark.range(0, 7, 1, 3).selectExpr("id AS k", "id * id % 5 AS v"),
        "one": spark.range(1).selectExpr("id AS k", "3.5D AS v"),
        "none": spark.range(0).selectExpr("id AS k", "id AS v"),
        "only nulls": spark.range(9).selectExpr("id AS k", "CAST(NULL AS double) AS v"),
    }


NAMES = ["hot value, many rows", "all equal, many rows", "beyond 2^53", "mostly null", "few", "one", "none", "only nulls"]


@pytest.mark.parametrize("name", NAMES)
def test_order_statistics_equal_sorting(spark, name):
    df = frames(spark)[name]
    values = sorted((r.v for r in df.collect()), key=lambda v: (v is None, v or 0))
    want = [values[math.floor(q * (len(values) - 1))] if values else None for q in QS]
    row = selection.order_statistics(df, "v", QS).first()
    assert (row.n, row.b) == (len(values), want)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("ascending", [False, True])
def test_row_numbers_equal_sorting(spark, name, ascending):
    df = frames(spark)[name]
    rows = selection.row_numbers(df, "v", ("k",), "place", ascending).collect()
    sign = 1 if ascending else -1
    rows.sort(key=lambda r: (r.v is None, sign * float(r.v or 0), r.k))
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))


def test_a_shared_value_is_spread_over_partitions(spark):
    df = spark.range(0, 30_000, 1, 4).selectExpr("concat(char(97 + id % 26), id) AS k", "CASE WHEN id % 3 > 0 THEN 1 ELSE id END AS v")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        out = selection.row_numbers(df, "v", ("k",)).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
        rows = sorted(out.collect(), key=lambda r: (-r.v, r.k))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r["rank"] for r in rows] == list(range(1, 30_001))
    assert max(sizes) < 6_000                # two thirds of the rows share a value


@pytest.mark.parametrize("build", [
    lambda df: concentration.rank_by(df, "v", ("k",)),
    lambda df: concentration.quantile_bins(df, "k", "v", "3"),
    lambda df: concentration.bin_legend(df, "k", "v", "3"),
])
def test_no_job_and_no_checkpoint_while_built(spark, build):
    df = spark.range(40).selectExpr("cast(id as string) k", "cast(id * id % 97 as decimal(38,0)) v")
    sc = spark.sparkContext
    sc.setJobGroup("ranks built", "plans only")
    try:
        out = build(df)
        assert list(sc.statusTracker().getJobIdsForGroup("ranks built")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() >= 1

"""Plan properties that must hold at scale (checked on the physical plans)."""

import contextlib
import io

import pytest

from tallyframe.operators import clean, concentration, explore
from tallyframe.plans import ledger
from tallyframe.plans.catalog import spark_callables
from tallyframe.sources.parquet import DETAIL_PARTITIONS, write_parquet
from tallyframe.sources.tables import Tables
from tests.conftest import SF001

QUERIES = spark_callables()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_nested_loop_or_window(spark, name):
    p = plan(QUERIES[name](spark, SF001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window ("):
        assert bad not in p, f"{name}: {bad}"


def test_category_page_prunes_partitions_and_columns(spark, tmp_path):
    t = Tables(spark, SF001)
    path = write_parquet(clean.ingest(ledger.raw_ledger(t)), str(tmp_path / "detail"), partition_by=DETAIL_PARTITIONS)
    p = plan(explore.page(spark.read.parquet(path), "amount_php", True, 1, filters={"expense_category": "PS"},
                          text="ring"))
    assert "PartitionFilters: [isnotnull(expense_category" in p and "= PS)" in p
    read = [line for line in p.splitlines() if line.startswith("ReadSchema")][0]
    assert "sort_order" not in read and "fund_code" not in read
    assert "TakeOrderedAndProject" in p


@pytest.mark.parametrize("name, most", [("d4_ingest_removed", 1), ("d4_workshop_removed", 1), ("s11_stage_counts", 1)])
def test_counts_read_the_line_items_once(spark, name, most):
    assert plan(QUERIES[name](spark, SF001)).count("lineitem.parquet") <= most


@pytest.mark.parametrize("build", [
    lambda df: concentration.tiers(df, "k", "v"),
    lambda df: concentration.tier_summary(concentration.tiers(df, "k", "v")),
    lambda df: concentration.gini(df, "v", "k"),
])
def test_tiers_and_gini_run_no_job_while_built(spark, build):
    df = spark.range(40).selectExpr("cast(id as string) k", "cast(id * id % 97 as decimal(38,0)) v")
    sc = spark.sparkContext
    sc.setJobGroup("built", "plans only")
    try:
        out = build(df)
        assert list(sc.statusTracker().getJobIdsForGroup("built")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() >= 1

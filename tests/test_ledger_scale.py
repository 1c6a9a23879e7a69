"""The ledger's dedups deal rows before they are combined, and give the rows of the plain ones."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import clean, gates
from tallyframe.plans.context import Ledger
from tallyframe.sources.tables import Tables
from tests.conftest import SF001


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def raw_rows(spark):
    """2,000 raw rows: each twice, a third null or blank amounts, a denied department, null texts."""
    texts = {src: F.concat(F.lit(f" {src} "), (F.col("id") % 300).cast("string")) for src, _ in clean.RAW_TO_DETAIL}
    texts |= {"SORDER": (F.col("id") % 700).cast("string"), "PREXC_LEVEL": F.lit("3"),
              "AMT": F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.lit("N/A")).otherwise(F.lit("12")),
              "UACS_AGY_DSC": F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit("A")),
              "UACS_DPT_DSC": F.when(F.col("id") % 11 == 0, F.lit(clean.DENIED_DEPARTMENTS[0])).otherwise(F.lit("D"))}
    rows = spark.range(1000).select(*[c.cast("string").alias(n) for n, c in texts.items()])
    return rows.unionAll(rows)


def test_rows_are_dealt_before_the_distinct(spark):
    got = clean.ingest(raw_rows(spark))
    p = plan(got)
    assert p.count("Exchange\n") == 1 and "REPARTITION_BY_COL" in p, p     # nothing is combined before the one shuffle
    want = clean.enrich(clean.project(clean.admit(raw_rows(spark))).distinct())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_groups_give_detail_and_counts(spark):
    raw = raw_rows(spark)
    groups = clean.ingest_groups(raw)
    assert sorted(map(str, clean.detail_of(groups).collect())) == sorted(map(str, clean.ingest(raw).collect()))
    counts = clean.counts_of(groups).first()
    assert counts.raw == 2000 and counts.final == clean.ingest(raw).count()
    assert counts.castable == raw.where(clean.castable(F.col("AMT"))).count()
    assert groups.where(~F.col("_admitted")).count() > 100                 # not two groups in one task


def test_counts_of_no_rows(spark):
    assert clean.ingest_counts(raw_rows(spark).limit(0)).first().asDict() == {"raw": 0, "castable": 0, "final": 0}


def test_queries_that_read_the_detail_twice_store_it(spark):
    led = Ledger(spark, SF001)
    assert "lineitem.parquet" not in plan(led.stored) and "lineitem.parquet" not in plan(led.page_rows)
    assert sorted(map(str, led.stored.collect())) == sorted(map(str, led.detail.collect()))
    assert led.agg["agg_expense"].agg(F.sum("line_items")).first()[0] == led.detail.count()


@pytest.mark.parametrize("rows, dealt_to", [(1_000_000, None), (5_000_000, 10)])
def test_keyed_dedup_is_dealt_by_rows(spark, rows, dealt_to):
    staged = clean.stage(Ledger(spark, SF001).wraw)
    dealt = clean.dealt(staged, rows)
    assert dealt_to is None and dealt is staged or dealt.rdd.getNumPartitions() == dealt_to
    assert sorted(map(str, clean.dedup_keyed(dealt).collect())) == sorted(map(str, clean.dedup_keyed(staged).collect()))


def test_few_shared_fingerprints_go_to_the_rows(spark, monkeypatch):
    df = Tables(spark, SF001)["part"]
    some = df.unionAll(df.limit(7)).unionAll(df.limit(7))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _both_joins(some, monkeypatch)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _both_joins(some, monkeypatch):
    for most, join in ((gates.BROADCAST_ROWS, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(gates, "BROADCAST_ROWS", most)
        found = gates.duplicate_rows(some)
        assert found.first().duplicates == some.count() - some.distinct().count() >= 7
        assert join in plan(found)

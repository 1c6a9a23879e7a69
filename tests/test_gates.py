"""Mutation tests: each injected fault fails the gate it targets."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import gates
from tallyframe.operators.rollup import rollups
from tallyframe.plans.context import Ledger
from tests.conftest import SF001


@pytest.fixture(scope="module")
def base(spark):
    c = Ledger(spark, SF001)
    # the dirty ledger keeps NULL agency names (V1 reports them); start from passing rows
    detail = c.detail.where(F.col("agency_name").isNotNull()).cache()
    agg = {k: v.cache() for k, v in rollups(detail).items()}
    one = detail.agg(F.sum("amount_php").alias("t")).first().t
    bounds = {"total": (one, one), "departments": (agg["agg_department"].count(),) * 2,
              "regions": (agg["agg_region"].count(),) * 2}
    return detail, agg, bounds


def failed(detail, agg, bounds):
    return {(r.gate, r.check) for r in gates.all_gates(detail, agg, bounds).collect() if not r.passed}


def first_row_changed(detail, **changes):
    """Replace one row (the smallest sort_order) with a modified copy."""
    key = detail.agg(F.min("sort_order")).first()[0]
    one = detail.where(F.col("sort_order") == key).limit(1)
    rest = detail.subtract(one)
    for c, v in changes.items():
        one = one.withColumn(c, v)
    return rest.unionByName(one)


def test_clean_ledger_passes_all_26(base):
    detail, agg, bounds = base
    rows = gates.all_gates(detail, agg, bounds).collect()
    assert len(rows) == 21 and all(r.passed for r in rows)   # + 5 file checks = 26


def test_null_core_column_fails_v1(base):
    detail, agg, bounds = base
    bad = first_row_changed(detail, agency_name=F.lit(None).cast("string"))
    assert failed(bad, agg, bounds) == {("V1", "agency_name: null rows")}


def test_zero_amount_fails_v2(base):
    detail, agg, bounds = base
    bad = first_row_changed(detail, amount_php=F.lit(0).cast("bigint"))
    got = failed(bad, agg, bounds)
    assert ("V2", "amounts at or below zero") in got and {g for g, _ in got} <= {"V2", "V4", "V5"}


def test_category_outside_domain_fails_v2(base):
    detail, agg, bounds = base
    bad = first_row_changed(detail, expense_category=F.lit("XX"))
    assert failed(bad, agg, bounds) == {("V2", "unknown expense categories")}


def test_other_category_fails_v6_only(base):
    detail, _, bounds = base
    bad = first_row_changed(detail, expense_category=F.lit("Other"))
    assert failed(bad, rollups(bad), bounds) == {("V6", "departments whose classes miss the total")}


def test_duplicate_fails_v3_and_v4(base):
    detail, agg, bounds = base
    bad = detail.unionByName(detail.limit(1))
    got = {g for g, _ in failed(bad, agg, bounds)}
    assert "V3" in got and "V4" in got


def test_rollup_off_by_one_fails_v4(base):
    detail, agg, bounds = base
    k = agg["agg_region"].agg(F.min("region_id")).first()[0]
    off = agg["agg_region"].withColumn(
        "total_php", F.when(F.col("region_id") == k, F.col("total_php") + 1).otherwise(F.col("total_php")))
    assert failed(detail, {**agg, "agg_region": off}, bounds) == {("V4", "agg_region: total against detail")}


def test_region_too_few_fails_v5(base):
    detail, agg, bounds = base
    k = agg["agg_region"].agg(F.min("region_id")).first()[0]
    fewer = agg["agg_region"].where(F.col("region_id") != k)
    assert ("V5", "number of regions within anchors") in failed(detail, {**agg, "agg_region": fewer}, bounds)


def test_enforce_raises(base):
    detail, agg, bounds = base
    bad = first_row_changed(detail, expense_category=F.lit("XX"))
    with pytest.raises(gates.GateFailure, match="V2"):
        gates.enforce(gates.all_gates(bad, agg, bounds))
    gates.enforce(gates.all_gates(detail, agg, bounds))


def test_files_gate(spark, base, tmp_path):
    detail, agg, _ = base
    p = str(tmp_path / "d.parquet")
    detail.limit(5).write.parquet(p)
    rows = gates.files_readable(spark, {"budget_detail": p, "missing": str(tmp_path / "nope")}).collect()
    assert [r.passed for r in rows] == [True, False]


def test_checked_export_cleans_once_and_stops_before_the_export(spark, tmp_path):
    from tallyframe.operators import clean
    schema = "id string, department string, agency string, amount string, category string, region string"
    raw = spark.createDataFrame([("1", "a", "x", "5", "MOOE", "N"), ("2", "a", "x", "5", "MOOE", "N"), ("3", "b", None, "1,000", None, "")], schema)
    runs = []

    def counted(df):
        runs.append(1)
        return clean.clean_workshop(df)

    staged = gates.checked_export(raw, counted, str(tmp_path / "staged"))
    assert len(runs) == 1 and sorted(r.id for r in staged.collect()) == [1, 3]
    row = gates.round_trip(staged, str(tmp_path / "out")).first()
    assert (row.rows, row.rows_before, row.matches) == (2, 2, True) and row.total == row.total_before == 1005
    with pytest.raises(gates.GateFailure, match="row count"):
        gates.checked_export(raw.limit(0), clean.clean_workshop, str(tmp_path / "none"))
    empty = gates.round_trip(staged.limit(0), str(tmp_path / "empty")).first()
    assert (empty.rows, empty.total, empty.matches) == (0, None, True)


def test_a_report_of_one_pass_equals_its_parts(spark):
    from tallyframe.operators import profile
    from tallyframe.plans.context import Ledger
    raw = Ledger(spark, SF001).wraw
    got = profile.report(raw)
    want = {"row_count": profile.row_count(raw), "missingness": profile.missingness(raw), "duplicates": profile.duplicate_count(raw),
            "whitespace": profile.whitespace(raw), "categories": profile.distinct_values(raw, "category"), "non_numeric": profile.non_numeric(raw)}
    for name, df in want.items():
        assert got[name].columns == df.columns and sorted(map(tuple, got[name].collect())) == sorted(map(tuple, df.collect())), name

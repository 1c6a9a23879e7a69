"""Invariants of the analytics operators, checked against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.operators import concentration, measure
from tallyframe.plans.context import Ledger
from tests.conftest import SF001


@pytest.fixture(scope="module")
def led(spark):
    return Ledger(spark, SF001)


def test_shares_sum_to_100(led):
    s = concentration.share_of_total(led.agg_expense, "total_php", digits=6)
    assert abs(sum(r.pct for r in s.collect()) - 100) < 1e-3


def test_rolled_total_equals_detail(led):
    d = led.detail.agg(F.sum("amount_php")).first()[0]
    for name, agg in led.agg.items():
        assert agg.agg(F.sum("total_php")).first()[0] == d, name


def test_gini_equals_pair_form(led):
    xs = [float(r.total_php) for r in led.agg_department.collect()]
    n, mean = len(xs), sum(xs) / len(xs)
    pair = sum(abs(a - b) for a in xs for b in xs) / (2 * n * n * mean)
    g = concentration.gini(led.agg_department, "total_php", "department_short").first()
    assert g.n == n and abs(g.gini - pair) < 1e-6


def test_bins_cover_all_rows_and_follow_index_rule(led):
    totals = led.agg_agency.groupBy("agency_code").agg(F.sum("total_php").alias("total_php"))
    rows = {r.agency_code: float(r.total_php) for r in totals.collect()}
    outlier = sorted(rows)[0]
    bins = {r.agency_code: r.bin for r in
            concentration.quantile_bins(totals, "agency_code", "total_php", outlier).collect()}
    assert set(bins) == set(rows)
    rest = sorted((v, k) for k, v in rows.items() if k != outlier)
    import math
    brk = [rest[math.floor(q * (len(rest) - 1))][0] for q in (0.2, 0.4, 0.6, 0.8)]
    for k, v in rows.items():
        want = 5 if v >= rows[outlier] * 0.9 else sum(v >= b for b in brk)
        assert bins[k] == want, k


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=50), min_size=1, max_size=300))
def test_global_row_number_matches_sort(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v long")
    got = concentration.rank_by(df, "v", tie=("k",)).collect()
    want = sorted(range(len(values)), key=lambda i: (-values[i], i))
    assert sorted((r.rank, r.k) for r in got) == [(p + 1, k) for p, k in enumerate(want)]


def test_tiers_partition_the_ranking(led):
    t = concentration.tiers(led.agg_department, "department_short", "total_php").collect()
    n = led.agg_department.count()
    assert sum(r.members for r in t) == n
    assert abs(sum(r.pct for r in t) - 100) < 0.5
    first = [r for r in t if r.tier == 1][0]
    assert first.names.count(",") == min(first.members, 5) - 1


def test_leader_gap(led):
    g = concentration.leader_gap(led.agg_region, "region_id", "total_php").first()
    tot = sorted((float(r.total_php) for r in led.agg_region.collect()), reverse=True)
    assert float(g.leader_total) == tot[0] and float(g.runner_up_total) == tot[1]
    assert g.tied == (abs(tot[0] - tot[1]) / tot[0] < 0.001)


def test_leader_gap_single_row(spark):
    from decimal import Decimal
    df = spark.createDataFrame([("13", Decimal(5))], "region_id string, total_php decimal(38,0)")
    g = concentration.leader_gap(df, "region_id", "total_php").first()
    assert g.leader == "13" and g.runner_up is None and g.ratio is None and g.tied is False
    assert g.leader_pct == 100.0


def test_bins_with_only_the_outlier(spark):
    from decimal import Decimal
    df = spark.createDataFrame([("13", Decimal(5))], "region_id string, total_php decimal(38,0)")
    assert [r.bin for r in concentration.quantile_bins(df, "region_id", "total_php", "13").collect()] == [0]


def test_rollups_from_base_equal_direct(led):
    from tallyframe.operators import rollup
    direct = {"agg_department": rollup.department_rollup, "agg_expense": rollup.expense_rollup,
              "agg_agency": rollup.agency_rollup, "agg_region": rollup.region_rollup}
    via_base = rollup.rollups(led.detail)
    for name, fn in direct.items():
        a, b = fn(led.detail), via_base[name].select(*fn(led.detail).columns)
        assert a.dtypes == b.dtypes, name   # nullability may differ (a sum of counts is nullable)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_duplicate_rows_exact(spark):
    from tallyframe.operators import gates
    rows = [(1, "a", None), (1, "a", None), (1, "a", None), (2, None, "x"), (2, None, "x"), (3, "b", "y")]
    df = spark.createDataFrame(rows, "k long, s string, t string")
    assert gates.duplicate_rows(df).first().duplicates == df.count() - df.distinct().count() == 3
    assert gates.duplicate_rows(df.distinct()).first().duplicates == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "hot"]), st.integers(0, 30)), min_size=1, max_size=400))
def test_exact_median_matches_brute_force(spark, pairs):
    pairs = pairs + [("hot", v % 7) for v in range(300)]          # one group holds most rows
    df = spark.createDataFrame([(g, float(v)) for g, v in pairs], "g string, v double").repartition(5)
    got = {r.g: (r.runs, r.median_value) for r in measure.exact_median(df, "g", "v").collect()}
    want = {}
    for g in {p[0] for p in pairs}:
        xs = sorted(float(v) for k, v in pairs if k == g)
        m = len(xs) // 2
        want[g] = (len(xs), xs[m] if len(xs) % 2 else (xs[m - 1] + xs[m]) / 2)
    assert got == want


def test_exact_median_group_across_all_partitions(spark):
    import random
    rnd = random.Random(7)
    rows = [("hot", float(rnd.randint(0, 5000))) for _ in range(4000)]
    rows += [("a", 1.0), ("a", 3.0), (None, 2.0), (None, 4.0), ("z", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.runs, r.median_value) for r in measure.exact_median(df, "g", "v").collect()}
    def med(xs):
        xs = sorted(xs); m = len(xs) // 2
        return (len(xs), xs[m] if len(xs) % 2 else (xs[m - 1] + xs[m]) / 2)
    want = {}
    for k in {r[0] for r in rows}:
        want[k] = med([v for g, v in rows if g == k])
    assert got == want


def test_ties_at_topk_page_and_tier_cuts(spark):
    from decimal import Decimal
    from tallyframe.operators import explore
    # twenty groups, totals tie in pairs: the cut at 3, 5, 15 and page 2 all split ties
    rows = [(f"D{i:02d}", Decimal(100 - i // 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "department_short string, total_php decimal(38,0)")
    top3 = [r.department_short for r in explore.top_k(df, "total_php", 3, tie=("department_short",)).collect()]
    assert top3 == ["D00", "D01", "D02"]
    again = [r.department_short for r in explore.top_k(df.repartition(7), "total_php", 3,
                                                      tie=("department_short",)).collect()]
    assert again == top3
    ranked = concentration.rank_by(df.repartition(5), "total_php", tie=("department_short",)).collect()
    assert sorted((r["rank"], r.department_short) for r in ranked) == [(i + 1, f"D{i:02d}") for i in range(20)]
    t = {r.tier: r for r in concentration.tiers(df, "department_short", "total_php").collect()}
    assert t[1].names == "D00, D01, D02, D03, D04" and t[2].members == 10 and t[3].members == 5
    det = spark.createDataFrame([(f"A{i}", "x", "p", "PS", "o", 5 if i % 2 else 7) for i in range(120)],
                                "department_short string, agency_name string, program_description string, "
                                "expense_category string, object_description string, amount_php long")
    p1 = [r.department_short for r in explore.page(det, "amount_php", True, 1, page_size=50).collect()]
    p1b = [r.department_short for r in explore.page(det.repartition(9), "amount_php", True, 1, page_size=50).collect()]
    assert p1 == p1b and len(p1) == 50


def test_tiers_of_few_rows_and_missing_values(spark):
    schema = "k string, v long"
    few = concentration.tiers(spark.createDataFrame([("b", 4), ("a", 4), (None, 2)], schema), "k", "v").collect()
    assert [(r.tier, r.members, int(r.total), r.names) for r in few] == [(1, 3, 10, "a, b")]
    rows = [(f"k{i:02d}", 100 - i) for i in range(18)] + [("x", None), (None, None)]
    many = concentration.tiers(spark.createDataFrame(rows, schema), "k", "v").orderBy("tier").collect()
    assert [(r.members, int(r.total)) for r in many] == [(5, 490), (10, 905), (5, 252)]
    assert many[1].names == "k05, k06, k07, k08, k09 +5 more" and many[2].names == "k15, k16, k17, x"
    assert concentration.tiers(spark.createDataFrame([], schema), "k", "v").count() == 0


def test_a_null_key_counts_among_the_rows_of_the_breaks(spark):
    rows = [(None, 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5), ("out", 100)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: r.bin for r in concentration.quantile_bins(df, "k", "v", "out").collect()}
    # breaks of 1..5 at indexes 0, 1, 2, 3
    assert got == {None: 1, "a": 2, "b": 3, "c": 4, "d": 4, "out": 5}


def test_exact_median_of_a_group_over_many_partitions(spark):
    rows = [("hot", float(v % 1009)) for v in range(20011)] + [(None, 3.0), (None, 8.0), ("one", 2.5), ("none", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: (r.runs, r.median_value) for r in
               measure.exact_median(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = sorted(v % 1009 for v in range(20011))
    assert got == {"hot": (20011, float(hot[10005])), None: (2, 5.5), "one": (1, 2.5)}

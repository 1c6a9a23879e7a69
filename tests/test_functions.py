"""Edge cases of the scalar functions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.categories import expense_category, standard_category
from tallyframe.functions.format import DASHBOARD_DECIMALS, WORKSHOP_DECIMALS, abbrev, thousands
from tallyframe.functions.money import parse_money, pct, strict_cast, tolerant_bigint
from tallyframe.functions.text import short_name, truncate_label
from tallyframe.operators import explore


def one(spark, col, values, type_="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {type_}")
    return [r[0] for r in df.select(col(F.col("v"))).collect()]


def test_tolerant_bigint(spark):
    vals = ["1.5", "2.5", "-2.5", "1.495", "1e3", " 12 ", "", "N/A", "-5", "1,000", None]
    assert one(spark, tolerant_bigint, vals) == [2, 3, -3, 1, 1000, 12, None, None, -5, None, None]


def test_parse_money(spark):
    vals = ["1,250,000", "2,400,000.50", "", "N/A", None, " 12 "]
    assert one(spark, parse_money, vals) == [Decimal("1250000.00"), Decimal("2400000.50"), Decimal("0.00"),
                                             Decimal("0.00"), Decimal("0.00"), Decimal("12.00")]


def test_strict_cast_aborts(spark):
    assert one(spark, lambda c: strict_cast(c, "int"), ["7", None]) == [7, None]
    with pytest.raises(Exception, match="malformed"):
        one(spark, lambda c: strict_cast(c, "int"), ["x7"])


def test_short_name(spark):
    vals = ["Department of Education (DepEd)", "No parens", "Open ( only", "Close) before (X)",
            ") then (", "Empty ()", None]
    assert one(spark, short_name, vals) == ["DepEd", "No parens", "Open ( only", "X", ") then (", "", None]


def test_categories(spark):
    assert one(spark, expense_category, ["Personnel Services", "Capital Outlays", "Financial Expenses",
                                          "Maintenance and Other Operating Expenses", "x", None]) == [
        "PS", "CO", "FE", "MOOE", "Other", "Other"]
    assert one(spark, standard_category, ["personnel services", " mooe ", "CAPITAL x", "Other ", "", None]) == [
        "Personnel Services", "MOOE", "Capital Outlays", "Other", "Uncategorized", "Uncategorized"]


def test_labels(spark):
    vals = [4.08e12, 2.56e12, 156759122.5, 320000.0, 999.0, 89109122.0, 1.5e9]
    assert one(spark, lambda c: abbrev(c, WORKSHOP_DECIMALS), vals, "double") == [
        "₱4.08T", "₱2.56T", "₱156.8M", "₱320K", "₱999", "₱89.1M", "₱1.50B"]
    assert one(spark, lambda c: abbrev(c, DASHBOARD_DECIMALS), vals, "double") == [
        "₱4.08T", "₱2.56T", "₱157M", "₱320,000", "₱999", "₱89M", "₱1.5B"]
    assert one(spark, thousands, [1234567.0, 12.5, 999.5, 0.0004, -1234.5678], "double") == [
        "1,234,567", "12.5", "999.5", "0", "-1,234.568"]
    assert one(spark, lambda c: truncate_label(c, 40, 38), ["x" * 41, "y" * 40]) == ["x" * 38 + "…", "y" * 40]


def test_pct_rounding_is_half_up_on_decimal(spark):
    df = spark.createDataFrame([(1005, 100000), (1, 0)], "a long, b long")
    assert [r[0] for r in df.select(pct("a", "b", 2)).collect()] == [1.01, None]


def test_search_literal_and_wildcards(spark):
    df = spark.createDataFrame([("100% cotton",), ("a_b",), ("axb",), ("it's",), ("back\\slash",)], "t string")
    lit = lambda s: [r.t for r in explore.search(df, s, ["t"]).collect()]
    assert lit("%") == ["100% cotton"]
    assert lit("_") == ["a_b"]
    assert lit("'") == ["it's"]
    assert lit("\\") == ["back\\slash"]
    wild = [r.t for r in explore.search(df, "a_b", ["t"], wildcards=True).collect()]
    assert sorted(wild) == ["a_b", "axb"]
    assert [r.t for r in explore.search(df, "k\\s", ["t"], wildcards=True).collect()] == ["back\\slash"]


def test_dynamic_group_allow_list(spark):
    df = spark.createDataFrame([("a", Decimal("1.00"))], "department string, amount decimal(18,2)")
    with pytest.raises(ValueError):
        explore.dynamic_group(df, "amount; drop table x")


def test_keyset_page_equals_offset_page(spark):
    rows = [(i, (i * 37) % 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, amount_php long").dropDuplicates(["amount_php"])
    first = explore.top_k(df, "amount_php", 50).collect()
    nxt = explore.page_after(df, "amount_php", first[-1].amount_php, 50).collect()
    by_offset = df.orderBy(F.col("amount_php").desc()).offset(50).limit(50).collect()
    assert [r.amount_php for r in nxt] == [r.amount_php for r in by_offset]


@pytest.mark.parametrize("desc", [True, False])
def test_keyset_pages_keep_ties_and_nulls(spark, desc):
    rows = [(i, None if i % 11 == 0 else i % 7, None if i % 5 == 0 else f"a{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, amount_php long, a string")
    want = [r.k for r in explore.top_k(df, "amount_php", None, ("a", "k"), desc).collect()]
    got, page = [], explore.top_k(df, "amount_php", 17, ("a", "k"), desc).collect()
    while page:
        got += [r.k for r in page]
        last = (page[-1].amount_php, page[-1].a, page[-1].k)
        page = explore.page_after(df, "amount_php", last, 17, desc, ("a", "k")).collect()
    assert got == want

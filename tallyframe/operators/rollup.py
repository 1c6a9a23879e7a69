"""Roll-ups A1-A5: the precomputed answers the dashboard reads.

Each is one groupBy: partial aggregation map-side, one exchange on the
grouping keys, final aggregation. Money sums are decimal(38,0) so national
totals cannot overflow. Distinct counts are planned by Catalyst (a single
distinct is a two-level aggregate; two distincts go through Expand).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.money import money_sum

DEPT_KEYS = ("department_code", "department_name", "department_short")
# dimensions and sums of the roll-up lattices (operators/lattice.py)
WORKSHOP_DIMENSIONS = ("department", "agency", "category", "region")
WORKSHOP_MEASURES = {"amount": "decimal(38,2)"}
LEDGER_DIMENSIONS = ("department_short", "agency_name", "expense_category", "region_id", "fund_subcategory")
LEDGER_MEASURES = {"amount_php": "decimal(38,0)"}
CATEGORY_COLUMNS = (("PS", "ps_php"), ("MOOE", "mooe_php"), ("CO", "co_php"), ("FE", "fe_php"))


def _category_sum(code: str) -> Column:
    amt = F.col("amount_php").cast("decimal(38,0)")
    return F.sum(F.when(F.col("expense_category") == code, amt).otherwise(F.lit(0)))


def _split_sums() -> list[Column]:
    return [_category_sum(code).alias(name) for code, name in CATEGORY_COLUMNS]


def department_rollup(detail: DataFrame) -> DataFrame:
    """A1: per department: line items, total, PS/MOOE/CO/FE split, distinct agencies."""
    return detail.groupBy(*DEPT_KEYS).agg(
        F.count(F.lit(1)).alias("line_items"),
        money_sum("amount_php").alias("total_php"),
        *_split_sums(),
        F.count_distinct("agency_code").alias("agency_count"),
    )


def expense_rollup(detail: DataFrame) -> DataFrame:
    """A2: per expense category and class: line items and total."""
    return detail.groupBy("expense_category", "expense_class").agg(
        F.count(F.lit(1)).alias("line_items"), money_sum("amount_php").alias("total_php"))


def agency_rollup(detail: DataFrame) -> DataFrame:
    """A3: per department x agency x expense category."""
    return detail.groupBy(*DEPT_KEYS, "agency_code", "agency_name", "expense_category").agg(
        F.count(F.lit(1)).alias("line_items"), money_sum("amount_php").alias("total_php"))


def region_rollup(detail: DataFrame) -> DataFrame:
    """A4: per region: totals, split, distinct departments (short) and agencies (name)."""
    return detail.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("line_items"),
        money_sum("amount_php").alias("total_php"),
        *_split_sums(),
        F.count_distinct("department_short").alias("department_count"),
        F.count_distinct("agency_name").alias("agency_count"),
    )


def grand_total(df: DataFrame, amount: str = "amount_php", alias: str = "grand_total") -> DataFrame:
    """A5: one-row grand total."""
    return df.agg(money_sum(amount).alias(alias))


BASE_KEYS = (*DEPT_KEYS, "agency_code", "agency_name", "expense_category", "expense_class", "region_id")


def base_grain(detail: DataFrame) -> DataFrame:
    """The finest grain any roll-up needs: one row per department x agency x class x region.

    Its size is bounded by dimension combinations, not by line items, and every
    distinct-counted column is a key, so all four roll-ups derive from it exactly.
    """
    return detail.groupBy(*BASE_KEYS).agg(F.count(F.lit(1)).alias("line_items"),
                                          money_sum("amount_php").alias("total_php"))


def _split_from_base() -> list[Column]:
    return [F.sum(F.when(F.col("expense_category") == code, F.col("total_php")).otherwise(F.lit(0))).alias(name)
            for code, name in CATEGORY_COLUMNS]


def rollups(detail: DataFrame, materialize: bool = True) -> dict[str, DataFrame]:
    """A1-A4 from one pass over the detail (``base_grain``), then cheap roll-ups of it.

    With ``materialize`` the base is checkpointed once, so the four outputs
    never rescan the detail.
    """
    base = base_grain(detail)
    if materialize:
        from tallyframe.session import checkpoint_dir

        checkpoint_dir(detail.sparkSession)
        base = base.checkpoint(eager=True)
    n, t = F.sum("line_items").alias("line_items"), F.sum("total_php").alias("total_php")
    return {
        "agg_department": base.groupBy(*DEPT_KEYS).agg(
            n, t, *_split_from_base(), F.count_distinct("agency_code").alias("agency_count")),
        "agg_expense": base.groupBy("expense_category", "expense_class").agg(n, t),
        "agg_agency": base.groupBy(*DEPT_KEYS, "agency_code", "agency_name", "expense_category").agg(n, t),
        "agg_region": base.groupBy("region_id").agg(
            n, t, *_split_from_base(), F.count_distinct("department_short").alias("department_count"),
            F.count_distinct("agency_name").alias("agency_count")),
    }

"""Narrative briefs (M18, M19) and shares of roll-ups.

Each brief is a single-row (or few-row) frame whose inputs are one-row
aggregates attached as scalar subqueries; the text is a ``concat`` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.format import WORKSHOP_DECIMALS, abbrev, fixed
from tallyframe.functions.money import dround, pct  # noqa: F401
from tallyframe.operators import concentration

# The workshop brief template.
WORKSHOP_BRIEF = (
    "The portfolio totals {total} across {groups} departments, but {top} alone commands "
    "{top_pct}% — a sign of structural concentration at the top. The gap between the largest "
    "({top}) and smallest ({bottom}) allocation is {ratio}×, revealing steep tier disparity. "
    "Leadership should validate whether this concentration reflects strategic priority or an "
    "execution bottleneck before the next cycle."
)


def _fmt(template: str, **cols) -> F.Column:
    """Fill ``{name}`` slots of a fixed template with string columns."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(pre), cols[key]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def kpis(agg_department: DataFrame) -> DataFrame:
    """Total, department count, summed per-department agency counts, line items."""
    return agg_department.agg(
        F.sum("total_php").alias("total_budget"), F.count(F.lit(1)).alias("department_count"),
        F.sum("agency_count").alias("agency_count"), F.sum("line_items").alias("line_items"))


def category_shares(agg_expense: DataFrame, categories=("PS", "CO")) -> DataFrame:
    """Total and ROUND(share * 100, 1) of the given categories."""
    total = F.sum("total_php")
    cols = [pct(F.sum(F.when(F.col("expense_category") == c, F.col("total_php")).otherwise(F.lit(0))),
                total, 1).alias(f"{c.lower()}_pct") for c in categories]
    return agg_expense.agg(total.alias("total"), *cols)


def row_share(df: DataFrame, key: str, value, column: str = "total_php") -> DataFrame:
    """One row's share of the table total (scalar subquery as a one-row broadcast)."""
    total = df.agg(F.sum(column)).scalar()
    return df.where(F.col(key) == F.lit(value)).select(pct(F.col(column), total, 1).alias("pct"))


def top_names(df: DataFrame, name: str, value: str, k: int = 3, sep: str = ", ") -> DataFrame:
    """Names of the top k by value, joined in value-desc order (ties by name)."""
    top = df.orderBy(F.col(value).desc_nulls_last(), F.col(name).asc_nulls_last()).limit(k)
    # sort key: value descending, then name ascending; k rows only
    items = F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    return top.agg(F.array_join(F.transform(F.sort_array(items), lambda s: s["n"]), sep).alias("names"))


def workshop_brief(cleaned: DataFrame, group: str = "department", amount: str = "amount") -> DataFrame:
    """Dataset-generic brief over group totals (largest share, largest/smallest)."""
    totals = cleaned.groupBy(group).agg(F.sum(amount).cast("decimal(38,2)").alias("total"))
    e = concentration.extremes(totals, group, "total")
    text = _fmt(
        WORKSHOP_BRIEF,
        total=abbrev(F.col("total"), WORKSHOP_DECIMALS),
        groups=F.col("groups").cast("string"),
        top=F.col("largest"), bottom=F.col("smallest"),
        top_pct=fixed(F.col("top_pct"), 1),
        ratio=fixed(F.col("ratio"), 0),
    )
    return e.select(text.alias("executive_brief"))


# The ledger brief templates.
LEDGER_SUMMARY = (
    "The budget allocates ₱{trillions} Trillion across {departments} departments. Fiscal "
    "concentration remains high — {top3} account for the majority of national spending. "
    "Personnel costs ({ps}%) dominate over infrastructure investment ({co}%), while {region} "
    "absorbs {region_pct}% of all regional allocations through centralized agency operations."
)
LEDGER_HIGHLIGHTS = (
    "Personnel Services at {ps}% signals workforce-heavy government structure",
    "Capital Outlays at only {co}% constrains long-term asset growth",
    "{region} concentration ({region_pct}%) reflects HQ-centric allocation, not deployment",
    "Top 3 departments ({top3}) drive national fiscal strategy",
)


def ledger_brief(agg_department: DataFrame, agg_expense: DataFrame, agg_region: DataFrame,
                 region_id: str, region_label: str | None = None) -> DataFrame:
    """Summary + 4 highlights from A17 (top 3), A15 (PS/CO) and A16 (one region)."""
    top3 = top_names(agg_department, "department_short", "total_php", 3)
    shares = category_shares(agg_expense, ("PS", "CO"))
    reg = row_share(agg_region, "region_id", region_id).withColumnRenamed("pct", "region_pct")
    depts = agg_department.agg(F.count(F.lit(1)).alias("departments"))
    one = top3.select("names", *[shares.select(c).scalar().alias(c) for c in shares.columns],
                      reg.select("region_pct").scalar().alias("region_pct"),
                      depts.select("departments").scalar().alias("departments"))
    num = lambda c: fixed(F.col(c), 1)
    slots = dict(
        trillions=fixed(F.col("total").cast("double") / F.lit(1e12), 2),
        departments=F.col("departments").cast("string"), top3=F.col("names"),
        ps=num("ps_pct"), co=num("co_pct"), region=F.lit(region_label or f"Region {region_id}"),
        region_pct=num("region_pct"))
    rows = [F.struct(F.lit(0).alias("line"), F.lit("summary").alias("kind"),
                     _fmt(LEDGER_SUMMARY, **slots).alias("text"))]
    rows += [F.struct(F.lit(i).alias("line"), F.lit("highlight").alias("kind"),
                      _fmt(h, **{k: v for k, v in slots.items() if "{" + k + "}" in h}).alias("text"))
             for i, h in enumerate(LEDGER_HIGHLIGHTS, start=1)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

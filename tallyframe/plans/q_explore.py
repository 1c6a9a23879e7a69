"""Registered queries: search, paging, top-k, drill-downs, shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.money import money_sum
from tallyframe.operators import brief, explore
from tallyframe.plans.catalog import query
from tallyframe.plans.oracle import dround, pct, sql

# Parameters used against the test ledger.
EXCLUDED_FUND = "3-MEDIUM"
DRILL_DEPARTMENT = "N09"
FOCUS_REGION = "04"
W_REGION, W_CATEGORY = "MIDDLE EAST", "MOOE"


@query("t1_top_departments", sql("""SELECT * FROM agg_department
  ORDER BY total_php DESC, department_code, department_name LIMIT 10""", "agg_department"))
def _t1(c):
    return explore.top_k(c.agg_department, "total_php", 10, tie=("department_code", "department_name"))


@query("t1_top_department_1", sql("""SELECT department_short, total_php FROM agg_department
  ORDER BY total_php DESC, department_short LIMIT 1""", "agg_department"))
def _t1b(c):
    return explore.top_k(c.agg_department.select("department_short", "total_php"), "total_php", 1,
                         tie=("department_short",))


@query("t2_expense_ordered", sql("SELECT * FROM agg_expense", "agg_expense"))
def _t2(c):
    return explore.top_k(c.agg_expense, "total_php", None, tie=("expense_category", "expense_class"))


@query("t3_drill_down", sql(f"""SELECT agency_name, expense_category, total_php FROM agg_agency
  WHERE department_short = '{DRILL_DEPARTMENT}'""", "agg_agency"))
def _t3(c):
    return explore.drill_down(c.agg_agency, DRILL_DEPARTMENT)


_PAGE_COLS = "department_short, agency_name, program_description, expense_category, object_description, amount_php"
_SEARCH = """(contains(lower(object_description), 'ring') OR contains(lower(agency_name), 'ring')
    OR contains(lower(program_description), 'ring') OR contains(lower(department_short), 'ring'))"""


@query("t4_page_amount_desc", sql(f"""SELECT {_PAGE_COLS} FROM detail
  WHERE {_SEARCH} AND expense_category = 'PS'
  ORDER BY amount_php DESC, department_short, agency_name, program_description, expense_category,
           object_description
  LIMIT 50 OFFSET 100""", "detail"))
def _t4(c):
    return explore.page(c.detail, "amount_php", True, 2, filters={"expense_category": "PS"}, text="ring")


@query("t4_page_keyset", sql(f"""SELECT {_PAGE_COLS} FROM detail
  ORDER BY amount_php DESC, department_short, agency_name NULLS LAST, program_description, expense_category,
           object_description
  LIMIT 50 OFFSET 50""", "detail"))
def _t4k(c):
    """The second page by the first one's last row; full ties of a page's end are the same rows."""
    last = explore.page(c.page_rows, "amount_php", True, 0).collect()[-1]
    return explore.page_after(c.page_rows, "amount_php", tuple(last[x] for x in ("amount_php", *explore.PAGE_TIES)), 50, True, explore.PAGE_TIES)


@query("t4_page_department_asc", sql(f"""SELECT {_PAGE_COLS} FROM detail
  ORDER BY department_short, agency_name NULLS LAST, program_description, expense_category,
           object_description, amount_php
  LIMIT 50 OFFSET 0""", "detail"))
def _t4b(c):
    return explore.page(c.detail, "department_short", False, 0)


@query("p13_search_wildcards", sql("""SELECT COUNT(*) AS rows, CAST(CEIL(COUNT(*) / 50) AS BIGINT) AS pages
  FROM detail WHERE (object_description ILIKE '%s_all%' OR agency_name ILIKE '%s_all%'
    OR program_description ILIKE '%s_all%' OR department_short ILIKE '%s_all%')""", "detail"))
def _p13w(c):
    return explore.filtered_count(explore.search(c.detail, "s_all", wildcards=True))


def _indexed(needle: str) -> str:
    return sql(f"""SELECT agency_name, COUNT(*) AS rows, CAST(SUM(amount_php) AS DECIMAL(38,0)) AS total_php FROM detail
  WHERE contains(lower(object_description), '{needle}') OR contains(lower(agency_name), '{needle}')
    OR contains(lower(program_description), '{needle}') OR contains(lower(department_short), '{needle}')
  GROUP BY agency_name""", "detail")


def _by_agency(rows):
    return rows.groupBy("agency_name").agg(F.count(F.lit(1)).alias("rows"), money_sum("amount_php").alias("total_php"))


@query("p13_search_postings", _indexed("00007"))
def _p13p(c):
    return _by_agency(c.postings.search("00007"))


@query("p13_search_postings_short", _indexed("07"))
def _p13s(c):
    return _by_agency(c.postings.search("07"))


@query("p13_search_literal", sql("""SELECT COUNT(*) AS rows, CAST(CEIL(COUNT(*) / 50) AS BIGINT) AS pages
  FROM detail WHERE (contains(lower(object_description), '100%') OR contains(lower(agency_name), '100%')
    OR contains(lower(program_description), '100%') OR contains(lower(department_short), '100%'))""",
    "detail"))
def _p13l(c):
    return explore.filtered_count(c.detail, text="100%")


@query("a12_t5_filtered_count", sql(f"""SELECT COUNT(*) AS rows, CAST(CEIL(COUNT(*) / 50) AS BIGINT) AS pages
  FROM detail WHERE {_SEARCH} AND expense_category = 'PS'""", "detail"))
def _a12(c):
    return explore.filtered_count(c.detail, {"expense_category": "PS"}, text="ring")


@query("a12_workshop_count", sql(f"""SELECT COUNT(*) AS rows, CAST(CEIL(COUNT(*) / 50) AS BIGINT) AS pages
  FROM wclean WHERE region = '{W_REGION}' AND category = '{W_CATEGORY}'""", "wclean"))
def _a12w(c):
    return explore.filtered_count(c.wlattice, {"region": W_REGION, "category": W_CATEGORY})


@query("a6_special_funds", sql(f"""SELECT fund_subcategory, line_items, total_php,
    CASE WHEN length(fund_subcategory) > 40 THEN substr(fund_subcategory, 1, 38) || '…'
         ELSE fund_subcategory END AS label,
    {dround('CAST(total_php AS DOUBLE) / 1e9', 1)} AS total_b
  FROM (SELECT fund_subcategory, COUNT(*) AS line_items, CAST(SUM(amount_php) AS DECIMAL(38,0)) AS total_php
        FROM detail WHERE fund_subcategory != '{EXCLUDED_FUND}' AND fund_subcategory IS NOT NULL
        GROUP BY fund_subcategory ORDER BY total_php DESC, fund_subcategory LIMIT 15)""", "detail"))
def _a6(c):
    return explore.special_funds(c.lattice, EXCLUDED_FUND)


@query("m16_displayed_total", sql(f"""SELECT CAST(SUM(total_php) AS DECIMAL(38,0)) AS displayed_total
  FROM (SELECT fund_subcategory, CAST(SUM(amount_php) AS DECIMAL(38,0)) AS total_php
        FROM detail WHERE fund_subcategory != '{EXCLUDED_FUND}' AND fund_subcategory IS NOT NULL
        GROUP BY fund_subcategory ORDER BY total_php DESC, fund_subcategory LIMIT 15)""", "detail"))
def _m16(c):
    return explore.displayed_total(explore.special_funds(c.lattice, EXCLUDED_FUND))


def _wtop(dim, where="", k=None, label=None):
    lim = f" LIMIT {k}" if k else ""
    name = f"{dim} AS {label}" if label else dim
    return sql(f"""SELECT {name}, CAST(SUM(amount) AS DECIMAL(38,2)) AS total FROM wclean {where}
  GROUP BY {dim} ORDER BY total DESC, {dim}{lim}""", "wclean")


@query("a7_top_departments", _wtop("department", k=10))
def _a7(c):
    return explore.totals_by(c.wclean, "department", k=10)


@query("t7_top_departments_display", _wtop("department", k=10))
def _t7(c):
    return explore.for_display(explore.totals_by(c.wclean, "department", k=10), "total", tie=("department",))


@query("a8_category_totals", sql(f"""SELECT category, total, grand_total, {pct('total', 'grand_total')} AS pct
  FROM (SELECT category, CAST(SUM(amount) AS DECIMAL(38,2)) AS total FROM wclean GROUP BY category),
       (SELECT CAST(SUM(amount) AS DECIMAL(38,2)) AS grand_total FROM wclean)""", "wclean"))
def _a8(c):
    totals = explore.totals_by(c.wclean, "category")
    grand = totals.agg(F.sum("total").cast("decimal(38,2)")).scalar()     # of the few totals, not of the rows
    return totals.select("category", "total", grand.alias("grand_total"),
                         brief.pct(F.col("total"), grand, 1).alias("pct"))


@query("a9_region_totals", _wtop("region"))
def _a9(c):
    return explore.totals_by(c.wlattice, "region")


@query("a10_priority_capital", _wtop("agency", "WHERE category = 'Capital Outlays'", 10))
def _a10(c):
    return explore.totals_by(c.wlattice, "agency", k=10, filters={"category": "Capital Outlays"})


@query("a11_dynamic_group", _wtop("agency", f"WHERE region = '{W_REGION}' AND category = '{W_CATEGORY}'",
                                  20, label="label"))
def _a11(c):
    return explore.dynamic_group(c.wlattice, "agency", region=W_REGION, category=W_CATEGORY)


@query("a11_dynamic_group_all", _wtop("category", "", 20, label="label"))
def _a11b(c):
    return explore.dynamic_group(c.wlattice, "category")


@query("a13_region_options", sql("SELECT DISTINCT region FROM wclean", "wclean"))
def _a13(c):
    return explore.distinct_options(c.wlattice, "region")


@query("a18_by_department", _wtop("department"))
def _a18a(c):
    return explore.totals_by(c.wlattice, "department")


@query("a18_region_filter_by_category", _wtop("category", f"WHERE region = '{W_REGION}'"))
def _a18b(c):
    return explore.totals_by(c.wlattice, "category", filters={"region": W_REGION})


@query("a18_category_filter_by_department", _wtop("department", f"WHERE category = '{W_CATEGORY}'"))
def _a18c(c):
    return explore.totals_by(c.wlattice, "department", filters={"category": W_CATEGORY})


@query("a18_two_filters_by_agency", _wtop(
    "agency", f"WHERE region = '{W_REGION}' AND category = 'Personnel Services'"))
def _a18d(c):
    return explore.totals_by(c.wlattice, "agency", filters={"region": W_REGION, "category": "Personnel Services"})


@query("a18_grand_total", sql("SELECT CAST(SUM(amount) AS DECIMAL(38,2)) AS total FROM wclean", "wclean"))
def _a18e(c):
    return explore.total(c.wlattice)


@query("t6_sample_top5", sql("SELECT * FROM wclean ORDER BY amount DESC, id, region LIMIT 5", "wclean"))
def _t6(c):
    return explore.top_k(c.wclean, "amount", 5, tie=("id", "region"))


@query("a14_kpis", sql("""SELECT CAST(SUM(total_php) AS DECIMAL(38,0)) AS total_budget,
  COUNT(*) AS department_count, CAST(SUM(agency_count) AS BIGINT) AS agency_count,
  CAST(SUM(line_items) AS BIGINT) AS line_items FROM agg_department""", "agg_department"))
def _a14(c):
    return brief.kpis(c.agg_department)


@query("a15_category_shares", sql(f"""SELECT CAST(SUM(total_php) AS DECIMAL(38,0)) AS total,
  {pct("SUM(CASE WHEN expense_category = 'PS' THEN total_php ELSE 0 END)", 'SUM(total_php)')} AS ps_pct,
  {pct("SUM(CASE WHEN expense_category = 'CO' THEN total_php ELSE 0 END)", 'SUM(total_php)')} AS co_pct
  FROM agg_expense""", "agg_expense"))
def _a15(c):
    return brief.category_shares(c.agg_expense)


@query("a16_region_share", sql(f"""SELECT {pct('total_php', '(SELECT SUM(total_php) FROM agg_region)')} AS pct
  FROM agg_region WHERE region_id = '{FOCUS_REGION}'""", "agg_region"))
def _a16(c):
    return brief.row_share(c.agg_region, "region_id", FOCUS_REGION)


@query("a17_top3_names", sql("""SELECT STRING_AGG(department_short, ', ' ORDER BY total_php DESC, department_short)
  AS names FROM (SELECT department_short, total_php FROM agg_department
                 ORDER BY total_php DESC, department_short LIMIT 3)""", "agg_department"))
def _a17(c):
    return brief.top_names(c.agg_department, "department_short", "total_php", 3)


# ---------------------------------------------------------------- parameter variants

@query("t4_page_deep_amount_asc", sql(f"""SELECT {_PAGE_COLS} FROM detail
  ORDER BY amount_php ASC, department_short, agency_name NULLS LAST, program_description, expense_category,
           object_description
  LIMIT 50 OFFSET 1000""", "detail"))
def _t4deep(c):
    return explore.page(c.detail, "amount_php", False, 20)


@query("t4_page_5000_by_index", sql(f"""SELECT {_PAGE_COLS} FROM detail
  ORDER BY amount_php DESC, department_short, agency_name NULLS LAST, program_description, expense_category,
           object_description
  LIMIT 5 OFFSET 25000""", "detail"))
def _t4index(c):
    return c.amount_pages.page(5000, 5).select(*_PAGE_COLS.split(", "))


# (FILTER form: DuckDB 2.0.0 raises an internal dictionary-cache error on this two-column WHERE)
@query("p12_two_filter_count", sql("""SELECT n AS rows, CAST(CEIL(n / 50) AS BIGINT) AS pages
  FROM (SELECT COUNT(*) FILTER (WHERE expense_category = 'CO' AND region_id = '02') AS n FROM detail)""",
    "detail"))
def _p12(c):
    return explore.filtered_count(c.lattice, {"expense_category": "CO", "region_id": "02"})


@query("a6_special_funds_top2", sql(f"""SELECT fund_subcategory, line_items, total_php,
    CASE WHEN length(fund_subcategory) > 40 THEN substr(fund_subcategory, 1, 38) || '…'
         ELSE fund_subcategory END AS label,
    {dround('CAST(total_php AS DOUBLE) / 1e9', 1)} AS total_b
  FROM (SELECT fund_subcategory, COUNT(*) AS line_items, CAST(SUM(amount_php) AS DECIMAL(38,0)) AS total_php
        FROM detail WHERE fund_subcategory != '1-URGENT' AND fund_subcategory IS NOT NULL
        GROUP BY fund_subcategory ORDER BY total_php DESC, fund_subcategory LIMIT 2)""", "detail"))
def _a6b(c):
    return explore.special_funds(c.lattice, "1-URGENT", k=2)


@query("a11_dynamic_group_department_capital", _wtop("department", "WHERE category = 'Capital Outlays'", 20,
                                                     label="label"))
def _a11c(c):
    return explore.dynamic_group(c.wlattice, "department", category="Capital Outlays")


@query("t3_drill_down_lowercase_variant", sql(f"""SELECT agency_name, expense_category, total_php FROM agg_agency
  WHERE department_short = '{DRILL_DEPARTMENT.lower()}'""", "agg_agency"))
def _t3b(c):
    return explore.drill_down(c.agg_agency, DRILL_DEPARTMENT.lower())

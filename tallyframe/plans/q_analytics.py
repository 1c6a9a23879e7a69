"""Registered queries: post-query analytics and briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.format import DASHBOARD_DECIMALS, abbrev, thousands
from tallyframe.operators import brief, concentration, explore
from tallyframe.plans.catalog import query
from tallyframe.plans.oracle import abbrev as sql_abbrev
from tallyframe.plans.oracle import define, dround, pct, sql
from tallyframe.plans import q_geo  # noqa: F401  (defines the region_names CTE)
from tallyframe.plans.q_explore import DRILL_DEPARTMENT, FOCUS_REGION

OUTLIER_AGENCY = "42"

define("agency_totals", """SELECT agency_code, CAST(SUM(total_php) AS DECIMAL(38,0)) AS total_php
  FROM agg_agency GROUP BY agency_code""", "agg_agency")


def agency_totals(c):
    return c.agg_agency.groupBy("agency_code").agg(F.sum("total_php").alias("total_php"))


@query("m1_expense_share", sql(f"""SELECT *, {pct('total_php', 'SUM(total_php) OVER ()')} AS pct
  FROM agg_expense""", "agg_expense"))
def _m1(c):
    return concentration.share_of_total(c.agg_expense, "total_php")


@query("m2_region_rank", sql("""SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY total_php DESC, region_id) AS BIGINT)
  AS rank FROM agg_region""", "agg_region"))
def _m2(c):
    return concentration.rank_by(c.agg_region, "total_php", tie=("region_id",))


@query("m2_agency_rank", sql("""SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY total_php DESC, department_code,
  department_name, agency_code, agency_name NULLS LAST, expense_category) AS BIGINT) AS rank
  FROM agg_agency""", "agg_agency"))
def _m2b(c):
    return concentration.rank_by(c.agg_agency, "total_php", tie=(
        "department_code", "department_name", "agency_code", "agency_name", "expense_category"))


_SPLIT_PCT = ", ".join(f"{pct(p, 'total_php')} AS {p.replace('_php', '_pct')}"
                       for p in ("ps_php", "mooe_php", "co_php", "fe_php"))


@query("m3_m4_region_split", sql(f"""SELECT *, {_SPLIT_PCT},
  {dround('CAST(total_php AS DOUBLE) / NULLIF(CAST(line_items AS DOUBLE), 0.0)', 2)} AS avg_per_item
  FROM agg_region""", "agg_region"))
def _m3(c):
    return concentration.split_shares(c.agg_region)


@query("m5_region_lookup", sql(f"SELECT * FROM agg_region WHERE region_id = '{FOCUS_REGION}'", "agg_region"))
def _m5(c):
    return concentration.point_lookup(c.agg_region, "region_id", FOCUS_REGION)


def _bins_sql(src, key, outlier, factor=0.9):
    qs = (0.2, 0.4, 0.6, 0.8)
    picks = ", ".join(f"MAX(CASE WHEN r = FLOOR(CAST({q} AS DOUBLE) * (n - 1)) + 1 THEN total_php END) AS b{j}"
                      for j, q in enumerate(qs))
    return f"""SELECT {key}, total_php, CAST(CASE
      WHEN CAST(total_php AS DOUBLE) >= CAST(ot AS DOUBLE) * {factor} THEN 5
      WHEN total_php >= b3 THEN 4 WHEN total_php >= b2 THEN 3
      WHEN total_php >= b1 THEN 2 WHEN total_php >= b0 THEN 1 ELSE 0 END AS INTEGER) AS bin
  FROM {src},
   (SELECT {picks} FROM (SELECT total_php, ROW_NUMBER() OVER (ORDER BY total_php, {key}) AS r,
                           COUNT(*) OVER () AS n FROM {src} WHERE {key} != '{outlier}')),
   (SELECT COALESCE(MAX(CASE WHEN {key} = '{outlier}' THEN total_php END), 0) AS ot FROM {src})"""


@query("m6_region_bins", sql(_bins_sql("agg_region", "region_id", FOCUS_REGION), "agg_region"))
def _m6(c):
    return concentration.quantile_bins(c.agg_region, "region_id", "total_php", FOCUS_REGION)


@query("m6_agency_bins", sql(_bins_sql("agency_totals", "agency_code", OUTLIER_AGENCY), "agency_totals"))
def _m6b(c):
    return concentration.quantile_bins(agency_totals(c), "agency_code", "total_php", OUTLIER_AGENCY)


def _legend_sql(src, key, outlier, factor=0.9):
    qs = (0.2, 0.4, 0.6, 0.8)
    picks = ", ".join(f"MAX(CASE WHEN r = FLOOR(CAST({q} AS DOUBLE) * (n - 1)) + 1 THEN total_php END) AS b{j}"
                      for j, q in enumerate(qs))
    lab = lambda b: sql_abbrev(b, DASHBOARD_DECIMALS)
    d = "CAST(NULL AS DECIMAL(38,0))"
    rows = [f"SELECT 0 AS bin, {d} AS lower, CAST(b0 AS DECIMAL(38,0)) AS upper, '< ' || {lab('b0')} AS label FROM b"]
    rows += [f"SELECT {j + 1}, CAST(b{j} AS DECIMAL(38,0)), CAST(b{j + 1} AS DECIMAL(38,0)), "
             f"{lab(f'b{j}')} || ' - ' || {lab(f'b{j + 1}')} FROM b" for j in range(3)]
    rows += [f"SELECT 4, CAST(b3 AS DECIMAL(38,0)), {d}, '> ' || {lab('b3')} FROM b",
             f"SELECT 5, CAST(FLOOR(CAST(ot AS DOUBLE) * {factor}) AS DECIMAL(38,0)), {d}, 'outlier' FROM b"]
    return f"""WITH b AS (SELECT * FROM
   (SELECT {picks} FROM (SELECT total_php, ROW_NUMBER() OVER (ORDER BY total_php, {key}) AS r,
                           COUNT(*) OVER () AS n FROM {src} WHERE {key} != '{outlier}')),
   (SELECT COALESCE(MAX(CASE WHEN {key} = '{outlier}' THEN total_php END), 0) AS ot FROM {src}))
  {' UNION ALL '.join(rows)}"""


@query("m7_agency_bin_legend", sql(_legend_sql("agency_totals", "agency_code", OUTLIER_AGENCY).replace(
    "WITH b AS", "SELECT * FROM (WITH b AS", 1) + ")", "agency_totals"))
def _m7(c):
    return concentration.bin_legend(agency_totals(c), "agency_code", "total_php", OUTLIER_AGENCY)


@query("m8_region_leader", sql(f"""SELECT leader, leader_total, runner_up, runner_up_total,
    CAST(leader_total - COALESCE(runner_up_total, 0) AS DECIMAL(38,0)) AS gap,
    {dround('CAST(leader_total AS DOUBLE) / NULLIF(CAST(runner_up_total AS DOUBLE), 0.0)', 1)} AS ratio,
    {pct('leader_total', 't')} AS leader_pct,
    COALESCE(CAST(ABS(leader_total - runner_up_total) AS DOUBLE) / CAST(leader_total AS DOUBLE) < 0.001,
             false) AS tied
  FROM (SELECT MAX(CASE WHEN rn = 1 THEN region_id END) AS leader,
               MAX(CASE WHEN rn = 1 THEN total_php END) AS leader_total,
               MAX(CASE WHEN rn = 2 THEN region_id END) AS runner_up,
               MAX(CASE WHEN rn = 2 THEN total_php END) AS runner_up_total
        FROM (SELECT region_id, total_php, ROW_NUMBER() OVER (ORDER BY total_php DESC, region_id) AS rn
              FROM agg_region)),
       (SELECT SUM(total_php) AS t FROM agg_region)""", "agg_region"))
def _m8(c):
    return concentration.leader_gap(c.agg_region, "region_id", "total_php")


define("dept_tiers", f"""SELECT tier,
    CASE tier WHEN 1 THEN 'Tier 1 (top 5)' WHEN 2 THEN 'Tier 2 (6-15)' ELSE 'Tier 3 (16+)' END AS tier_label,
    members, total, {pct('total', 'SUM(total) OVER ()')} AS pct,
    COALESCE(first5, '') || CASE WHEN members > 5 THEN ' +' || CAST(members - 5 AS VARCHAR) || ' more'
                                 ELSE '' END AS names
  FROM (SELECT tier, COUNT(*) AS members, CAST(SUM(total_php) AS DECIMAL(38,0)) AS total,
               STRING_AGG(CASE WHEN pos <= 5 THEN department_short END, ', ' ORDER BY pos) AS first5
        FROM (SELECT *, rank - CASE tier WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 16 END + 1 AS pos
              FROM (SELECT *, CAST(CASE WHEN rank <= 5 THEN 1 WHEN rank <= 15 THEN 2 ELSE 3 END AS INTEGER) AS tier
                    FROM (SELECT department_short, total_php,
                                 ROW_NUMBER() OVER (ORDER BY total_php DESC, department_short) AS rank
                          FROM agg_department)))
        GROUP BY tier)""", "agg_department")


def _tiers(c):
    return concentration.tiers(c.agg_department, "department_short", "total_php")


@query("m9_m12_department_tiers", sql("SELECT * FROM dept_tiers", "dept_tiers"))
def _m9(c):
    return _tiers(c)


@query("m11_tier_summary", sql(f"""SELECT
    {dround("CAST(MAX(CASE WHEN tier = 1 THEN total END) AS DOUBLE) / NULLIF(CAST(MAX(CASE WHEN tier = 3 THEN total END) AS DOUBLE), 0.0)", 0)} AS tier1_to_tier3,
    MAX(CASE WHEN tier = 1 THEN pct END) AS top_pct,
    MAX(CASE WHEN tier = 3 THEN pct END) AS bottom_pct
  FROM dept_tiers""", "dept_tiers"))
def _m11(c):
    return concentration.tier_summary(_tiers(c))


@query("m10_department_gini", sql(f"""SELECT n, {dround(
    'CAST(num AS DOUBLE) / NULLIF(CAST(n AS DOUBLE) * CAST(tot AS DOUBLE), 0.0)', 6)} AS gini
  FROM (SELECT COUNT(*) AS n, CAST(SUM(x) AS DECIMAL(38,0)) AS tot,
               CAST(SUM((2 * i - cnt - 1) * x) AS DECIMAL(38,0)) AS num
        FROM (SELECT CAST(total_php AS DECIMAL(38,0)) AS x,
                     ROW_NUMBER() OVER (ORDER BY total_php, department_short) AS i,
                     COUNT(*) OVER () AS cnt FROM agg_department))""", "agg_department"))
def _m10(c):
    return concentration.gini(c.agg_department, "total_php", "department_short")


_CATS = ("PS", "MOOE", "CO", "FE", "Other")


@query("m13_agency_pivot", sql(f"""SELECT agency_name, {', '.join(
    f"CAST(COALESCE(SUM(CASE WHEN expense_category = '{k}' THEN total_php END), 0) AS DECIMAL(38,0)) AS {k}"
    for k in _CATS)}
  FROM agg_agency WHERE department_short = '{DRILL_DEPARTMENT}' AND agency_name IN (
    SELECT agency_name FROM agg_agency WHERE department_short = '{DRILL_DEPARTMENT}'
    GROUP BY agency_name ORDER BY MAX(total_php) DESC, agency_name LIMIT 15)
  GROUP BY agency_name""", "agg_agency"))
def _m13(c):
    return concentration.pivot_top(c.agg_agency, DRILL_DEPARTMENT)


# the test agencies' names are short: the chart is asked for programs, whose descriptions are not
define("program_rows", f"""SELECT department_short, program_description || ' (' || object_description || ')' AS agency_name,
    expense_category, CAST(SUM(amount_php) AS DECIMAL(38,0)) AS total_php
  FROM detail WHERE department_short = '{DRILL_DEPARTMENT}' GROUP BY ALL""", "detail")


@query("m13_drill_down_chart", sql(f"""SELECT agency_name,
    CASE WHEN length(agency_name) > 30 THEN substr(agency_name, 1, 28) || '…' ELSE agency_name END AS label, {', '.join(
    f"CAST(COALESCE(SUM(CASE WHEN expense_category = '{k}' THEN total_php END), 0) AS DOUBLE) / 1e9 AS {k.lower()}_billions"
    for k in _CATS)}
  FROM program_rows WHERE agency_name IN (SELECT agency_name FROM program_rows GROUP BY agency_name
    ORDER BY MAX(total_php) DESC, agency_name LIMIT 15)
  GROUP BY agency_name""", "program_rows"))
def _m13chart(c):
    name = F.concat("program_description", F.lit(" ("), "object_description", F.lit(")"))
    rows = (c.detail.where(F.col("department_short") == DRILL_DEPARTMENT)
            .groupBy("department_short", name.alias("agency_name"), "expense_category")
            .agg(F.sum(F.col("amount_php").cast("decimal(38,0)")).alias("total_php")))
    return concentration.pivot_chart(concentration.pivot_top(rows, DRILL_DEPARTMENT))


@query("f2_long_labels", sql("""SELECT DISTINCT name, CASE WHEN length(name) > 40 THEN substr(name, 1, 38) || '…' ELSE name END AS label
  FROM (SELECT fund_subcategory || ' / ' || program_description || ' / ' || object_description AS name FROM detail)""", "detail"))
def _f2(c):
    """Fund labels of over 40 characters: the fund with its program and object."""
    from tallyframe.functions.text import truncate_label

    name = F.concat_ws(" / ", "fund_subcategory", "program_description", "object_description")
    whole = F.when(F.col("fund_subcategory").isNotNull() & F.col("program_description").isNotNull()
                   & F.col("object_description").isNotNull(), name)
    return c.detail.select(whole.alias("name")).distinct().select("name", truncate_label("name", 40, 38).alias("label"))


@query("f1_map_labels", sql(f"""SELECT region_id, {', '.join(
    f"{sql_abbrev(f'{k}_php', (None, 1, 0, None))} AS {k}_label" for k in ('total', 'ps', 'mooe', 'co', 'fe'))},
    {sql_abbrev('CAST(total_php AS DOUBLE) / 1000', (None, 1, 0, None))} AS thousandth_label
  FROM agg_region""", "agg_region"))
def _f1map(c):
    from tallyframe.functions import format as fm

    return c.agg_region.select("region_id", *[fm.abbrev(F.col(f"{k}_php"), fm.MAP_DECIMALS).alias(f"{k}_label")
                                              for k in ("total", "ps", "mooe", "co", "fe")],
                               fm.abbrev(F.col("total_php").cast("double") / 1000, fm.MAP_DECIMALS).alias("thousandth_label"))


@query("m14_relative_to_max", sql(f"""SELECT *, {dround(
    'CAST(total_php AS DOUBLE) / NULLIF(CAST(MAX(total_php) OVER () AS DOUBLE), 0.0)', 4)} AS rel_to_max
  FROM (SELECT * FROM agg_department ORDER BY total_php DESC, department_code, department_name LIMIT 10)""",
    "agg_department"))
def _m14(c):
    top = explore.top_k(c.agg_department, "total_php", 10, tie=("department_code", "department_name"))
    return concentration.relative_to_max(top, "total_php")


@query("m15_department_extremes", sql(f"""SELECT b.department_short AS largest, b.total_php AS largest_total,
    s.department_short AS smallest, s.total_php AS smallest_total, groups, total,
    {pct('b.total_php', 'total')} AS top_pct,
    {dround('CAST(b.total_php AS DOUBLE) / NULLIF(CAST(s.total_php AS DOUBLE), 0.0)', 0)} AS ratio
  FROM (SELECT department_short, total_php FROM agg_department
        ORDER BY total_php DESC, department_short DESC LIMIT 1) b,
       (SELECT department_short, total_php FROM agg_department
        ORDER BY total_php ASC, department_short ASC LIMIT 1) s,
       (SELECT COUNT(*) AS groups, CAST(SUM(total_php) AS DECIMAL(38,0)) AS total FROM agg_department)""",
    "agg_department"))
def _m15(c):
    return concentration.extremes(c.agg_department, "department_short", "total_php")


@query("f1_f3_labels", sql(f"""SELECT department_short, total_php,
    {sql_abbrev('total_php', (2, 2, 1, 0))} AS label_workshop,
    {sql_abbrev('total_php', (2, 1, 0, None))} AS label_dashboard,
    {sql_abbrev('total_php', (2, 1, 1, None))} AS label_summary,
    {sql_abbrev('total_php', (None, 2, 1, 0))} AS label_table,
    {sql_abbrev('CAST(total_php AS DOUBLE) / 1000000', (2, 2, 1, 0))} AS label_small,
    format('{{:,}}', CAST(ROUND(CAST(total_php AS DECIMAL(38,2)), 0) AS HUGEINT)) AS grouped
  FROM agg_department""", "agg_department"))
def _f1(c):
    from tallyframe.functions import format as fm

    t = F.col("total_php")
    return c.agg_department.select(
        "department_short", "total_php",
        abbrev(t, fm.WORKSHOP_DECIMALS).alias("label_workshop"),
        abbrev(t, fm.DASHBOARD_DECIMALS).alias("label_dashboard"),
        abbrev(t, fm.SUMMARY_DECIMALS).alias("label_summary"),
        abbrev(t, fm.TABLE_DECIMALS).alias("label_table"),
        abbrev(t.cast("double") / F.lit(1000000), fm.WORKSHOP_DECIMALS).alias("label_small"),
        thousands(t).alias("grouped"))


_BRIEF_SQL = f"""SELECT 'The portfolio totals ' || {sql_abbrev('total', (2, 2, 1, 0))} || ' across '
    || CAST(groups AS VARCHAR) || ' departments, but ' || largest || ' alone commands '
    || printf('%.1f', CAST(top_pct AS DECIMAL(38,1)))
    || '% — a sign of structural concentration at the top. The gap between the largest ('
    || largest || ') and smallest (' || smallest || ') allocation is '
    || printf('%.0f', CAST(ratio AS DECIMAL(38,0)))
    || '×, revealing steep tier disparity. Leadership should validate whether this concentration reflects '
    || 'strategic priority or an execution bottleneck before the next cycle.' AS executive_brief
  FROM (SELECT b.department AS largest, s.department AS smallest, groups, g.grand AS total,
               {pct('b.total', 'g.grand')} AS top_pct,
               {dround('CAST(b.total AS DOUBLE) / NULLIF(CAST(s.total AS DOUBLE), 0.0)', 0)} AS ratio
        FROM (SELECT department, total FROM wtot ORDER BY total DESC, department DESC LIMIT 1) b,
             (SELECT department, total FROM wtot ORDER BY total ASC, department ASC LIMIT 1) s,
             (SELECT COUNT(*) AS groups, CAST(SUM(total) AS DECIMAL(38,2)) AS grand FROM wtot) g)"""
define("wtot", "SELECT department, CAST(SUM(amount) AS DECIMAL(38,2)) AS total FROM wclean GROUP BY department",
       "wclean")


@query("m18_workshop_brief", sql(_BRIEF_SQL, "wtot"))
def _m18(c):
    return brief.workshop_brief(c.wclean)


def _ledger_brief_sql(region_id):
    num = lambda c: f"printf('%.1f', CAST({c} AS DECIMAL(38,1)))"
    region = f"'Region {region_id}'"
    summary = (f"'The budget allocates ₱' || printf('%.2f', CAST({dround('CAST(total AS DOUBLE) / 1e12', 2)} "
               f"AS DECIMAL(38,2))) || ' Trillion across ' || CAST(departments AS VARCHAR) || ' departments. "
               f"Fiscal concentration remains high — ' || names || ' account for the majority of national spending. "
               f"Personnel costs (' || {num('ps_pct')} || '%) dominate over infrastructure investment (' "
               f"|| {num('co_pct')} || '%), while ' || {region} || ' absorbs ' || {num('region_pct')} "
               f"|| '% of all regional allocations through centralized agency operations.'")
    h = [f"'Personnel Services at ' || {num('ps_pct')} || '% signals workforce-heavy government structure'",
         f"'Capital Outlays at only ' || {num('co_pct')} || '% constrains long-term asset growth'",
         f"{region} || ' concentration (' || {num('region_pct')} || '%) reflects HQ-centric allocation, not deployment'",
         "'Top 3 departments (' || names || ') drive national fiscal strategy'"]
    rows = [f"SELECT 0 AS line, 'summary' AS kind, {summary} AS text FROM one"]
    rows += [f"SELECT {i}, 'highlight', {t} FROM one" for i, t in enumerate(h, start=1)]
    return f"""SELECT * FROM (WITH one AS (SELECT * FROM
   (SELECT STRING_AGG(department_short, ', ' ORDER BY total_php DESC, department_short) AS names
    FROM (SELECT department_short, total_php FROM agg_department ORDER BY total_php DESC, department_short LIMIT 3)),
   (SELECT CAST(SUM(total_php) AS DECIMAL(38,0)) AS total,
      {pct("SUM(CASE WHEN expense_category = 'PS' THEN total_php ELSE 0 END)", 'SUM(total_php)')} AS ps_pct,
      {pct("SUM(CASE WHEN expense_category = 'CO' THEN total_php ELSE 0 END)", 'SUM(total_php)')} AS co_pct
    FROM agg_expense),
   (SELECT {pct('total_php', '(SELECT SUM(total_php) FROM agg_region)')} AS region_pct
    FROM agg_region WHERE region_id = '{region_id}'),
   (SELECT COUNT(*) AS departments FROM agg_department))
  {' UNION ALL '.join(rows)})"""


@query("m19_ledger_brief", sql(_ledger_brief_sql(FOCUS_REGION), "agg_department", "agg_expense", "agg_region"))
def _m19(c):
    return brief.ledger_brief(c.agg_department, c.agg_expense, c.agg_region, FOCUS_REGION)


@query("t1_m17_department_chart", sql(f"""SELECT department_short, total_php, ps_php, mooe_php, co_php,
    {dround('CAST(ps_php AS DOUBLE) / 1e9', 1)} AS ps_b,
    {dround('CAST(mooe_php AS DOUBLE) / 1e9', 1)} AS mooe_b,
    {dround('CAST(co_php AS DOUBLE) / 1e9', 1)} AS co_b
  FROM agg_department ORDER BY total_php DESC, department_short LIMIT 15""", "agg_department"))
def _t1chart(c):
    from tallyframe.functions.format import billions

    top = explore.top_k(c.agg_department.select("department_short", "total_php", "ps_php", "mooe_php", "co_php"),
                        "total_php", 15, tie=("department_short",))
    return top.select("*", *[billions(k, 1).alias(k.replace("_php", "_b")) for k in ("ps_php", "mooe_php", "co_php")])


@query("m1_j1_regional_distribution", sql(f"""SELECT a.region_id, a.total_php, a.ps_php, a.mooe_php, a.co_php,
    COALESCE(nm.region_name, 'Region ' || a.region_id) AS region_name,
    {pct('a.total_php', 'SUM(a.total_php) OVER ()')} AS pct
  FROM agg_region a LEFT JOIN region_names nm ON a.region_id = nm.region_id""", "agg_region", "region_names"))
def _regdist(c):
    from tallyframe.operators import geo

    rows = c.agg_region.select("region_id", "total_php", "ps_php", "mooe_php", "co_php")
    empty = c.spark.createDataFrame([], "feature string, gtype string, region_id string, region_name string, "
                                        "region_short string")
    named = geo.region_names(rows, empty, geo.names_table(c.spark)).drop("region_short")
    return concentration.share_of_total(named, "total_php")


define("dept_totals", """SELECT department_short AS region_id, total_php FROM agg_department""", "agg_department")


@query("m6_department_bins", sql(_bins_sql("dept_totals", "region_id", DRILL_DEPARTMENT).replace(
    "SELECT region_id, total_php, CAST", "SELECT region_id AS department_short, total_php, CAST", 1),
    "dept_totals"))
def _m6d(c):
    return concentration.quantile_bins(c.agg_department.select("department_short", "total_php"),
                                       "department_short", "total_php", DRILL_DEPARTMENT)




@query("s9_brief_json", f"""SELECT CAST(to_json({{'executive_brief': executive_brief}}) AS VARCHAR) AS value
  FROM ({sql(_BRIEF_SQL, "wtot")})""")
def _s9(c):
    from tallyframe.sources.jsonio import brief_json

    return brief_json(brief.workshop_brief(c.wclean))

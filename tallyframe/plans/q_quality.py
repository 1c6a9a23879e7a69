"""Registered queries: profiling (Q1-Q6, D3) and quality gates (V0-V9)."""

from __future__ import annotations

from tallyframe.functions.categories import EXPENSE_DOMAIN
from tallyframe.operators import gates, profile
from tallyframe.operators.rollup import rollups
from tallyframe.plans.catalog import query
from tallyframe.plans.oracle import define, pct, sql
from tallyframe.session import scratch_path
from tallyframe.sources.parquet import publish

W_COLUMNS = ("id", "department", "agency", "amount", "category", "region")


def _unpivot_sql(expr_of, names, value, extra=""):
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS column_name, {expr_of(n)} AS {value}{extra} FROM wraw"
        for i, n in enumerate(names, start=1))


@query("q1_schema", f"""SELECT CAST(ROW_NUMBER() OVER () AS INTEGER) AS position, column_name,
  CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
       WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS data_type
  FROM (DESCRIBE ({sql("SELECT * FROM wraw", "wraw")}))""")
def _q1(c):
    return profile.schema_listing(c.wraw)


@query("q2_row_count", sql("SELECT COUNT(*) AS rows FROM wraw", "wraw"))
def _q2(c):
    return profile.row_count(c.wraw)


_MISSING = "SUM(list_contains(['', 'N/A', 'NA', 'NULL'], upper(trim(ifnull({c}, ''))))::INT)::BIGINT"


@query("q3_missingness", sql(f"""SELECT position, column_name, missing, total, {pct('missing', 'total')} AS pct
  FROM ({_unpivot_sql(lambda n: _MISSING.format(c=n), W_COLUMNS, 'missing', ', COUNT(*) AS total')})""", "wraw"))
def _q3(c):
    return profile.missingness(c.wraw)


@query("q4_whitespace", sql(_unpivot_sql(lambda n: f"COUNT(*) FILTER (WHERE {n} != TRIM({n}))",
                                         ("department", "category"), "rows"), "wraw"))
def _q4(c):
    return profile.whitespace(c.wraw)


@query("q5_distinct_categories", sql("SELECT DISTINCT category FROM wraw WHERE category IS NOT NULL", "wraw"))
def _q5(c):
    return profile.distinct_values(c.wraw, "category")


@query("q6_non_numeric", sql("""SELECT COUNT(given) - COUNT(TRY_CAST(replace(given, ',', '') AS DOUBLE)) AS bad_amounts
  FROM (SELECT nullif(trim(amount), '') AS given FROM wraw)""", "wraw"))
def _q6(c):
    return profile.non_numeric(c.wraw)


@query("d3_duplicate_count", sql("""SELECT CAST(SUM(CASE WHEN no_department THEN n ELSE n - 1 END) AS BIGINT) AS duplicate_rows
  FROM (SELECT COUNT(*) AS n, department IS NULL AS no_department FROM wraw GROUP BY department IS NULL, lower(trim(department)), lower(trim(ifnull(agency, ''))),
        translate(trim(ifnull(amount, '')), ', ', ''), lower(trim(ifnull(category, ''))))""", "wraw"))
def _d3(c):
    return profile.duplicate_count(c.wraw)


def _chk(gate, name, obs, lo, hi, src):
    return (f"SELECT '{gate}' AS gate, '{name}' AS \"check\", CAST({obs} AS DECIMAL(38,0)) AS observed, "
            f"CAST({lo} AS DECIMAL(38,0)) AS lower, CAST({hi} AS DECIMAL(38,0)) AS upper, "
            f"(({obs}) IS NOT NULL AND (({lo}) IS NULL OR ({obs}) >= ({lo})) "
            f"AND (({hi}) IS NULL OR ({obs}) <= ({hi}))) AS passed FROM {src}")


_V1 = " UNION ALL ".join(_chk("V1", f"{c}: null rows", f"COUNT(*) FILTER (WHERE {c} IS NULL)", 0, 0, "detail")
                         for c in gates.V1_COLUMNS)
_V2_SRC = f"""(SELECT COUNT(*) - COUNT(nullif(greatest(amount_php, 0), 0)) AS np,
    COUNT(*) - SUM((amount_php <= 1e15)::INT) AS imp,
    COUNT(*) - SUM(list_contains({list(EXPENSE_DOMAIN)}, expense_category)::INT) AS bad,
    COUNT(nullif(amount_php - 1000 * amount_thousands, 0)) AS mm FROM detail)"""
_V2 = " UNION ALL ".join([
    _chk("V2", "amounts at or below zero", "np", 0, 0, _V2_SRC),
    _chk("V2", "amounts above the ceiling", "imp", 0, 0, _V2_SRC),
    _chk("V2", "unknown expense categories", "bad", 0, 0, _V2_SRC),
    _chk("V2", "pesos that differ from thousands", "mm", 0, 0, _V2_SRC)])
_V3 = _chk("V3", "repeated rows", "(SELECT COUNT(*) FROM detail) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM detail))",
           0, 0, "(SELECT 1)")
_V4_SRC = """(SELECT * FROM (SELECT SUM(amount_php) AS t, COUNT(*) AS n FROM detail),
   (SELECT SUM(total_php) AS dt, SUM(line_items) AS dn FROM agg_department),
   (SELECT SUM(total_php) AS et FROM agg_expense), (SELECT SUM(total_php) AS agt FROM agg_agency),
   (SELECT SUM(total_php) AS rt FROM agg_region))"""
_V4 = " UNION ALL ".join([
    _chk("V4", "agg_department: total against detail", "dt", "t", "t", _V4_SRC),
    _chk("V4", "agg_expense: total against detail", "et", "t", "t", _V4_SRC),
    _chk("V4", "agg_agency: total against detail", "agt", "t", "t", _V4_SRC),
    _chk("V4", "agg_region: total against detail", "rt", "t", "t", _V4_SRC),
    _chk("V4", "agg_department: rows against detail", "dn", "n", "n", _V4_SRC)])
_A = gates.ANCHORS
_V5_SRC = """(SELECT * FROM (SELECT SUM(amount_php) AS t FROM detail), (SELECT COUNT(*) AS d FROM agg_department),
   (SELECT COUNT(*) AS r FROM agg_region))"""
_V5 = " UNION ALL ".join([
    _chk("V5", "grand total within anchors", "t", *_A["total"], _V5_SRC),
    _chk("V5", "number of departments within anchors", "d", *_A["departments"], _V5_SRC),
    _chk("V5", "number of regions within anchors", "r", *_A["regions"], _V5_SRC)])
_V6 = _chk("V6", "departments whose classes miss the total",
           "COUNT(*) FILTER (WHERE ps_php + mooe_php + co_php + fe_php != total_php)", 0, 0, "agg_department")
_ROLL = ("detail", "agg_department", "agg_expense", "agg_agency", "agg_region")
define("gate_checks", " UNION ALL ".join([_V1, _V2, _V3, _V4, _V5, _V6]), *_ROLL)


@query("v1_completeness", sql(_V1, "detail"))
def _v1(c):
    return gates.completeness(c.detail)


@query("v2_validity", sql(_V2, "detail"))
def _v2(c):
    return gates.validity(c.detail)


@query("v2_amount_range", sql("SELECT MIN(amount_php) AS min_amount, MAX(amount_php) AS max_amount FROM detail",
                              "detail"))
def _v2r(c):
    return gates.amount_range(c.detail)


@query("v3_uniqueness", sql(_V3, "detail"))
def _v3(c):
    return gates.uniqueness(c.detail)


@query("v4_consistency", sql(_V4, *_ROLL))
def _v4(c):
    return gates.consistency(c.stored, c.agg)


@query("v5_anchors", sql(_V5, "detail", "agg_department", "agg_region"))
def _v5(c):
    return gates.anchors(c.stored, c.agg_department, c.agg_region)


@query("v6_split_integrity", sql(_V6, "agg_department"))
def _v6(c):
    return gates.split_integrity(c.agg_department)


@query("v7_verdict", sql("""SELECT COUNT(*) FILTER (WHERE passed) AS passed,
    COUNT(*) FILTER (WHERE NOT passed) AS failed,
    COALESCE(array_to_string(list_sort(list(gate || ': ' || "check") FILTER (WHERE NOT passed)), '; '), '')
      AS failures
  FROM gate_checks""", "gate_checks"))
def _v7(c):
    return gates.verdict(gates.all_gates(c.stored, c.agg))


@query("v0_files_readable", """SELECT 'V0' AS gate, name || ' exists' AS "check", CAST(1 AS DECIMAL(38,0)) AS observed,
    CAST(1 AS DECIMAL(38,0)) AS lower, CAST(1 AS DECIMAL(38,0)) AS upper, true AS passed
  FROM (VALUES ('budget_detail'), ('agg_department'), ('agg_expense'), ('agg_agency'), ('agg_region')) AS v(name)""")
def _v0(c):
    root = scratch_path(c.spark, "published")
    paths = publish({"budget_detail": c.detail}, root)
    written = c.spark.read.schema(c.detail.schema).parquet(paths["budget_detail"])
    paths |= publish(rollups(written), root)
    return gates.files_readable(c.spark, paths)


@query("v0_missing_file", """SELECT 'V0' AS gate, name || ' exists' AS "check", CAST(there AS DECIMAL(38,0)) AS observed,
    CAST(1 AS DECIMAL(38,0)) AS lower, CAST(1 AS DECIMAL(38,0)) AS upper, there = 1 AS passed
  FROM (VALUES ('agg_region', 1), ('agg_expense', 1), ('agg_nowhere', 0), ('broken', 0)) AS v(name, there)""")
def _v0m(c):
    """Two published files, one that is not there and one that is not Parquet."""
    root = scratch_path(c.spark, "published-in-part")
    paths = publish({"agg_region": c.agg_region, "agg_expense": c.agg_expense}, root)
    c.agg_expense.select("expense_category").write.text(f"{root}/broken.parquet")
    return gates.files_readable(c.spark, {**paths, "agg_nowhere": f"{root}/agg_nowhere.parquet", "broken": f"{root}/broken.parquet"})


@query("v8_pre_export", sql(" UNION ALL ".join([
    _chk("V8", "zero nulls in core fields", " + ".join(
        f"COUNT(*) FILTER (WHERE {k} IS NULL)" for k in W_COLUMNS), 0, 0, "wclean"),
    _chk("V8", "row count within [1, raw rows]", "COUNT(*)", 1, "(SELECT COUNT(*) FROM wraw)", "wclean"),
    _chk("V8", "all amounts non-negative", "COUNT(*) FILTER (WHERE amount < 0)", 0, 0, "wclean")]),
    "wraw", "wclean"))
def _v8(c):
    return gates.pre_export(c.wclean, c.wraw)


@query("v9_round_trip", sql("""SELECT COUNT(*) AS rows, CAST(SUM(amount) AS DECIMAL(38,2)) AS total,
    COUNT(*) AS rows_before, CAST(SUM(amount) AS DECIMAL(38,2)) AS total_before, true AS matches
  FROM wclean""", "wclean"))
def _v9(c):
    return gates.round_trip(c.wclean, scratch_path(c.spark, "cleaned_dataset"))

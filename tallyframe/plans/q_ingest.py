"""Registered queries: sources, cleaning, roll-ups (S, P, D, A1-A5)."""

from __future__ import annotations

from tallyframe.operators import clean, rollup
from tallyframe.plans.catalog import query
from tallyframe.plans.oracle import sql
from tallyframe.sources.parquet import ingest_stage_counts


@query("s2_raw_ledger", sql("SELECT * FROM raw", "raw"))
def _s2(c):
    return c.raw


@query("p1_budget_detail", sql("SELECT * FROM detail", "detail"))
def _p1(c):
    return c.detail


@query("a1_agg_department", sql("SELECT * FROM agg_department", "agg_department"))
def _a1(c):
    return c.agg_department


@query("a2_agg_expense", sql("SELECT * FROM agg_expense", "agg_expense"))
def _a2(c):
    return c.agg_expense


@query("a3_agg_agency", sql("SELECT * FROM agg_agency", "agg_agency"))
def _a3(c):
    return c.agg_agency


@query("a4_agg_region", sql("SELECT * FROM agg_region", "agg_region"))
def _a4(c):
    return c.agg_region


@query("a5_grand_total", sql("SELECT CAST(SUM(amount_php) AS DECIMAL(38,0)) AS grand_total FROM detail", "detail"))
def _a5(c):
    return rollup.grand_total(c.detail)


@query("p6_workshop_staged", sql("SELECT * FROM wstaged", "wstaged"))
def _p6(c):
    return c.wstaged


@query("d2_workshop_cleaned", sql("SELECT * FROM wclean", "wclean"))
def _d2(c):
    return c.wclean


@query("d4_ingest_removed", sql("""SELECT *, before_rows - after_rows AS removed_rows
  FROM (SELECT count(kilo) AS before_rows FROM parsed), (SELECT count(*) AS after_rows FROM detail)""", "parsed", "detail"))
def _d4(c):
    return clean.ingest_removed(c.raw)


@query("d4_workshop_removed", sql("""SELECT (SELECT COUNT(*) FROM wraw) AS before_rows,
  (SELECT COUNT(*) FROM wclean) AS after_rows,
  (SELECT COUNT(*) FROM wraw) - (SELECT COUNT(*) FROM wclean) AS removed_rows""", "wraw", "wclean"))
def _d4w(c):
    return clean.keyed_removed(c.wstaged)


@query("s11_stage_counts", sql("""
SELECT 'raw' AS stage, COUNT(*) AS rows FROM raw
UNION ALL SELECT 'cleaned', COUNT(*) FROM detail
UNION ALL SELECT 'final', COUNT(*) FROM detail
UNION ALL SELECT 'removed', (SELECT count(kilo) FROM parsed) - count(*) FROM detail
UNION ALL SELECT 'agg_department', COUNT(*) FROM agg_department
UNION ALL SELECT 'agg_expense', COUNT(*) FROM agg_expense
UNION ALL SELECT 'agg_agency', COUNT(*) FROM agg_agency
UNION ALL SELECT 'agg_region', COUNT(*) FROM agg_region""",
    "parsed", "detail", "agg_department", "agg_expense", "agg_agency", "agg_region"))
def _s11(c):
    groups = c.ingested
    c.stored                                     # the roll-ups read it too, unless they are made
    return ingest_stage_counts(clean.counts_of(groups), c.agg)


# ---------------------------------------------------------------- A19 on events

_A19 = """SELECT event_type, n AS runs,
    CASE WHEN n % 2 = 1 THEN MAX(CASE WHEN i = n // 2 THEN value END)
         ELSE (MAX(CASE WHEN i = n // 2 - 1 THEN value END) + MAX(CASE WHEN i = n // 2 THEN value END)) / 2.0
    END AS median_value,
    MAX(value) AS max_value
  FROM (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
               COUNT(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
  GROUP BY event_type, n"""


@query("a19_measurement_stats", f"SELECT *, median_value < 100.0 AS passed FROM ({_A19})")
def _a19(c):
    from tallyframe.operators import measure

    return measure.measurement_stats(c.t["events"], "event_type", "value")


@query("a19_median_of_medians", f"""SELECT n AS groups,
    CASE WHEN n % 2 = 1 THEN MAX(CASE WHEN i = n // 2 THEN median_value END)
         ELSE (MAX(CASE WHEN i = n // 2 - 1 THEN median_value END) + MAX(CASE WHEN i = n // 2 THEN median_value END)) / 2.0
    END AS median_of_medians,
    median_of_medians < 100.0 AS overall_passed, BOOL_AND(median_value < 100.0) AS all_passed
  FROM (SELECT median_value, ROW_NUMBER() OVER (ORDER BY median_value) - 1 AS i, COUNT(*) OVER () AS n
        FROM ({_A19}))
  GROUP BY n""")
def _a19b(c):
    from tallyframe.operators import measure

    return measure.overall(measure.measurement_stats(c.t["events"], "event_type", "value"))


# ---------------------------------------------------------------- S1 / S8 / S9

@query("s1_csv_scan", sql("""SELECT NULLIF(id, '') AS id, NULLIF(department, '') AS department,
    NULLIF(agency, '') AS agency, NULLIF(amount, '') AS amount, NULLIF(category, '') AS category,
    NULLIF(region, '') AS region FROM wraw""", "wraw"))
def _s1(c):
    from tallyframe.session import scratch_path
    from tallyframe.sources.text import read_csv_text

    path = scratch_path(c.spark, "raw_dataset_csv")
    (c.wraw.withColumnRenamed("amount", "  amount ").write.mode("overwrite")
     .option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_csv_text(c.spark, path)


@query("s1_csv_quoted", """SELECT CAST(o_orderkey AS VARCHAR) AS id,
    'a "' || o_orderpriority || '", b' AS note, o_orderstatus || chr(10) || 'x' AS lines FROM orders""")
def _s1q(c):
    """Cells with quotes, commas and line breaks, as any CSV writer quotes them."""
    from pyspark.sql import functions as F

    from tallyframe.session import scratch_path
    from tallyframe.sources.text import read_csv_text

    path = scratch_path(c.spark, "quoted_csv")
    (c.t["orders"].select(F.col("o_orderkey").cast("string").alias("id"),
                          F.concat(F.lit('a "'), "o_orderpriority", F.lit('", b')).alias(" note"),
                          F.concat("o_orderstatus", F.lit("\nx")).alias("lines"))
     .write.option("header", True).option("escape", '"').csv(path))
    return read_csv_text(c.spark, path, multiline=True)


@query("s8_series_json", sql("""SELECT department, CAST(total AS DOUBLE) AS total FROM (
  SELECT department, CAST(SUM(amount) AS DECIMAL(38,2)) AS total FROM wclean
  GROUP BY department ORDER BY total DESC, department LIMIT 10)""", "wclean"))
def _s8(c):
    from tallyframe.operators import explore
    from tallyframe.session import scratch_path
    from tallyframe.sources.jsonio import write_series

    path = write_series(explore.totals_by(c.wclean, "department", k=10), scratch_path(c.spark, "layer1"))
    return c.spark.read.json(path)


# ---------------------------------------------------------------- S4: SQL over registered views

@query("s4_sql_views", sql("""SELECT region_id, line_items, total_php FROM agg_region
  WHERE total_php > (SELECT AVG(total_php) FROM agg_region)""", "agg_region"))
def _s4(c):
    from tallyframe.sources.tables import register_views

    register_views(c.spark, {"tally_budget_detail": c.detail, "tally_agg_region": c.agg_region})
    return c.spark.sql("""SELECT region_id, line_items, total_php FROM tally_agg_region
                          WHERE total_php > (SELECT AVG(total_php) FROM tally_agg_region)""")

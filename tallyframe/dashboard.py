"""The dashboard's questions over a published folder, as DataFrame methods.

    d = Dashboard(spark, "/data/published")       # budget_detail, four roll-ups, lattice
    d.kpis().show(); d.line_items(page_no=2, search="school", category="PS").show()

Each method composes the operators (no new logic); everything stays lazy
and is planned by Catalyst. Roll-ups are small and may be cached
(``cache_rollups=True``); the detail is always a parquet scan (partitioned by
expense category when published by ``jobs.ingest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import brief, concentration, explore, geo, lattice, rollup

ROLLUPS = ("agg_department", "agg_expense", "agg_agency", "agg_region")


class Dashboard:
    def __init__(self, spark: SparkSession, root: str, cache_rollups: bool = False):
        self.spark = spark
        self.detail = spark.read.parquet(f"{root}/budget_detail.parquet")
        self.agg = {t: spark.read.parquet(f"{root}/{t}.parquet") for t in ROLLUPS}
        self.totals = lattice.load(self.detail, f"{root}/lattice", rollup.LEDGER_DIMENSIONS, rollup.LEDGER_MEASURES)
        if cache_rollups:
            self.agg = {t: df.cache() for t, df in self.agg.items()}

    # operational view
    def kpis(self) -> DataFrame:
        return brief.kpis(self.agg["agg_department"])

    def top_departments(self, k: int = 10) -> DataFrame:
        return explore.top_k(self.agg["agg_department"], "total_php", k, tie=("department_code", "department_name"))

    def expense_breakdown(self) -> DataFrame:
        return concentration.share_of_total(self.agg["agg_expense"], "total_php")

    def capital_outlay_rate(self) -> DataFrame:
        return brief.category_shares(self.agg["agg_expense"], ("CO",))

    def drill_down(self, department_short: str) -> DataFrame:
        return explore.drill_down(self.agg["agg_agency"], department_short)

    def agency_pivot(self, department_short: str, k: int = 15) -> DataFrame:
        return concentration.pivot_top(self.agg["agg_agency"], department_short, k)

    def agency_chart(self, department_short: str, k: int = 15) -> DataFrame:
        return concentration.pivot_chart(self.agency_pivot(department_short, k))

    # line items
    def line_items(self, page_no: int = 0, search: str | None = None, category: str | None = None,
                   order_by: str = "amount_php", desc: bool = True) -> DataFrame:
        return explore.page(self.detail, order_by, desc, page_no, filters={"expense_category": category},
                            text=search)

    def line_item_count(self, search: str | None = None, category: str | None = None) -> DataFrame:
        return explore.filtered_count(self.totals, {"expense_category": category}, text=search)

    # executive view
    def brief(self, region_id: str, region_label: str | None = None) -> DataFrame:
        return brief.ledger_brief(self.agg["agg_department"], self.agg["agg_expense"], self.agg["agg_region"],
                                  region_id, region_label)

    def special_funds(self, exclude: str, k: int = 15) -> DataFrame:
        return explore.special_funds(self.totals, exclude, k)

    def tiers(self) -> DataFrame:
        return concentration.tiers(self.agg["agg_department"], "department_short", "total_php")

    def gini(self) -> DataFrame:
        return concentration.gini(self.agg["agg_department"], "total_php", "department_short")

    # regional view
    def regions(self, feature_props: DataFrame | None = None) -> DataFrame:
        props = feature_props if feature_props is not None else self.spark.createDataFrame(
            [], "feature string, gtype string, region_id string, region_name string, region_short string")
        named = geo.region_names(self.agg["agg_region"], props, geo.names_table(self.spark))
        ranked = concentration.rank_by(named, "total_php", tie=("region_id",))
        return concentration.share_of_total(ranked, "total_php", out="pct_of_national", digits=2)

    def region_bins(self, outlier_region: str) -> DataFrame:
        return concentration.quantile_bins(self.agg["agg_region"], "region_id", "total_php", outlier_region)

    def region_leader(self) -> DataFrame:
        return concentration.leader_gap(self.agg["agg_region"], "region_id", "total_php")

    def region(self, region_id: str) -> DataFrame:
        return concentration.split_shares(concentration.point_lookup(self.agg["agg_region"], "region_id", region_id))

    def distinct(self, column: str) -> DataFrame:
        return explore.distinct_options(self.totals, column)

    def value_of(self, df: DataFrame, column: str):
        """Convenience for scripts: the single value of a one-row result (collects one row)."""
        return df.select(F.col(column)).first()[0]


class WorkshopView:
    """The workshop dashboard over a cleaned dataset: options, grouped totals, counts, drill-downs.

    ``lattice_path``: the dataset's lattice as ``jobs.workshop`` writes it; without one the dataset answers.
    """

    def __init__(self, spark: SparkSession, path: str, lattice_path: str | None = None):
        self.data = spark.read.parquet(path)
        self.totals = self.data if lattice_path is None else lattice.load(
            self.data, lattice_path, rollup.WORKSHOP_DIMENSIONS, rollup.WORKSHOP_MEASURES)

    def options(self, column: str) -> DataFrame:
        return explore.distinct_options(self.totals, column)

    def group(self, dim: str = "department", region: str = explore.ALL, category: str = explore.ALL,
              k: int = 20) -> DataFrame:
        return explore.dynamic_group(self.totals, dim, region, category, k)

    def count(self, region: str = explore.ALL, category: str = explore.ALL) -> DataFrame:
        return explore.filtered_count(self.totals, {"region": region, "category": category})

    def brief(self) -> DataFrame:
        return brief.workshop_brief(self.data)

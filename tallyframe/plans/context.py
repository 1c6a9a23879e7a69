"""Per-(session, data folder) lazy frames shared by the registered queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tallyframe.operators import clean, explore, lattice, pages, postings, rollup
from tallyframe.plans import ledger
from tallyframe.session import scratch_path
from tallyframe.sources.parquet import write_parquet
from tallyframe.sources.tables import Tables


class Ledger:
    """Lazy DataFrames: raw text ledger -> detail -> roll-ups; workshop raw -> cleaned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)

    @cached_property
    def raw(self) -> DataFrame:
        return ledger.raw_ledger(self.t)

    @cached_property
    def detail(self) -> DataFrame:
        return clean.ingest(self.raw)

    @cached_property
    def ingested(self) -> DataFrame:
        """The detail's distinct rows with their counts, in the shared scratch folder: for queries that read them twice."""
        groups = clean.ingest_groups(self.raw)
        path = write_parquet(groups, scratch_path(self.spark, "ingested"))
        return self.spark.read.schema(groups.schema).parquet(path)

    @cached_property
    def stored(self) -> DataFrame:
        """``detail`` as stored."""
        return clean.detail_of(self.ingested)

    @cached_property
    def agg(self) -> dict[str, DataFrame]:
        return rollup.rollups(self.stored if "stored" in self.__dict__ else self.detail)

    @property
    def agg_department(self) -> DataFrame:
        return self.agg["agg_department"]

    @property
    def agg_expense(self) -> DataFrame:
        return self.agg["agg_expense"]

    @property
    def agg_agency(self) -> DataFrame:
        return self.agg["agg_agency"]

    @property
    def agg_region(self) -> DataFrame:
        return self.agg["agg_region"]

    @cached_property
    def wraw(self) -> DataFrame:
        return ledger.workshop_raw(self.t)

    @cached_property
    def wstaged(self) -> DataFrame:
        return clean.stage(self.wraw)

    @cached_property
    def wclean(self) -> DataFrame:
        return clean.dedup_keyed(clean.dealt(self.wstaged, self.t["lineitem"].count()))

    @cached_property
    def wlattice(self) -> lattice.Lattice:
        """Totals of the cleaned workshop table at every useful grain, in the shared scratch folder."""
        return lattice.build(self.wclean, scratch_path(self.spark, "workshop-lattice"),
                             rollup.WORKSHOP_DIMENSIONS, rollup.WORKSHOP_MEASURES)

    @cached_property
    def lattice(self) -> lattice.Lattice:
        """Totals of the detail at every useful grain, in the shared scratch folder."""
        return lattice.build(self.detail, scratch_path(self.spark, "ledger-lattice"),
                             rollup.LEDGER_DIMENSIONS, rollup.LEDGER_MEASURES)

    @cached_property
    def page_rows(self) -> DataFrame:
        """The displayed columns of the line items as stored in the shared scratch folder."""
        columns = self.detail.select("amount_php", *explore.PAGE_TIES)
        path = write_parquet(columns, scratch_path(self.spark, "page-rows"), "zstd")
        return self.spark.read.schema(columns.schema).parquet(path)

    @cached_property
    def amount_pages(self) -> pages.PageIndex:
        """Where the pages by amount of the stored line items start."""
        return pages.build(self.page_rows, scratch_path(self.spark, "amount-pages"), "amount_php", explore.PAGE_TIES)

    @cached_property
    def postings(self) -> postings.Postings:
        """The searched columns of the line items as stored in the shared scratch folder, with their trigrams."""
        return postings.build(self.detail.select(*explore.SEARCH_COLUMNS, "amount_php"),
                              scratch_path(self.spark, "search-postings"))

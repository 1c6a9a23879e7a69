"""The roll-up lattice: routes, exactness against the detail, fall-back, and frames that follow changed files."""

import random
import shutil
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import explore, lattice
from tallyframe.plans.catalog import context
from tests.conftest import SF001
from tests.test_plans import plan

DIMS = ("department", "agency", "category", "region")


@pytest.fixture(scope="module")
def detail(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(4000):
        agency = rnd.randrange(40)
        rows.append((f"D{agency % 7}" if agency else None, f"A{agency}", rnd.choice(["PS", "MOOE", "CO", None]),
                     rnd.choice(["N", "S", ""]), i, rnd.randrange(10 ** 6) / 100))
    return spark.createDataFrame(rows, "department string, agency string, category string, region string, id long, a double").select(
        *DIMS, "id", F.col("a").cast("decimal(18,2)").alias("amount")).cache()


@pytest.fixture(scope="module")
def built(spark, detail, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lattice"))
    lattice.build(detail.limit(10), root, DIMS, {"amount": "decimal(38,2)"})          # a rebuild replaces all of it
    lattice.build(detail, root, DIMS, {"amount": "decimal(38,2)"})
    return lattice.load(detail, root, DIMS, {"amount": "decimal(38,2)"})


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def direct(detail, group, filters):
    rows = explore.equality_filter(detail, filters)
    return result(rows.groupBy(*group).agg(F.count(F.lit(1)), F.sum("amount").cast("decimal(38,2)")))


def test_every_question_equals_the_detail(built, detail):
    values = {"department": "D3", "agency": "A5", "category": "CO", "region": ""}
    for n in range(3):
        for group in combinations(DIMS, n):
            for m in range(3):
                for by in combinations(DIMS, m):
                    filters = {c: values[c] for c in by}
                    got = built.totals(group, filters)
                    if not group and filters and not direct(detail, (), filters)[0][0]:
                        assert got.first()[0] in (None, 0)
                        continue
                    assert result(got) == direct(detail, group, filters), (group, filters)


def test_the_smallest_covering_grain_is_read(built):
    sizes = {g: built.sizes[g] for g in built.kept}
    assert built.kept[0] == DIMS and () in sizes and ("region",) in sizes
    for n in range(5):
        for columns in combinations(DIMS, n):
            g = built.route(columns)
            assert set(columns) <= set(g)
            assert sizes[g] == min(s for k, s in sizes.items() if set(columns) <= set(k))
    assert built.route({"region", "id"}) is None


def test_groups_that_are_rows_need_no_shuffle(built):
    assert "Exchange" not in plan(built.totals(["region"]))
    # an agency has one department, so agency x region rows stand for agency x department x region too
    assert built.sizes[("department", "agency", "region")] == built.sizes[("agency", "region")]
    assert "Exchange" not in plan(built.totals(["agency"], {"region": "N"}))
    assert "Exchange" in plan(built.totals(["department"], where=F.col("region") != "N", where_columns=["region"]))


def test_an_uncovered_question_reads_the_detail(built, detail):
    got = built.totals(["id"], {"region": "N"})
    assert result(got) == direct(detail, ["id"], {"region": "N"})
    assert built.root not in plan(got)
    assert result(explore.totals_by(built, "id", k=3)) == result(explore.totals_by(detail, "id", k=3))


def test_answers_of_the_operators(built, detail):
    for filters in ({}, {"region": "N"}, {"region": "All", "category": "CO"}, {"region": "nowhere"}):
        assert result(explore.totals_by(built, "agency", filters=filters)) == result(explore.totals_by(detail, "agency", filters=filters))
        assert result(explore.filtered_count(built, filters)) == result(explore.filtered_count(detail, filters))
        assert result(explore.total(built, filters)) == result(explore.total(detail, filters))
    assert result(explore.distinct_options(built, "department")) == result(explore.distinct_options(detail, "department"))
    assert explore.totals_by(built, "region").schema == explore.totals_by(detail, "region").schema


def test_an_empty_table(detail, tmp_path):
    empty = lattice.build(detail.limit(0), str(tmp_path / "none"), DIMS, {"amount": "decimal(38,2)"})
    assert empty.kept == [DIMS] and empty.totals(["region"]).count() == 0
    assert result(explore.filtered_count(empty)) == [(0, 0)]


def test_a_rewritten_table_gives_new_totals(spark, tmp_path):
    folder = str(tmp_path / "tables")
    shutil.copytree(SF001, folder)
    from pyspark.sql import functions as F

    def totals():
        c = context(spark, folder)
        return c.agg_department.agg(F.sum("line_items")).first()[0], explore.total(c.wlattice).first()[0]

    before = totals()
    assert context(spark, folder) is context(spark, folder)
    half = spark.read.parquet(f"{SF001}/lineitem.parquet").where("l_orderkey % 2 = 0")
    half.write.mode("overwrite").parquet(str(tmp_path / "half"))
    (tmp_path / "tables" / "lineitem.parquet").chmod(0o644)
    half.toPandas().to_parquet(f"{folder}/lineitem.parquet", coerce_timestamps="us")
    after = totals()
    assert after[0] < before[0] and after[1] < before[1]

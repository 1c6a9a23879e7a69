"""Pages by the boundary index, against sorting all rows."""

import pytest

from tallyframe.operators import explore, pages, selection


def rows_of(spark):
    """Repeated rows over block edges, a value that a third of the rows share, nulls in every column."""
    return spark.range(0, 3000, 1, 5).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 500 WHEN id % 50 = 1 THEN NULL ELSE pmod(xxhash64(id), 900) END AS v",
        "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 11) END AS k", "CASE WHEN id % 6 = 0 THEN 'x' END AS m", "id")


@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("every", [3, 40, 10_000])
def test_pages_equal_slices_of_the_sorted_rows(spark, tmp_path, desc, every):
    df = rows_of(spark).cache()
    index = pages.build(df, str(tmp_path / "index"), "v", ("k", "m"), desc, every)
    sign = -1 if desc else 1
    want = sorted(((r.v, r.k, r.m) for r in df.collect()),
                  key=lambda r: (r[0] is None, sign * (r[0] or 0), r[1] is None, r[1] or "", r[2] is None, r[2] or ""))
    for number, size in [(0, 10), (3, 10), (17, 60), (299, 10), (300, 10), (42, 70), (0, 3000), (1, 2999), (9999, 50)]:
        got = [(r.v, r.k, r.m) for r in index.page(number, size).collect()]
        assert got == want[number * size:(number + 1) * size]


def test_blocks_count_all_rows(spark, tmp_path):
    df = rows_of(spark)
    index = pages.build(df, str(tmp_path / "index"), "v", ("k", "m"), True, 4)
    blocks = sorted(index.blocks.collect(), key=lambda r: r.block)
    assert [b.before for b in blocks] == [sum(x.n for x in blocks[:i]) for i in range(len(blocks))]
    assert sum(b.n for b in blocks) == 3000 and max(b.n for b in blocks) > 4      # copies don't make blocks


def test_empty_table(spark, tmp_path):
    index = pages.build(rows_of(spark).where("id < 0"), str(tmp_path / "index"), "v", ("k", "m"))
    assert index.page(0).collect() == [] and index.page(5).columns == ["v", "k", "m"]


def test_the_plan_holds_no_heap_of_the_page_number(spark, tmp_path):
    spark.range(0, 50_000, 1, 4).selectExpr("id * 7 % 50000 AS v", "'a' AS k").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    index = pages.build(df, str(tmp_path / "index"), "v", ("k",), every=1000)
    out = index.page(45_000, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=" in plan
    assert int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) <= 1001
    assert "LessThanOrEqual(v,4999)" in plan and "GreaterThanOrEqual(v,3999)" in plan
    assert out.first().v == 4999 == explore.page_after(df, "v", (5000, "a"), 1, True, ("k",)).first().v


def test_keys_are_counted_once_before_they_are_numbered(spark, tmp_path, monkeypatch):
    numbered = []

    def row_numbers(df, *args, **named):
        numbered.append(df)
        return selection.row_numbers(df, *args, **named)

    monkeypatch.setattr(pages, "row_numbers", row_numbers)
    pages.build(rows_of(spark), str(tmp_path / "index"), "v", ("k", "m"))
    plan = numbered[0]._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan, plan
    want = rows_of(spark).groupBy("v", "k", "m").count()
    assert sorted(map(tuple, numbered[0].collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

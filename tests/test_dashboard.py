"""The dashboard facade over a published folder."""

import pytest

from tallyframe import jobs
from tallyframe.dashboard import Dashboard
from tallyframe.plans.context import Ledger
from tests.conftest import SF001


@pytest.fixture(scope="module")
def dash(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pub")
    raw = str(out / "raw.parquet")
    Ledger(spark, SF001).raw.write.parquet(raw)
    jobs.ingest(spark, raw, str(out / "data"))
    return Dashboard(spark, str(out / "data"), cache_rollups=True)


def test_views(dash):
    k = dash.kpis().first()
    assert k.department_count == dash.agg["agg_department"].count()
    assert len(dash.top_departments(3).collect()) == 3
    assert dash.line_items(page_no=0, category="PS").count() == 50
    n = dash.line_item_count(category="PS").first()
    assert n.pages == -(-n.rows // 50)
    assert {r.expense_category for r in dash.line_items(category="CO").collect()} == {"CO"}
    assert abs(sum(r.pct for r in dash.expense_breakdown().collect()) - 100) < 0.5
    reg = dash.regions().collect()
    assert sorted(r["rank"] for r in reg) == list(range(1, len(reg) + 1))
    assert dash.brief("01", "Region 01").count() == 5
    assert dash.value_of(dash.gini(), "gini") > 0
    assert dash.region("01").first().ps_pct is not None


def test_workshop_view(spark, tmp_path):
    from tallyframe.dashboard import WorkshopView
    from tests.test_workshop_golden import RAW_CSV
    csv = tmp_path / "raw.csv"
    csv.write_text(RAW_CSV)
    jobs.workshop(spark, str(csv), str(tmp_path / "w"))
    w = WorkshopView(spark, str(tmp_path / "w/cleaned_dataset.parquet"))
    assert [r.region for r in w.options("region").collect()] == [
        "NCR", "REGION II", "REGION III", "REGION VII", "UNASSIGNED"]
    top = w.group("agency", region="NCR", category="Personnel Services").collect()
    assert top[0].label == "Philippine National Police"
    assert w.count(region="NCR").first().rows == 5   # ids 1, 2, 7, 13, 15

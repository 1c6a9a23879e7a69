"""The batch jobs run end to end (ingest -> validate; workshop chain)."""

import json

import pytest

from tallyframe import jobs
from tallyframe.operators import gates
from tallyframe.plans.context import Ledger
from tests.conftest import SF001
from tests.test_workshop_golden import RAW_CSV


def test_ingest_then_validate(spark, tmp_path):
    raw_path = str(tmp_path / "raw.parquet")
    Ledger(spark, SF001).raw.write.parquet(raw_path)
    paths = jobs.ingest(spark, raw_path, str(tmp_path / "out"))
    assert set(paths) == set(jobs.TABLES)
    # the test ledger is not the real budget: anchors (V5) and NULL agencies (V1) fail
    with pytest.raises(gates.GateFailure, match="V5"):
        jobs.validate(spark, str(tmp_path / "out"))


def test_workshop_job_writes_charts_and_brief(spark, tmp_path):
    csv = tmp_path / "raw.csv"
    csv.write_text(RAW_CSV)
    jobs.workshop(spark, str(csv), str(tmp_path / "w"))
    brief = [json.loads(line) for p in (tmp_path / "w/charts/layer5_brief").glob("part-*")
             for line in p.read_text().splitlines()]
    assert brief[0]["executive_brief"].startswith("The portfolio totals ₱156.8M across 7 departments")
    layer1 = [json.loads(line) for p in (tmp_path / "w/charts/layer1_top_allocations").glob("part-*")
              for line in p.read_text().splitlines()]
    assert {r["department"] for r in layer1} == {"DILG", "BSGC", "DEPED", "DPWH", "DSWD", "DOH", "DA"}


def test_cli_audit_and_exit_codes(spark, tmp_path, capsys):
    csv = tmp_path / "raw.csv"
    csv.write_text(RAW_CSV)
    assert jobs.main(["audit", "--csv", str(csv)]) == 0
    assert "duplicate_rows" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        jobs.main(["nope"])


def test_regions_job(spark, tmp_path, capsys):
    from tests.test_geo import circle
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"REGION": "Metropolitan Manila"},
         "geometry": {"type": "Polygon", "coordinates": [circle(121.0, 14.6, 0.3)]}},
        {"type": "Feature", "properties": {"REGION": "Nowhere"},
         "geometry": {"type": "Polygon", "coordinates": [circle(0.0, 0.0, 1.0, 100)]}}]}
    src = tmp_path / "in.geojson"
    src.write_text(json.dumps(fc))
    jobs.regions(spark, str(src), str(tmp_path / "out"))
    out = capsys.readouterr().out
    assert "Nowhere" in out
    docs = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out/regions").glob("part-*"))))["features"]
    assert [d["properties"]["region_short"] for d in docs] == ["NCR"]

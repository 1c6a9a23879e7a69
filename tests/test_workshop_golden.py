"""The workshop chain on the reference's 15-row dirty CSV reproduces its goldens."""

from decimal import Decimal

import pytest

from tallyframe.operators import brief, clean, explore, gates, profile
from tallyframe.sources.text import read_csv_text

# The reference's 15-row dirty CSV fixture.
RAW_CSV = '''id,department,agency,  amount ,category,region
1,  DepEd ,Office of the Secretary,"1,250,000",Personnel Services,NCR
2,deped,Office of the Secretary,980000,personnel services,ncr
3,DPWH,Bureau of Design ,"2,400,000.50",Capital Outlays,Region III
4,DPWH,Bureau of Design,2400000.50,capital outlays,region iii
5,DOH,,750000,MOOE,Region VII
6,DOH,Center for Health,,mooe,Region VII
7,  DILG,Philippine National Police,"89,109,122",Personnel Services,NCR
8,DILG,Philippine National Police,89109122,PERSONNEL SERVICES,ncr
9,DSWD,Office of the Secretary,"1,500,000",Capital Outlays,
10,DSWD ,Office of the Secretary,1500000,Capital Outlays,Region IV-A
11,DA,Bureau of Fisheries,N/A,MOOE,Region II
12,DA,Bureau of Fisheries,320000,mooe,region ii
13,DepEd,,450000,,NCR
14,DepEd,Office of the Secretary,"1,250,000",Personnel Services,NCR
15,BSGC,PhilHealth,"60,000,000",MOOE,NCR
'''


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("csv") / "raw_dataset.csv"
    p.write_text(RAW_CSV)
    return read_csv_text(spark, str(p))


@pytest.fixture(scope="module")
def cleaned(raw):
    return clean.clean_workshop(raw).cache()


def totals(df, dim):
    return {r[0]: r[1] for r in explore.totals_by(df, dim).collect()}


def test_header_trimmed_and_all_text(raw):
    assert raw.columns == ["id", "department", "agency", "amount", "category", "region"]
    assert {t for _, t in raw.dtypes} == {"string"}


def test_cleaned_rows(cleaned):
    assert sorted(r.id for r in cleaned.collect()) == [1, 2, 3, 5, 6, 7, 9, 11, 12, 13, 15]
    assert dict(cleaned.dtypes) == {"id": "bigint", "department": "string", "agency": "string",
                                    "amount": "decimal(18,2)", "category": "string", "region": "string"}
    row9 = cleaned.where("id = 9").first()
    assert row9.region == "UNASSIGNED"
    assert cleaned.where("id = 11").first().amount == Decimal("0.00")
    assert cleaned.where("id = 13").first().category == "Uncategorized"
    assert cleaned.where("id = 5").first().agency == "Unspecified Agency"


def test_golden_series(cleaned):
    assert totals(cleaned, "department") == {
        "DILG": Decimal("89109122.00"), "BSGC": Decimal("60000000.00"), "DEPED": Decimal("2680000.00"),
        "DPWH": Decimal("2400000.50"), "DSWD": Decimal("1500000.00"), "DOH": Decimal("750000.00"),
        "DA": Decimal("320000.00")}
    assert totals(cleaned, "category") == {
        "Personnel Services": Decimal("91339122.00"), "MOOE": Decimal("61070000.00"),
        "Capital Outlays": Decimal("3900000.50"), "Uncategorized": Decimal("450000.00")}
    assert totals(cleaned, "region") == {
        "NCR": Decimal("151789122.00"), "REGION III": Decimal("2400000.50"), "UNASSIGNED": Decimal("1500000.00"),
        "REGION VII": Decimal("750000.00"), "REGION II": Decimal("320000.00")}
    co = explore.totals_by(cleaned, "agency", k=10, filters={"category": "Capital Outlays"}).collect()
    assert [(r.agency, r.total) for r in co] == [("Bureau of Design", Decimal("2400000.50")),
                                                ("Office of the Secretary", Decimal("1500000.00"))]
    top = explore.totals_by(cleaned, "department", k=10)
    assert [r.department for r in explore.for_display(top, "total", ("department",)).collect()] == [
        "DA", "DOH", "DSWD", "DPWH", "DEPED", "BSGC", "DILG"]
    assert cleaned.agg({"amount": "sum"}).first()[0] == Decimal("156759122.50")


def test_golden_brief(cleaned):
    text = brief.workshop_brief(cleaned).first().executive_brief
    assert text == (
        "The portfolio totals ₱156.8M across 7 departments, but DILG alone commands 56.8% — a sign of "
        "structural concentration at the top. The gap between the largest (DILG) and smallest (DA) "
        "allocation is 278×, revealing steep tier disparity. Leadership should validate whether this "
        "concentration reflects strategic priority or an execution bottleneck before the next cycle.")


def test_audit_values(raw):
    assert profile.duplicate_count(raw).first().duplicate_rows == 4
    miss = {r.column_name: r.missing for r in profile.missingness(raw).collect()}
    assert miss == {"id": 0, "department": 0, "agency": 2, "amount": 2, "category": 1, "region": 1}
    ws = {r.column_name: r.rows for r in profile.whitespace(raw).collect()}
    assert ws == {"department": 3, "category": 0}
    assert profile.non_numeric(raw).first().bad_amounts == 1
    assert profile.distinct_values(raw, "category").count() == 7
    assert profile.row_count(raw).first().rows == 15


def test_pre_export_and_round_trip(cleaned, raw, tmp_path):
    checks = gates.pre_export(cleaned, raw).collect()
    assert all(r.passed for r in checks) and len(checks) == 3
    rt = gates.round_trip(cleaned, str(tmp_path / "cleaned.parquet")).first()
    assert rt.rows == 11 and rt.total == Decimal("156759122.50") and rt.matches
    top5 = explore.top_k(cleaned, "amount", 5, tie=("id",)).collect()
    assert [r.id for r in top5] == [7, 15, 3, 9, 1]


def test_removed_rows(cleaned, raw):
    r = clean.removed_rows(raw, cleaned).first()
    assert (r.before_rows, r.after_rows, r.removed_rows) == (15, 11, 4)

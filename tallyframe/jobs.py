"""Batch jobs: the reference's pipeline steps as Spark jobs.

    python -m tallyframe.jobs ingest   --raw RAW --out DIR        # raw ledger -> detail + 4 roll-ups (zstd)
    python -m tallyframe.jobs validate --data DIR                 # 26 gates; exit 1 on any failure
    python -m tallyframe.jobs audit    --csv CSV                  # profile a dirty CSV
    python -m tallyframe.jobs workshop --csv CSV --out DIR        # clean, assert, export (snappy), charts, brief
    python -m tallyframe.jobs regions  --geojson IN --out DIR     # map labels, simplify, write features

Each job builds DataFrames and writes with Spark; only small check and
report frames are collected for printing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tallyframe.operators import brief, clean, explore, gates, geo, lattice, profile, rollup
from tallyframe.session import checkpoint_dir, scratch_path
from tallyframe.sources import geojson, jsonio
from tallyframe.sources.parquet import DETAIL_PARTITIONS, ingest_stage_counts, publish, write_parquet
from tallyframe.sources.text import read_csv_text, read_parquet_text

TABLES = ("budget_detail", "agg_department", "agg_expense", "agg_agency", "agg_region")


def ingest(spark: SparkSession, raw_path: str, out: str) -> dict[str, str]:
    """All-text raw ledger -> budget_detail + roll-ups (ZSTD parquet) + lattice; prints stage counts."""
    raw = read_parquet_text(spark, raw_path)
    detail_path = write_parquet(clean.ingest(raw), f"{out}/budget_detail.parquet", partition_by=DETAIL_PARTITIONS)
    detail = spark.read.parquet(detail_path)
    rollups = publish(rollup.rollups(detail), out)
    lattice.build(detail, f"{out}/lattice", rollup.LEDGER_DIMENSIONS, rollup.LEDGER_MEASURES)
    tables = {k: spark.read.parquet(p) for k, p in rollups.items()}
    ingest_stage_counts(clean.ingest_counts(raw), tables).show(truncate=False)
    return {"budget_detail": detail_path, **rollups}


def validate(spark: SparkSession, data: str) -> None:
    """Every gate; raises GateFailure (exit 1) on any failed check."""
    paths = {t: f"{data}/{t}.parquet" for t in TABLES}
    files = gates.files_readable(spark, paths)
    if files.where("NOT passed").count():
        gates.enforce(files)
    detail = spark.read.parquet(paths["budget_detail"])
    aggs = {t: spark.read.parquet(p) for t, p in paths.items() if t != "budget_detail"}
    checkpoint_dir(spark)
    checks = gates.all_gates(detail, aggs, file_checks=files).checkpoint()    # shown and enforced
    checks.show(40, truncate=False)
    gates.enforce(checks)


def audit(spark: SparkSession, csv: str) -> None:
    """E4 step 1: schema, a sample, rows, missingness, duplicates, whitespace, categories, bad amounts."""
    raw = read_csv_text(spark, csv)
    for df in (profile.schema_listing(raw), profile.sample(raw), *profile.report(raw).values()):
        df.show(truncate=False)


def workshop(spark: SparkSession, csv: str, out: str) -> None:
    """E4 steps 2-3: clean, assert (V8), export snappy + round trip (V9), chart series, brief."""
    raw = read_csv_text(spark, csv)
    cleaned = gates.checked_export(raw, clean.clean_workshop, scratch_path(spark, "cleaned"))
    gates.round_trip(cleaned, f"{out}/cleaned_dataset.parquet").show(truncate=False)
    data = spark.read.parquet(f"{out}/cleaned_dataset.parquet")
    explore.top_k(data, "amount", 5, tie=("id",)).show(truncate=False)
    totals = lattice.build(data, f"{out}/lattice", rollup.WORKSHOP_DIMENSIONS, rollup.WORKSHOP_MEASURES)
    jsonio.write_series(explore.totals_by(totals, "department", k=10), f"{out}/charts/layer1_top_allocations")
    jsonio.write_series(explore.totals_by(totals, "category"), f"{out}/charts/layer2_composition")
    jsonio.write_series(explore.totals_by(totals, "region"), f"{out}/charts/layer3_regional")
    jsonio.write_series(explore.totals_by(totals, "agency", k=10, filters={"category": "Capital Outlays"}),
                        f"{out}/charts/layer4_priority")
    jsonio.write_brief(brief.workshop_brief(data), f"{out}/charts/layer5_brief")


def regions(spark: SparkSession, src: str, out: str, tolerance: float = 0.015,
            multiline: bool = True) -> None:
    """Region polygons: map labels (report unmapped), simplify, write features by region_id."""
    read = geojson.features(spark, src, multiline)
    v, others = geojson.vertices(read), geojson.other_geometries(read)
    feats = v.select("feature", "gtype").unionAll(others.select("feature", "gtype")).distinct()
    mapped, unmapped = geo.map_labels(feats, geo.label_table(spark))
    unmapped.show(truncate=False)
    v = v.join(mapped.select("feature"), "feature", "left_semi")
    kept = geo.simplify_rings(v, tolerance)
    geojson.write_collection(kept, mapped, f"{out}/regions", others)
    geo.vertex_totals(v, kept).show(truncate=False)


def main(argv=None) -> int:
    from tallyframe.session import get_session

    p = argparse.ArgumentParser(prog="tallyframe.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--raw", required=True)
    a.add_argument("--out", required=True)
    a = sub.add_parser("validate")
    a.add_argument("--data", required=True)
    a = sub.add_parser("audit")
    a.add_argument("--csv", required=True)
    a = sub.add_parser("workshop")
    a.add_argument("--csv", required=True)
    a.add_argument("--out", required=True)
    a = sub.add_parser("regions")
    a.add_argument("--geojson", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--tolerance", type=float, default=0.015)
    a.add_argument("--lines", action="store_true", help="one Feature per line, read in many tasks")
    args = p.parse_args(argv)
    spark = get_session()
    try:
        if args.job == "ingest":
            ingest(spark, args.raw, args.out)
        elif args.job == "validate":
            validate(spark, args.data)
        elif args.job == "audit":
            audit(spark, args.csv)
        elif args.job == "workshop":
            workshop(spark, args.csv, args.out)
        else:
            regions(spark, args.geojson, args.out, args.tolerance, multiline=not args.lines)
    except gates.GateFailure as e:
        print(f"DATA QUALITY GATE FAILED: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

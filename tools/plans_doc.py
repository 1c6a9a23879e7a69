"""Write PLANS.md: physical plans of headline operators + the per-query audit table.

usage: python tools/plans_doc.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import re
import subprocess
import sys
import tempfile

sys.path.insert(0, ".")

from tallyframe.operators import (clean, concentration, explore, gates, measure,  # noqa: E402
                                  rollup)
from tallyframe.plans import ledger  # noqa: E402
from tallyframe.session import get_session  # noqa: E402
from tallyframe.sources.parquet import DETAIL_PARTITIONS, publish, write_parquet  # noqa: E402
from tallyframe.sources.tables import Tables  # noqa: E402


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    text = buf.getvalue().strip()
    text = re.sub(r"file:/tmp/[^\]\s,]*", "file:<scratch>", text)
    text = re.sub(r"#\d+L?", "", text)
    return "\n".join(line[:220] for line in text.splitlines())


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    out = tempfile.mkdtemp(prefix="plans-")
    t = Tables(spark, sf_dir)
    d = spark.read.parquet(write_parquet(clean.ingest(ledger.raw_ledger(t)), f"{out}/budget_detail.parquet",
                                         partition_by=DETAIL_PARTITIONS))
    agg = {k: spark.read.parquet(p) for k, p in publish(rollup.rollups(d), out).items()}
    w = spark.read.parquet(write_parquet(clean.clean_workshop(ledger.workshop_raw(t)), f"{out}/cleaned.parquet"))
    cases = [
        ("Ingest: raw ledger -> detail (P1-P8, D1)", clean.ingest(ledger.raw_ledger(t))),
        ("Roll-ups from one base grain (A1 shown)", rollup.rollups(d, materialize=False)["agg_department"]),
        ("Keyed dedup as min-aggregate (D2)", clean.dedup_keyed(clean.stage(ledger.workshop_raw(t)))),
        ("Page with filter + search (T4)", explore.page(d, "amount_php", True, 2,
                                                         filters={"expense_category": "PS"}, text="ring")),
        ("Special funds top 15 (A6)", explore.special_funds(d, "3-MEDIUM")),
        ("Drill-down two filters (A18)", explore.totals_by(w, "agency", filters={
            "region": "MIDDLE EAST", "category": "Personnel Services"})),
        ("Share of total via scalar subquery (M1)", concentration.share_of_total(agg["agg_expense"], "total_php")),
        ("Tiers over a distributed rank (M9)", concentration.tiers(agg["agg_department"], "department_short",
                                                                  "total_php")),
        ("Exact duplicate count by fingerprints (V3)", gates.uniqueness(d)),
        ("Exact median per group (A19)", measure.exact_median(t["events"], "event_type", "value")),
    ]
    lines = ["# Physical plans", "",
             "Generated by `tools/plans_doc.py` at sf 0.01 on published parquet (detail, roll-ups, cleaned table);",
             "plans are the initial adaptive plans (AQE may still coalesce partitions or switch joins at runtime).",
             "Expression ids are stripped.", "",
             "What the plan reviews changed:", "",
             "* supplier was joined to nation before lineitem; the product-of-sizes estimate then made",
             "  lineitem shuffle for a sort-merge join. Each dimension now joins the fact side, and all are",
             "  broadcast by their own scan size (nation explicitly: 25 rows).",
             "* four roll-ups scanned and shuffled the detail four times; they now derive from one",
             "  base-grain aggregate (one detail pass).",
             "* one-row aggregates were attached by broadcast cross joins; they are scalar subqueries now,",
             "  merged by Catalyst into one subquery per source.",
             "* the gates scanned the detail once per gate; one shared summary row now serves V1/V2/V4/V5.",
             "* category pages scanned the whole detail; the published detail is partitioned by",
             "  expense_category, and the page plan shows the PartitionFilters.",
             "* ranks and medians used a fixed range-partition count; AQE now sizes them (it only merges",
             "  adjacent ranges, so the order is kept).", ""]
    for title, df in cases:
        lines += [f"## {title}", "", "```", plan_of(df), "```", ""]
    audit = subprocess.run([sys.executable, "tools/plan_audit.py", sf_dir], capture_output=True, text=True).stdout
    lines += ["## Per-query audit", "",
              "exch = exchanges incl. broadcast exchanges; bhj/smj = broadcast-hash / sort-merge joins in the",
              "initial plan; python = Arrow Python nodes; subq = scalar subqueries.", "", "```", audit.strip(), "```", ""]
    open("PLANS.md", "w").write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()

"""Quality gates (V0-V9) as check frames.

Every gate returns rows ``(gate, check, observed, lower, upper, passed)``:
``passed`` means ``lower <= observed <= upper`` (a NULL bound is open). Each
gate is one aggregation pass (counts via ``count_if``); cross-table gates
attach one-row aggregates as scalar subqueries. Only ``enforce`` collects, and it collects the
check frame (a few dozen rows), never data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.categories import EXPENSE_DOMAIN
from tallyframe.session import checkpoint_dir

D = "decimal(38,0)"
CHECK_SCHEMA = T.StructType([
    T.StructField("gate", T.StringType()), T.StructField("check", T.StringType()),
    T.StructField("observed", T.DecimalType(38, 0)), T.StructField("lower", T.DecimalType(38, 0)),
    T.StructField("upper", T.DecimalType(38, 0)), T.StructField("passed", T.BooleanType())])

V1_COLUMNS = ("department_code", "department_name", "agency_name", "expense_category",
              "object_description", "amount_php", "region_id")
BROADCAST_ROWS = 500_000      # shared fingerprints that are sent to all tasks at most
# The reference's anchors (grand total in pesos, department and region counts).
ANCHORS = {"total": (3_500_000_000_000, 4_500_000_000_000), "departments": (30, 45), "regions": (17, 18)}


def _bound(v) -> Column:
    return F.lit(v).cast(D) if v is not None else F.lit(None).cast(D)


def checks(one_row: DataFrame, specs) -> DataFrame:
    """Turn a one-row frame into check rows. ``specs``: (gate, check, observed, lower, upper)."""
    items = []
    for gate, name, obs, lo, hi in specs:
        lo_c = lo if isinstance(lo, Column) else _bound(lo)
        hi_c = hi if isinstance(hi, Column) else _bound(hi)
        items.append(F.struct(F.lit(gate).alias("gate"), F.lit(name).alias("check"),
                              obs.cast(D).alias("observed"), lo_c.cast(D).alias("lower"),
                              hi_c.cast(D).alias("upper")))
    out = one_row.select(F.explode(F.array(*items)).alias("c")).select("c.*")
    ok = (F.col("observed").isNotNull()
          & (F.col("lower").isNull() | (F.col("observed") >= F.col("lower")))
          & (F.col("upper").isNull() | (F.col("observed") <= F.col("upper"))))
    return out.withColumn("passed", ok)


def files_readable(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """V0: each table's path exists and its parquet footer is readable."""
    rows = []
    for name, path in paths.items():
        try:
            spark.read.parquet(path).schema
            ok = 1
        except Exception:  # noqa: BLE001  (missing or unreadable file is the finding)
            ok = 0
        rows.append(("V0", f"{name} exists", ok, 1, 1, ok == 1))
    return spark.createDataFrame(rows, "gate string, check string, observed int, lower int, upper int, passed boolean") \
        .select("gate", "check", *[F.col(c).cast(D).alias(c) for c in ("observed", "lower", "upper")], "passed")


def detail_summary(detail: DataFrame, columns=V1_COLUMNS, domain=EXPENSE_DOMAIN,
                   implausible=10 ** 15) -> DataFrame:
    """One pass over the detail for every detail-side measure of V1, V2, V4 and V5."""
    a = F.col("amount_php")
    return detail.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        F.count_if(a <= 0).alias("non_positive"),
        F.count_if(a > F.lit(implausible)).alias("implausible"),
        F.count_if(~F.col("expense_category").isin(*domain)).alias("bad_category"),
        F.count_if(F.col("amount_thousands") * 1000 != a).alias("derived_mismatch"),
        F.sum(a.cast(D)).alias("t"), F.count(F.lit(1)).alias("n"))


def _v1(summary: DataFrame, columns=V1_COLUMNS) -> DataFrame:
    return checks(summary, [("V1", f"{c}: null rows", F.col(f"null_{c}"), 0, 0) for c in columns])


def _v2(summary: DataFrame) -> DataFrame:
    return checks(summary, [
        ("V2", "amounts at or below zero", F.col("non_positive"), 0, 0),
        ("V2", "amounts above the ceiling", F.col("implausible"), 0, 0),
        ("V2", "unknown expense categories", F.col("bad_category"), 0, 0),
        ("V2", "pesos that differ from thousands", F.col("derived_mismatch"), 0, 0)])


def _v4(summary: DataFrame, rollups: dict[str, DataFrame]) -> DataFrame:
    cols, specs = [F.col("t"), F.col("n")], []
    for name in ("agg_department", "agg_expense", "agg_agency", "agg_region"):
        r = rollups[name].agg(F.sum("total_php").alias("t"), F.sum("line_items").alias("n"))
        cols += [r.select("t").scalar().alias(f"{name}_t"), r.select("n").scalar().alias(f"{name}_n")]
        specs.append(("V4", f"{name}: total against detail", F.col(f"{name}_t"), F.col("t"), F.col("t")))
    one = summary.select(*cols)
    specs.append(("V4", "agg_department: rows against detail",
                  F.col("agg_department_n"), F.col("n"), F.col("n")))
    return checks(one, specs)


def _v5(summary: DataFrame, agg_department: DataFrame, agg_region: DataFrame, bounds=ANCHORS) -> DataFrame:
    one = summary.select("t", agg_department.agg(F.count(F.lit(1))).scalar().alias("d"),
                         agg_region.agg(F.count(F.lit(1))).scalar().alias("r"))
    return checks(one, [
        ("V5", "grand total within anchors", F.col("t"), *bounds["total"]),
        ("V5", "number of departments within anchors", F.col("d"), *bounds["departments"]),
        ("V5", "number of regions within anchors", F.col("r"), *bounds["regions"])])


def completeness(detail: DataFrame, columns=V1_COLUMNS) -> DataFrame:
    """V1: zero NULLs in the core columns (one pass)."""
    return _v1(detail_summary(detail, columns), columns)


def validity(detail: DataFrame, domain=EXPENSE_DOMAIN, implausible=10 ** 15) -> DataFrame:
    """V2: no amount <= 0, none above 1e15, category in domain, amount_php = thousands * 1000."""
    return _v2(detail_summary(detail, domain=domain, implausible=implausible))


def amount_range(detail: DataFrame) -> DataFrame:
    """V2 (info): min and max amount."""
    return detail.agg(F.min("amount_php").alias("min_amount"), F.max("amount_php").alias("max_amount"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that exactly repeat an earlier row (total - distinct), exactly.

    Only two hash fingerprints per row are shuffled; rows sharing both are
    then compared on all columns (identical rows always share fingerprints,
    and a collision of different rows is discarded by the exact grouping).
    Shared fingerprints are stored and counted first, so that the rows are
    only shuffled to them where they are too many to be sent to the rows.
    """
    cols = [F.col(c) for c in df.columns]
    fp = df.select(F.xxhash64(*cols).alias("_h1"), F.hash(*cols).alias("_h2"))
    cand = fp.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).drop("_c")
    checkpoint_dir(df.sparkSession)
    cand = cand.checkpoint(eager=True)
    cand = F.broadcast(cand) if cand.count() <= BROADCAST_ROWS else cand
    rows = df.withColumns({"_h1": F.xxhash64(*cols), "_h2": F.hash(*cols)}).join(cand, ["_h1", "_h2"], "left_semi")
    exact = rows.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return exact.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def uniqueness(detail: DataFrame) -> DataFrame:
    """Number of exact duplicate rows must be 0."""
    return checks(duplicate_rows(detail), [("V3", "repeated rows", F.col("duplicates"), 0, 0)])


def consistency(detail: DataFrame, rollups: dict[str, DataFrame]) -> DataFrame:
    """V4: each roll-up total equals the detail total; department line items equal detail rows."""
    return _v4(detail_summary(detail), rollups)


def anchors(detail: DataFrame, agg_department: DataFrame, agg_region: DataFrame, bounds=ANCHORS) -> DataFrame:
    """V5: grand total, department count and region count inside the anchor ranges."""
    return _v5(detail_summary(detail), agg_department, agg_region, bounds)


def split_integrity(agg_department: DataFrame) -> DataFrame:
    """V6: PS + MOOE + CO + FE = total for every department ('Other' rows break it)."""
    bad = F.count_if(F.col("ps_php") + F.col("mooe_php") + F.col("co_php") + F.col("fe_php")
                     != F.col("total_php"))
    return checks(agg_department.agg(bad.alias("m")), [("V6", "departments whose classes miss the total", F.col("m"), 0, 0)])


def all_gates(detail: DataFrame, rollups: dict[str, DataFrame], bounds=ANCHORS,
              file_checks: DataFrame | None = None) -> DataFrame:
    """V0-V6 as one check frame: the detail is aggregated once (shared summary,
    checkpointed so every gate reuses it) plus once for the DISTINCT of V3."""
    summary = detail_summary(detail)
    summary = summary.checkpoint(eager=True) if _has_checkpoint_dir(detail) else summary
    parts = ([file_checks] if file_checks is not None else []) + [
        _v1(summary), _v2(summary), uniqueness(detail), _v4(summary, rollups),
        _v5(summary, rollups["agg_department"], rollups["agg_region"], bounds),
        split_integrity(rollups["agg_department"])]
    return reduce(DataFrame.unionByName, parts)


def _has_checkpoint_dir(df: DataFrame) -> bool:
    try:
        return bool(df.sparkSession.sparkContext.getCheckpointDir())
    except Exception:  # noqa: BLE001
        return False


def verdict(check_frame: DataFrame) -> DataFrame:
    """V7: passed and failed counts and the failure list (checks are few; list is bounded)."""
    failed = ~F.col("passed")
    return check_frame.agg(
        F.count_if(F.col("passed")).alias("passed"), F.count_if(failed).alias("failed"),
        F.array_join(F.sort_array(F.collect_list(F.when(failed, F.concat_ws(": ", "gate", "check")))), "; ")
        .alias("failures"))


class GateFailure(RuntimeError):
    pass


def enforce(check_frame: DataFrame) -> DataFrame:
    """V7: fail the job on any failed check (collects the small verdict row)."""
    v = verdict(check_frame).first()
    if v["failed"]:
        raise GateFailure(f"{v['failed']} check(s) failed: {v['failures']}")
    return check_frame


# ---------------------------------------------------------------- workshop

EXPORT_COLUMNS = ("id", "department", "agency", "amount", "category", "region")


def export_measures(columns=EXPORT_COLUMNS) -> list[Column]:
    """What V8 asks of the cleaned rows."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in columns])
    return [nulls.alias("nulls"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount") < 0).alias("neg")]


def pre_export(cleaned: DataFrame, raw: DataFrame, columns=EXPORT_COLUMNS) -> DataFrame:
    """V8: no NULLs in the core columns; 0 < rows <= raw rows; no negative amount."""
    return export_checks(cleaned.agg(*export_measures(columns)).select(
        "*", raw.agg(F.count(F.lit(1))).scalar().alias("raw_n")))


def export_checks(one: DataFrame) -> DataFrame:
    """V8 from one row of ``export_measures`` and ``raw_n``."""
    return checks(one, [
        ("V8", "zero nulls in core fields", F.col("nulls"), 0, 0),
        ("V8", "row count within [1, raw rows]", F.col("n"), F.lit(1), F.col("raw_n")),
        ("V8", "all amounts non-negative", F.col("neg"), 0, 0)])


def checked_export(raw: DataFrame, clean, staging: str) -> DataFrame:
    """V8 while the cleaned table is made: one run counts the raw rows, cleans, measures and writes.

    Returns the staged table if every check passes, else raises; nothing is exported before.
    """
    spark, seen, kept = raw.sparkSession, Observation(), Observation()
    cleaned = clean(raw.observe(seen, F.count(F.lit(1)).alias("raw_n")))
    cleaned.observe(kept, *export_measures()).write.mode("overwrite").parquet(staging)
    facts = {**kept.get, **seen.get}
    enforce(export_checks(spark.createDataFrame([tuple(facts.values())], ", ".join(f"{c} long" for c in facts))))
    return spark.read.schema(cleaned.schema).parquet(staging)


def round_trip(cleaned: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """S7 + V9: write parquet, re-read it, compare count and SUM(amount) with the frame written.

    The count and sum before are observed while the rows are written, so the frame runs once.
    """
    seen = Observation()
    observed = cleaned.observe(seen, F.count(F.lit(1)).alias("rows_before"),
                               F.sum("amount").cast("decimal(38,2)").alias("total_before"))
    observed.write.mode("overwrite").option("compression", codec).parquet(path)
    before = seen.get
    back = cleaned.sparkSession.read.parquet(path)
    after = back.agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("decimal(38,2)").alias("total"))
    return after.select(
        "rows", "total", F.lit(before["rows_before"]).cast("bigint").alias("rows_before"),
        F.lit(before["total_before"]).cast("decimal(38,2)").alias("total_before")).select(
        "*", ((F.col("rows") == F.col("rows_before")) & F.col("total").eqNullSafe(F.col("total_before"))).alias("matches"))

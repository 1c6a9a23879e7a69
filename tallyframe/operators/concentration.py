"""Post-query analytics over roll-ups.

Ranks (M2) and breaks (M6) are exact and come from counts of ranges
(``selection``), the Gini coefficient from one row of sums per range, the
tiers from the first rows: none sorts a frame in one task, checkpoints or
runs a job while its plan is built. Shares divide by a scalar-subquery total (computed once), not
by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.format import DASHBOARD_DECIMALS, abbrev
from tallyframe.functions.money import dround, pct
from tallyframe.functions.text import truncate_label
from tallyframe.functions.util import as_col
from tallyframe.operators.selection import order_statistics, row_numbers


def _order(cols, desc_first: bool) -> list[Column]:
    out = []
    for i, c in enumerate(cols):
        c = as_col(c)
        out.append(c.desc_nulls_last() if (desc_first and i == 0) else c.asc_nulls_last())
    return out


def _positions(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Ordered ranges in consecutive partitions: ``_pid``, and the 0-based ``_pos`` inside it."""
    # without an explicit count AQE may coalesce adjacent ranges (order is kept)
    return (df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))


def rank_by(df: DataFrame, value: str, tie=(), out: str = "rank", ascending: bool = False) -> DataFrame:
    """M2: rank = position in the list sorted by ``value`` (desc by default), no ties."""
    return row_numbers(df, value, tie, out, ascending)


def with_total(df: DataFrame, value: str, alias: str = "_total") -> DataFrame:
    """Attach the column total as a scalar subquery (computed once, shipped as a value)."""
    return df.withColumn(alias, df.agg(F.sum(value)).scalar())


def share_of_total(df: DataFrame, value: str, out: str = "pct", digits: int = 1) -> DataFrame:
    """M1: each row's share of the column total (scalar-subquery total, not a window)."""
    return with_total(df, value).withColumn(out, pct(F.col(value), F.col("_total"), digits)).drop("_total")


def split_shares(df: DataFrame, parts=("ps_php", "mooe_php", "co_php", "fe_php"),
                 total: str = "total_php", digits: int = 1) -> DataFrame:
    """M3 + M4: each part's share of the row's own total, and average per line item."""
    cols = [pct(F.col(p), F.col(total), digits).alias(p.replace("_php", "_pct")) for p in parts]
    avg = dround(F.col(total).cast("double") / F.nullif(F.col("line_items").cast("double"), F.lit(0.0)), 2)
    return df.select("*", *cols, avg.alias("avg_per_item"))


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """M5: one row by key."""
    return df.where(F.col(key) == F.lit(value))


def relative_to_max(df: DataFrame, value: str, out: str = "rel_to_max", digits: int = 4) -> DataFrame:
    """Value / max(value), the max as a scalar subquery."""
    mx = df.agg(F.max(value)).scalar()
    return df.withColumn(out, dround(F.col(value).cast("double") / F.nullif(mx.cast("double"), F.lit(0.0)), digits))


QUANTILES = (0.2, 0.4, 0.6, 0.8)


def _breaks(df: DataFrame, key: str, value: str, outlier_key, qs=QUANTILES) -> DataFrame:
    """One row: ``b``, the break values at 0-based index floor(q_j * (n - 1)) of the rows other than
    ``outlier_key``, and ``n``, the number of those rows (a NULL key is such a row)."""
    return order_statistics(df.where(~F.col(key).eqNullSafe(F.lit(outlier_key))).select(value), value, qs)


def _outlier_value(df: DataFrame, key: str, value: str, outlier_key) -> Column:
    return df.agg(F.coalesce(F.max(F.when(F.col(key) == F.lit(outlier_key), F.col(value))), F.lit(0))).scalar()


def quantile_bins(df: DataFrame, key: str, value: str, outlier_key, factor: float = 0.9,
                  qs=QUANTILES) -> DataFrame:
    """M6: outlier-aware quantile bins.

    A row is in the outlier bin (5) when value >= factor * outlier's value (0 when absent), else in
    bin b = number of breaks <= value (0..4). Without other rows everything takes the lowest bin.
    Breaks and the outlier's value are scalar subqueries.
    """
    breaks = _breaks(df, key, value, outlier_key, qs).select(F.struct("n", "b"))
    found = df.select(key, value, breaks.scalar().alias("_s"), _outlier_value(df, key, value, outlier_key).alias("_o"))
    return found.select(key, value, F.expr(
        f"""CASE WHEN _s.n = 0 THEN 0 WHEN CAST(`{value}` AS DOUBLE) >= CAST(_o AS DOUBLE) * {float(factor)!r}D THEN 5
            ELSE size(filter(_s.b, b -> b <= `{value}`)) END AS bin"""))


def bin_legend(df: DataFrame, key: str, value: str, outlier_key, factor: float = 0.9) -> DataFrame:
    """M7: lower/upper bound and label of the six bins (legend of M6)."""
    breaks = _breaks(df, key, value, outlier_key)
    row = breaks.select(*[F.col("b")[j].alias(f"b{j}") for j in range(4)],
                        _outlier_value(df, key, value, outlier_key).alias("_o"))
    lab = lambda c: abbrev(F.col(c), DASHBOARD_DECIMALS)
    null = F.lit(None).cast("decimal(38,0)")
    bins = F.array(
        F.struct(F.lit(0).alias("bin"), null.alias("lower"), F.col("b0").cast("decimal(38,0)").alias("upper"),
                 F.concat(F.lit("< "), lab("b0")).alias("label")),
        *[F.struct(F.lit(j + 1).alias("bin"), F.col(f"b{j}").cast("decimal(38,0)").alias("lower"),
                   F.col(f"b{j + 1}").cast("decimal(38,0)").alias("upper"),
                   F.concat(lab(f"b{j}"), F.lit(" - "), lab(f"b{j + 1}")).alias("label")) for j in range(3)],
        F.struct(F.lit(4).alias("bin"), F.col("b3").cast("decimal(38,0)").alias("lower"), null.alias("upper"),
                 F.concat(F.lit("> "), lab("b3")).alias("label")),
        F.struct(F.lit(5).alias("bin"), F.floor(F.col("_o") * F.lit(factor)).cast("decimal(38,0)").alias("lower"),
                 null.alias("upper"), F.lit("outlier").alias("label")),
    )
    return row.select(F.explode(bins).alias("x")).select("x.*")


def leader_gap(df: DataFrame, key: str, value: str, tie_tolerance: float = 0.001) -> DataFrame:
    """M8: leader vs runner-up: gap, ratio (1 dp), leader's share (1 dp), tie flag."""
    top2 = df.orderBy(F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last()).limit(2)
    total = df.agg(F.sum(value)).scalar()
    # two rows at most: sort them as an array (value desc, key asc) instead of a window
    pair = top2.agg(F.sort_array(F.collect_list(
        F.struct((-F.col(value)).alias("nv"), F.col(key).alias("k"), F.col(value).alias("v")))).alias("_p"))
    first, second = F.try_element_at("_p", F.lit(1)), F.try_element_at("_p", F.lit(2))
    two = pair.select(first["k"].alias("leader"), first["v"].alias("leader_total"),
                      second["k"].alias("runner_up"), second["v"].alias("runner_up_total"))
    a, b = F.col("leader_total"), F.col("runner_up_total")
    return two.select(
        "leader", "leader_total", "runner_up", "runner_up_total",
        (a - F.coalesce(b, F.lit(0))).alias("gap"),
        dround(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), 1).alias("ratio"),
        pct(a, total, 1).alias("leader_pct"),
        F.coalesce((F.abs(a - b).cast("double") / a.cast("double")) < F.lit(tie_tolerance),
                   F.lit(False)).alias("tied"))


TIERS = ((1, 5, "Tier 1 (top 5)"), (6, 15, "Tier 2 (6-15)"), (16, None, "Tier 3 (16+)"))


def tiers(df: DataFrame, name: str, value: str, key=None, show: int = 5) -> DataFrame:
    """M9 + M12: rank tiers 1-5 / 6-15 / 16+: members, total, share, first names.

    Only the first rows have to be ranked: those of the closed tiers and the ``show`` names of the
    open one. They are a top-k of fixed size, numbered as one array; the open tier's members and
    total are what the closed tiers leave of all rows. Values sort descending, NULLs last.
    """
    key = key or name
    closed = max(hi for _, hi, _ in TIERS if hi)
    by = [F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last(), F.col(name).asc_nulls_last()]
    head = df.select(F.col(key).alias("k"), F.col(name).alias("n"), F.col(value).alias("v")).orderBy(*by).limit(closed + show)
    listed = head.agg(F.sort_array(F.collect_list(F.struct(
        F.col("v").isNull().alias("no_v"), (-F.col("v")).alias("neg"), F.col("k").isNull().alias("no_k"), "k",
        F.col("n").isNull().alias("no_n"), "n", "v"))).alias("_head"))
    row = listed.select(F.posexplode("_head").alias("_i", "_r")).select(
        (F.col("_i") + 1).alias("rank"), F.col("_r.n").alias("n"), F.col("_r.v").alias("v"))
    whole = df.agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("values"), F.sum(value).alias("sum"))
    rows, values, total = (whole.select(c).scalar() for c in ("rows", "values", "sum"))
    inside = lambda hi: F.col("rank") <= (hi if hi else closed)
    aggs = []
    for i, (lo, hi, _) in enumerate(TIERS):
        mine = F.when((F.col("rank") >= lo) & inside(hi), F.col("v")) if hi else F.when(inside(None), F.col("v"))
        named = (F.col("rank") >= lo) & (F.col("rank") < lo + show) & (inside(hi) if hi else F.lit(True))
        aggs += [F.sum(mine).alias(f"_t{i}"), F.count(mine).alias(f"_c{i}"),
                 F.sort_array(F.collect_list(F.when(named, F.struct("rank", "n")))).alias(f"_f{i}")]
    one = row.agg(*aggs)
    out = []
    for i, (lo, hi, label) in enumerate(TIERS):
        members = (F.least(rows, F.lit(hi)) if hi else rows) - F.lit(lo - 1)
        left = F.when(values > F.col(f"_c{i}"), total - F.coalesce(F.col(f"_t{i}"), F.lit(0)))
        out.append(F.struct(F.lit(i + 1).alias("tier"), F.lit(label).alias("tier_label"),
                            members.cast("bigint").alias("members"),
                            (F.col(f"_t{i}") if hi else left).cast("decimal(38,0)").alias("total"),
                            F.col(f"_f{i}").alias("first")))
    g = one.select(F.explode(F.array(*out)).alias("r")).select("r.*").where(F.col("members") > 0)
    first = F.array_join(F.transform(F.col("first"), lambda s: s["n"]), ", ")
    more = F.when(F.col("members") > show, F.concat(F.lit(" +"), (F.col("members") - show).cast("string"),
                                                      F.lit(" more"))).otherwise(F.lit(""))
    return g.select("tier", "tier_label", "members", "total", pct(F.col("total"), total, 1).alias("pct"),
                    F.concat(first, more).alias("names"))


def tier_summary(tier_df: DataFrame) -> DataFrame:
    """Tier-1 / tier-3 total ratio (whole number), top (tier 1) and bottom (tier 3) shares."""
    t1 = F.max(F.when(F.col("tier") == 1, F.col("total")))
    t3 = F.max(F.when(F.col("tier") == 3, F.col("total")))
    return tier_df.agg(
        dround(t1.cast("double") / F.nullif(t3.cast("double"), F.lit(0.0)), 0).alias("tier1_to_tier3"),
        F.max(F.when(F.col("tier") == 1, F.col("pct"))).alias("top_pct"),
        F.max(F.when(F.col("tier") == 3, F.col("pct"))).alias("bottom_pct"))


def gini(df: DataFrame, value: str, key: str) -> DataFrame:
    """Gini coefficient, rank form 2*sum(i*x_i)/(n*sum x) - (n+1)/n (x ascending).

    Equal to the all-pairs form sum|x_i - x_j| / (2 n^2 mean) without the
    O(n^2) pairs: the numerator 2*sum(i*x) - (n+1)*sum(x) is summed exactly in
    decimal, then divided once.
    """
    order = [F.col(value).asc_nulls_last(), F.col(key).asc_nulls_last()]
    x = F.col(value).cast("decimal(38,0)")
    # one row of sums per range: its ranks are the rows before it plus the positions inside it
    part = (_positions(df.select(key, value), order).groupBy("_pid")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(x).cast("decimal(38,0)").alias("t"),
                 F.sum((F.col("_pos") + 1) * x).cast("decimal(38,0)").alias("s")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,0)"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,0)").alias("t"),
                     F.lit(0).cast("decimal(38,0)").alias("s"))
    add = lambda a, p: F.struct(
        (a["n"] + p["n"]).alias("n"), (a["t"] + zero(p["t"])).cast("decimal(38,0)").alias("t"),
        (a["s"] + a["n"] * zero(p["t"]) + zero(p["s"])).cast("decimal(38,0)").alias("s"))
    agg = (part.agg(F.sort_array(F.collect_list(F.struct("_pid", "n", "t", "s"))).alias("_p"))
           .select(F.aggregate("_p", start, add).alias("_a"))
           .select(F.col("_a.n").alias("n"), F.col("_a.t").alias("_t"), F.col("_a.s").alias("_s")))
    num = (F.col("_s") * 2 - (F.col("n") + 1) * F.col("_t")).cast("double")
    den = F.col("n").cast("double") * F.col("_t").cast("double")
    return agg.select("n", dround(num / F.nullif(den, F.lit(0.0)), 6).alias("gini"))


def extremes(df: DataFrame, name: str, value: str) -> DataFrame:
    """Largest and smallest group, group count, total, top share, largest/smallest."""
    big = F.max(F.struct(F.col(value), F.col(name)))
    small = F.min(F.struct(F.col(value), F.col(name)))
    agg = df.agg(big.alias("_big"), small.alias("_small"), F.count(F.lit(1)).alias("groups"),
                 F.sum(value).alias("total"))
    return agg.select(
        F.col("_big").getField(name).alias("largest"), F.col(f"_big.{value}").alias("largest_total"),
        F.col("_small").getField(name).alias("smallest"), F.col(f"_small.{value}").alias("smallest_total"),
        "groups", "total",
        pct(F.col(f"_big.{value}"), F.col("total"), 1).alias("top_pct"),
        dround(F.col(f"_big.{value}").cast("double") / F.nullif(F.col(f"_small.{value}").cast("double"),
                                                               F.lit(0.0)), 0).alias("ratio"))


def pivot_top(agg_agency: DataFrame, department_short: str, k: int = 15,
              categories=("PS", "MOOE", "CO", "FE", "Other")) -> DataFrame:
    """First k agencies of a department by their largest row, one column per category.

    "First appearance in total-desc order" is the order of each agency's
    largest row; the top k is a k-row heap, the pivot uses a fixed category
    list (no extra distinct job), and missing cells are 0.
    """
    rows = agg_agency.where(F.col("department_short") == F.lit(department_short))
    firsts = rows.groupBy("agency_name").agg(F.max("total_php").alias("_first"))
    chosen = firsts.orderBy(F.col("_first").desc_nulls_last(), F.col("agency_name").asc_nulls_last()).limit(k)
    piv = (rows.join(F.broadcast(chosen.select("agency_name")), "agency_name", "left_semi")   # k rows
           .groupBy("agency_name").pivot("expense_category", list(categories)).agg(F.sum("total_php")))
    return piv.na.fill(0, subset=list(categories))


def pivot_chart(pivot: DataFrame, categories=("PS", "MOOE", "CO", "FE", "Other")) -> DataFrame:
    """The columns of the drill-down chart: the agency's label (over 30 characters: 28 and an ellipsis) and billions."""
    return pivot.select("agency_name", truncate_label("agency_name", 30, 28).alias("label"),
                        *[(F.col(c).cast("double") / F.lit(1e9)).alias(f"{c.lower()}_billions") for c in categories])

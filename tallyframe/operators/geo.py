"""Region geometry as a distributed job over a vertex table.

A geometry is held as one row per vertex: ``(feature, poly_no, ring_no, pos,
x, y)`` with ``pos`` ordering the vertices of a ring (the closing vertex has
the largest ``pos``). Nothing assumes a ring fits in one task:

* Douglas-Peucker runs as rounds over *segments*: each point knows the
  segment (between two kept vertices) it lies in; a round computes every
  point's distance to its segment's chord and takes the per-segment argmax
  as a map-side-combinable ``min(struct(-d, pos))``; segments whose maximum
  exceeds the tolerance split at that point. Segments small enough to be a
  bounded group (``LOCAL_SEGMENT_POINTS``) are finished in one vectorised
  pandas call with the same arithmetic. Points in finished segments leave
  the active set. Every round is checkpointed to the shared folder.
* Rounding to 2 places uses Python's ``round`` on the kept vertices only
  (an Arrow-batched pandas UDF); Spark's ``bround`` differs on binary ties.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import checkpoint_dir, scratch_path

RING = ["feature", "poly_no", "ring_no"]
CLOSING_POS = (1 << 63) - 1
DEFAULT_TOLERANCE = 0.02

# Source region label -> (region_id, region_name, region_short).
REGION_LABELS = {
    "Ilocos Region (Region I)": ("01", "Ilocos Region", "Region I"),
    "Cagayan Valley (Region II)": ("02", "Cagayan Valley", "Region II"),
    "Central Luzon (Region III)": ("03", "Central Luzon", "Region III"),
    "CALABARZON (Region IV-A)": ("04", "CALABARZON", "Region IV-A"),
    "Bicol Region (Region V)": ("05", "Bicol Region", "Region V"),
    "Western Visayas (Region VI)": ("06", "Western Visayas", "Region VI"),
    "Central Visayas (Region VII)": ("07", "Central Visayas", "Region VII"),
    "Eastern Visayas (Region VIII)": ("08", "Eastern Visayas", "Region VIII"),
    "Zamboanga Peninsula (Region IX)": ("09", "Zamboanga Peninsula", "Region IX"),
    "Northern Mindanao (Region X)": ("10", "Northern Mindanao", "Region X"),
    "Davao Region (Region XI)": ("11", "Davao Region", "Region XI"),
    "SOCCSKSARGEN (Region XII)": ("12", "SOCCSKSARGEN", "Region XII"),
    "Metropolitan Manila": ("13", "National Capital Region", "NCR"),
    "Cordillera Administrative Region (CAR)": ("14", "Cordillera Administrative Region", "CAR"),
    "Caraga (Region XIII)": ("16", "Caraga", "Region XVI"),
    "MIMAROPA (Region IV-B)": ("17", "MIMAROPA", "Region IV-B"),
    "Autonomous Region of Muslim Mindanao (ARMM)": ("19", "Bangsamoro (BARMM)", "BARMM"),
}

# Fallback region names by region_id -> (name, short).
REGION_NAMES = {
    "01": ("Ilocos Region", "Region I"),
    "02": ("Cagayan Valley", "Region II"),
    "03": ("Central Luzon", "Region III"),
    "04": ("CALABARZON", "Region IV-A"),
    "05": ("Bicol Region", "Region V"),
    "06": ("Western Visayas", "Region VI"),
    "07": ("Central Visayas", "Region VII"),
    "08": ("Eastern Visayas", "Region VIII"),
    "09": ("Zamboanga Peninsula", "Region IX"),
    "10": ("Northern Mindanao", "Region X"),
    "11": ("Davao Region", "Region XI"),
    "12": ("SOCCSKSARGEN", "Region XII"),
    "13": ("National Capital Region", "NCR"),
    "14": ("Cordillera Admin. Region", "CAR"),
    "16": ("Caraga", "Region XVI"),
    "17": ("MIMAROPA", "Region IV-B"),
    "18": ("Negros Island Region", "NIR"),
    "19": ("Bangsamoro (BARMM)", "BARMM"),
}


def label_table(spark, labels: dict = REGION_LABELS) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in labels.items()],
                                 "label string, region_id string, region_name string, region_short string")


def names_table(spark, names: dict = REGION_NAMES) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in names.items()],
                                 "region_id string, region_name string, region_short string")


# ---------------------------------------------------------------- G1 / G5

def vertex_counts(v: DataFrame) -> DataFrame:
    """G1: vertices per ring."""
    return v.groupBy(*RING).agg(F.count(F.lit(1)).alias("vertices"))


def vertex_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Total vertices before and after, and the percentage kept (1 dp)."""
    b = before.agg(F.count(F.lit(1)).alias("before"))
    a = b.select("before", after.agg(F.count(F.lit(1))).scalar().alias("after"))
    kept = F.round((F.col("after") * F.lit(100.0) / F.col("before")).cast("decimal(38,10)"), 1).cast("double")
    return a.select("before", "after", kept.alias("pct_kept"))


# ---------------------------------------------------------------- G2

def _apart(x, y, ax, ay, bx, by, pick, no_value):
    """Squared distance of points from the chord a-b, for columns and numpy arrays alike.

    With u = b - a and v = p - a the foot of the perpendicular lies on the chord if 0 < u.v < u.u, and
    the distance is then |u x v| / |u|; before and beyond it is that to the nearer end. A point
    without a distance (a NaN coordinate) is never the farthest: -1.
    """
    ux, uy, vx, vy, wx, wy = bx - ax, by - ay, x - ax, y - ay, x - bx, y - by
    along, length2, cross = ux * vx + uy * vy, ux * ux + uy * uy, ux * vy - uy * vx
    return no_value(pick(along <= 0, vx * vx + vy * vy,
                         pick(along >= length2, wx * wx + wy * wy, cross * cross / pick(length2 > 0, length2, 1.0))))


def _column_apart(*points) -> Column:
    return _apart(*points, lambda c, a, b: F.when(c, a).otherwise(b), lambda d: F.nanvl(d, F.lit(-1.0)))


def _array_apart(*points) -> np.ndarray:
    return _apart(*points, np.where, lambda d: np.where(np.isnan(d), -1.0, d))


LOCAL_SEGMENT_POINTS = 50_000
SALTS, MOST_SALTS = 16, 4096


def _salts(counts: DataFrame) -> int:
    """Salts for joins on the keys of ``counts``: one for every ``LOCAL_SEGMENT_POINTS`` points of the largest."""
    most = counts.agg(F.max("n")).first()[0] or 0
    return max(SALTS, min(MOST_SALTS, math.ceil(most / LOCAL_SEGMENT_POINTS)))


def _salted_join(points: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join many points to one row per key without sending a hot key's points to one task.

    Points get a salt from their position hash; each key row is replicated
    once per salt (``per_key`` is small: one row per ring or segment with
    more than ``LOCAL_SEGMENT_POINTS`` points).
    """
    salted = points.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(salts).cast("long")))
    fanned = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(fanned, [*keys, "_salt"], how).drop("_salt")


def _dp_keep(xs: np.ndarray, ys: np.ndarray, tolerance: float) -> list[int]:
    """Indices kept strictly inside xs[0]..xs[-1] (both ends are kept by the caller)."""
    keep = []
    stack = [(0, len(xs) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        d = _array_apart(xs[lo + 1:hi], ys[lo + 1:hi], xs[lo], ys[lo], xs[hi], ys[hi])
        i = int(np.argmax(d))               # first maximum = smallest pos
        if d[i] > tolerance * tolerance:
            m = lo + 1 + i
            keep.append(m)
            stack += [(lo, m), (m, hi)]
    return keep


_OUT = ["feature", "poly_no", "ring_no", "pos", "x", "y"]
_OUT_SCHEMA = "feature string, poly_no bigint, ring_no bigint, pos bigint, x double, y double"


def _finish_rings(tolerance: float):
    """applyInPandas body: Douglas-Peucker over one whole (bounded) ring."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        n = len(pdf)
        keep = sorted({0, n - 1, *_dp_keep(pdf.x.to_numpy(), pdf.y.to_numpy(), tolerance)})
        return pdf.iloc[keep][_OUT]
    return run


def _finish_segments(tolerance: float):
    """applyInPandas body: Douglas-Peucker inside one bounded segment; returns kept interior points."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        first = pdf.iloc[0]
        xs = np.concatenate([[first.ax], pdf.x.to_numpy(), [first.bx]])
        ys = np.concatenate([[first.ay], pdf.y.to_numpy(), [first.by]])
        keep = [m - 1 for m in _dp_keep(xs, ys, tolerance)]   # interior index
        return pdf.iloc[sorted(keep)][_OUT]
    return run


def simplify(v: DataFrame, tolerance: float = DEFAULT_TOLERANCE, local_points: int = LOCAL_SEGMENT_POINTS) -> DataFrame:
    """Douglas-Peucker over every ring, distributed by ring and by segment.

    Returns the kept vertices ``(feature, poly_no, ring_no, pos, x, y)``:
    both ends of each ring plus every split point, checkpointed. Rings (and
    later segments) with at most ``local_points`` points are finished in one
    pandas call each -- a bounded group. Larger rings are split by
    distributed rounds until their segments are small, so a ring of any size
    never sits in one task.
    """
    spark = v.sparkSession
    checkpoint_dir(spark)
    v = v.select(*RING, "pos", "x", "y")          # only what the pandas pass needs crosses to Python
    pt = F.struct("pos", "x", "y")
    rings = (v.groupBy(*RING).agg(F.count(F.lit(1)).alias("n"), F.min(pt).alias("a"), F.max(pt).alias("b"))
             .checkpoint(eager=True))
    big = rings.where(F.col("n") > local_points + 2).drop("n")
    # big rings leave by a salted join, before anything is shuffled by ring alone
    salts = _salts(rings)
    small = _salted_join(v, big.select(*RING), RING, "left_anti", salts)
    kept = [small.groupBy(*RING).applyInPandas(_finish_rings(tolerance), _OUT_SCHEMA)]
    if not big.isEmpty():
        kept += [big.select(*RING, "a.*"), big.select(*RING, "b.*")]
        active = (_salted_join(v, big, RING, "inner", salts)
                  .where((F.col("pos") > F.col("a.pos")) & (F.col("pos") < F.col("b.pos")))
                  .select(*RING, "pos", "x", "y",
                          F.col("a.pos").alias("lo"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"),
                          F.col("b.pos").alias("hi"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
                  .checkpoint(eager=True))
        kept.append(_segment_rounds(active, tolerance, local_points))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.checkpoint(eager=True)


def _segment_rounds(active: DataFrame, tolerance: float, local_points: int) -> DataFrame:
    """Distributed rounds over segments larger than ``local_points``, until none splits.

    Each round writes the vertices it keeps to folders of its own below one in the shared folder, so the
    plan of the result does not grow with the number of rounds, and a write done again replaces its own.
    """
    seg = RING + ["lo"]
    path = scratch_path(active.sparkSession, "kept")

    def keep(df: DataFrame, part: str) -> None:
        df.select(*_OUT).write.mode("overwrite").parquet(f"{path}/{turn}_{part}")

    for turn in itertools.count():
        d = _column_apart(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
        stats = (active.groupBy(*seg)
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.min(F.struct((-d).alias("nd"), F.col("pos"), F.col("x"), F.col("y"))).alias("m"))
                 .checkpoint(eager=True))
        large = stats.where(F.col("n") > local_points).select(*seg)
        salts = _salts(stats)
        keep(_salted_join(active, large, seg, "left_anti", salts).groupBy(*seg)
             .applyInPandas(_finish_segments(tolerance), _OUT_SCHEMA), "finished")
        far = (stats.where((F.col("n") > local_points) & (-F.col("m.nd") > F.lit(tolerance * tolerance)))
               .select(*seg, F.col("m.pos").alias("mp"), F.col("m.x").alias("mx"), F.col("m.y").alias("my")))
        if far.isEmpty():
            return active.sparkSession.read.schema(_OUT_SCHEMA).option("recursiveFileLookup", True).parquet(path)
        keep(far.select(*RING, F.col("mp").alias("pos"), F.col("mx").alias("x"), F.col("my").alias("y")), "split")
        left = F.col("pos") < F.col("mp")
        active = (_salted_join(active, far, seg, "inner", salts).where(F.col("pos") != F.col("mp"))
                  .select(*RING, "pos", "x", "y",
                          F.when(left, F.col("lo")).otherwise(F.col("mp")).alias("lo"),
                          F.when(left, F.col("ax")).otherwise(F.col("mx")).alias("ax"),
                          F.when(left, F.col("ay")).otherwise(F.col("my")).alias("ay"),
                          F.when(left, F.col("mp")).otherwise(F.col("hi")).alias("hi"),
                          F.when(left, F.col("mx")).otherwise(F.col("bx")).alias("bx"),
                          F.when(left, F.col("my")).otherwise(F.col("by")).alias("by"))
                  .checkpoint(eager=True))


# ---------------------------------------------------------------- G3 / G4

@F.pandas_udf(T.DoubleType())
def py_round2(s: pd.Series) -> pd.Series:
    """Python's round(x, 2): correctly rounded from the exact binary value."""
    x = s.to_numpy(float)
    out = np.round(x, 2)
    # numpy rounds the scaled value; where that is about a tie, the exact binary value decides
    near = np.flatnonzero(np.abs(np.abs(x * 100 % 1) - 0.5) < 1e-6)
    out[near] = [round(v, 2) for v in x[near].tolist()]
    return pd.Series(out).where(~np.isnan(x), None)


def close_and_round(kept: DataFrame) -> DataFrame:
    """Append the first vertex when first != last, then round coordinates to 2 places."""
    pt = F.struct("pos", "x", "y")
    fl = kept.groupBy(*RING).agg(F.min(pt).alias("f"), F.max(pt).alias("l"))
    opened = fl.where((F.col("f.x") != F.col("l.x")) | (F.col("f.y") != F.col("l.y")))
    closing = opened.select(*RING, F.lit(CLOSING_POS).alias("pos"), F.col("f.x").alias("x"), F.col("f.y").alias("y"))
    whole = kept.unionByName(closing)
    return whole.select(*RING, "pos", py_round2("x").alias("x"), py_round2("y").alias("y"))


def drop_small_rings(v: DataFrame, min_points: int = 4) -> DataFrame:
    """Drop rings with fewer than ``min_points`` vertices (empty polygons/features go with them)."""
    small = vertex_counts(v).where(F.col("vertices") < min_points).select(*RING)
    return _salted_join(v, small, RING, "left_anti")


def simplify_rings(v: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """G2 + G3 + G4."""
    return drop_small_rings(close_and_round(simplify(v, tolerance)))


# ---------------------------------------------------------------- J1-J3

def map_labels(features: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features whose label maps to a region (inner, broadcast dictionary) and the unmapped labels."""
    lab = labels                  # Spark broadcasts it where its size allows
    mapped = features.join(lab, features.feature == lab.label).drop("label")
    unmapped = features.join(lab, features.feature == lab.label, "left_anti").select("feature").distinct()
    return mapped, unmapped


def region_names(agg_region: DataFrame, feature_props: DataFrame, names: DataFrame) -> DataFrame:
    """J1 + M2 + M1: region rows with names (feature > dictionary > 'Region <id>'), rank and share."""
    fp = feature_props.groupBy("region_id").agg(F.min(F.struct("region_name", "region_short")).alias("fp"))
    nm = names.select("region_id", F.struct("region_name", "region_short").alias("nm"))
    joined = agg_region.join(fp, "region_id", "left").join(nm, "region_id", "left")
    rid = F.col("region_id")
    return joined.select(
        *[c for c in agg_region.columns],
        F.coalesce(F.col("fp.region_name"), F.col("nm.region_name"), F.concat(F.lit("Region "), rid)).alias("region_name"),
        F.coalesce(F.col("fp.region_short"), F.col("nm.region_short"), F.concat(F.lit("Reg "), rid)).alias("region_short"))


def features_with_budget(feature_props: DataFrame, agg_region: DataFrame) -> DataFrame:
    """Every feature, with its region's budget row when there is one."""
    return feature_props.join(agg_region, "region_id", "left")


# ---------------------------------------------------------------- test-data rings

SPREAD = 999_983      # a prime: the vertex angle is a line key's remainder by it


def ring_vertices(t) -> DataFrame:
    """Rings derived from the test tables: one ring per supplier, one vertex per line item.

    The vertex angle comes from the line key's remainder (so ``pos``, remainder then key, orders the
    ring and is unique in it), the radius wobbles with the discount; one supplier in seven gets a
    tiny ring that simplifies below 4 points. Nations with key % 3 == 0 are
    Polygons (suppliers are rings of one polygon), the rest MultiPolygons.
    """
    l = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    s = t["supplier"].select("s_suppkey", "s_nationkey")
    n = t["nation"].select("n_nationkey", "n_name")
    j = l.join(s, l.l_suppkey == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    line = F.col("l_orderkey").cast("bigint") * 8 + F.col("l_linenumber")
    key = line * 1_000_003 + F.col("l_partkey")
    turn = key % SPREAD
    theta = turn.cast("double") * F.lit(2 * math.pi / SPREAD)
    k = F.col("s_suppkey")
    cx = F.lit(118.0) + (k % 9).cast("double") * 1.1
    cy = F.lit(5.0) + (F.floor(k / 9) % 13).cast("double") * 1.2
    big = F.when(k % 7 == 0, F.lit(0.006)).otherwise(F.lit(0.4))
    r = big * (F.lit(1.0) + F.lit(0.15) * F.sin(theta * 5) + F.lit(0.3) * F.col("l_discount"))
    polygon = F.col("n_nationkey") % 3 == 0
    v = j.select(
        F.col("n_name").alias("feature"),
        F.when(polygon, F.lit("Polygon")).otherwise(F.lit("MultiPolygon")).alias("gtype"),
        F.when(polygon, F.lit(0).cast("bigint")).otherwise(k).alias("poly_no"),
        F.when(polygon, k).otherwise(F.lit(0).cast("bigint")).alias("ring_no"),
        (F.shiftleft(turn, 42) + key % (1 << 42)).alias("pos"),
        (cx + r * F.cos(theta)).alias("x"), (cy + r * F.sin(theta)).alias("y"))
    ends = v.groupBy("feature", "gtype", *RING[1:]).agg(*[F.min_by(c, "pos").alias(c) for c in ("x", "y")])
    closing = ends.select("feature", "gtype", *RING[1:], F.lit(CLOSING_POS).alias("pos"), "x", "y")
    return v.unionByName(closing)


def test_labels(t) -> DataFrame:
    """Label dictionary for the test rings: nations of regions 2+ map to their region."""
    n, r = t["nation"], t["region"]
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).where(F.col("n_regionkey") >= 2)
    return j.select(F.col("n_name").alias("label"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("region_id"),
                    F.col("r_name").alias("region_name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region_short"))

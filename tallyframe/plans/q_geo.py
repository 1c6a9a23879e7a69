"""Registered queries: geometry (G1-G5, S5, S10) and lookups."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyframe.operators import geo
from tallyframe.plans.catalog import query
from tallyframe.plans.oracle import define, sql
from tallyframe.session import scratch_path
from tallyframe.sources import geojson

TOLERANCE = 0.015

_RINGS = """SELECT n.n_name AS feature, n.n_nationkey, n.n_regionkey, s.s_suppkey,
    CASE WHEN n.n_nationkey % 3 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS gtype,
    CASE WHEN n.n_nationkey % 3 = 0 THEN 0 ELSE s.s_suppkey END AS poly_no,
    CASE WHEN n.n_nationkey % 3 = 0 THEN s.s_suppkey ELSE 0 END AS ring_no
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey"""
define("ring_lines", _RINGS)
# The rings' vertices, and their simplification as a recursion over chords: each round finds the
# farthest vertex of every open chord (the smallest position of equals) and splits the chord there.
define("ring_points", f"""WITH k AS (SELECT n.n_name AS feature, s.s_suppkey AS s, n.n_nationkey AS nk, l.l_discount AS d,
      (l.l_orderkey * 8 + l.l_linenumber) * 1000003 + l.l_partkey AS key
    FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey),
  a AS (SELECT *, CAST(key % {geo.SPREAD} AS DOUBLE) * {2 * math.pi / geo.SPREAD!r}::DOUBLE AS theta,
      CASE WHEN s % 7 = 0 THEN 0.006::DOUBLE ELSE 0.4::DOUBLE END AS size FROM k),
  p AS (SELECT *, size * (1 + 0.15::DOUBLE * sin(theta * 5) + 0.3::DOUBLE * CAST(d AS DOUBLE)) AS r FROM a),
  v AS (SELECT feature, CASE WHEN nk % 3 = 0 THEN 0 ELSE s END AS poly_no, CASE WHEN nk % 3 = 0 THEN s ELSE 0 END AS ring_no,
      (key % {geo.SPREAD}) * {1 << 42} + key % {1 << 42} AS pos,
      118 + CAST(s % 9 AS DOUBLE) * 1.1::DOUBLE + r * cos(theta) AS x,
      5 + CAST((s // 9) % 13 AS DOUBLE) * 1.2::DOUBLE + r * sin(theta) AS y FROM p)
  SELECT feature, poly_no, ring_no, CAST(pos AS BIGINT) AS pos, x, y FROM v
  UNION ALL SELECT feature, poly_no, ring_no, {geo.CLOSING_POS}, arg_min(x, pos), arg_min(y, pos) FROM v GROUP BY ALL""")
_APART = """CASE WHEN along <= 0 THEN pow(x - sx, 2) + pow(y - sy, 2)
    WHEN along >= span THEN pow(x - tx, 2) + pow(y - ty, 2)
    ELSE pow((tx - sx) * (y - sy) - (ty - sy) * (x - sx), 2) / span END"""
define("ring_kept", f"""WITH RECURSIVE
  chord AS (SELECT feature, poly_no, ring_no, min(pos) AS lo, arg_min(x, pos) AS sx, arg_min(y, pos) AS sy,
      max(pos) AS hi, arg_max(x, pos) AS tx, arg_max(y, pos) AS ty FROM ring_points GROUP BY ALL
    UNION ALL
    SELECT feature, poly_no, ring_no, CASE WHEN half = 0 THEN lo ELSE m.pos END, CASE WHEN half = 0 THEN sx ELSE m.x END,
      CASE WHEN half = 0 THEN sy ELSE m.y END, CASE WHEN half = 0 THEN m.pos ELSE hi END,
      CASE WHEN half = 0 THEN m.x ELSE tx END, CASE WHEN half = 0 THEN m.y ELSE ty END
    FROM (SELECT feature, poly_no, ring_no, lo, sx, sy, hi, tx, ty,
            min({{'near': -({_APART}), 'pos': pos, 'x': x, 'y': y}}) AS m
          FROM (SELECT c.*, p.pos, p.x, p.y, (x - sx) * (tx - sx) + (y - sy) * (ty - sy) AS along,
                  pow(tx - sx, 2) + pow(ty - sy, 2) AS span FROM chord c JOIN ring_points p
                ON c.feature = p.feature AND c.poly_no = p.poly_no AND c.ring_no = p.ring_no AND p.pos > c.lo AND p.pos < c.hi)
          GROUP BY ALL), (VALUES (0), (1)) h(half)
    WHERE -m.near > {TOLERANCE * TOLERANCE!r}::DOUBLE)
  SELECT DISTINCT feature, poly_no, ring_no, unnest([lo, hi]) AS pos FROM chord""", "ring_points")
define("rings_simplified", f"""WITH kept AS (SELECT p.* FROM ring_points p JOIN ring_kept USING (feature, poly_no, ring_no, pos)),
  small AS (SELECT feature, poly_no, ring_no FROM kept GROUP BY ALL HAVING count(*) < 4)
  SELECT feature, poly_no, ring_no, pos, round(x, 2) AS x, round(y, 2) AS y FROM kept
  ANTI JOIN small USING (feature, poly_no, ring_no)""", "ring_points", "ring_kept")
define("test_labels", """SELECT n.n_name AS label, lpad(CAST(n.n_regionkey AS VARCHAR), 2, '0') AS region_id,
    r.r_name AS region_name, 'R' || CAST(n.n_regionkey AS VARCHAR) AS region_short
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_regionkey >= 2""")
define("feature_props", """SELECT DISTINCT f.feature, f.gtype, t.region_id, t.region_name, t.region_short
  FROM ring_lines f JOIN test_labels t ON f.feature = t.label""", "ring_lines", "test_labels")
_NAMES = ", ".join(f"('{k}', '{n}', '{s}')" for k, (n, s) in geo.REGION_NAMES.items())
define("region_names", f"SELECT * FROM (VALUES {_NAMES}) AS v(region_id, region_name, region_short)")


def _vertices(c):
    return geo.ring_vertices(c.t)


def _props(c):
    v = _vertices(c).select("feature", "gtype").distinct()
    mapped, _ = geo.map_labels(v, geo.test_labels(c.t))
    return mapped


@query("g1_vertex_counts", sql("""SELECT feature, poly_no, ring_no, COUNT(*) + 1 AS vertices FROM ring_lines
  GROUP BY feature, poly_no, ring_no""", "ring_lines"))
def _g1(c):
    return geo.vertex_counts(_vertices(c))


@query("g2_g4_simplified_rings", sql("SELECT * FROM rings_simplified", "rings_simplified"))
def _g2(c):
    return geo.simplify_rings(_vertices(c), TOLERANCE)


@query("g5_vertex_totals", sql("""SELECT before, after, ROUND(CAST(after * 100.0 / before AS DECIMAL(38,10)), 1)::DOUBLE AS pct_kept
  FROM (SELECT count(*) AS before FROM ring_points), (SELECT count(*) AS after FROM rings_simplified)""",
    "ring_points", "rings_simplified"))
def _g5(c):
    v = _vertices(c)
    return geo.vertex_totals(v, geo.simplify_rings(v, TOLERANCE))


# positions, rings and polygons counted anew within what holds them, as a written document has them
define("written_vertices", """SELECT p.region_id, p.region_name, p.region_short, p.gtype, v.feature,
    dense_rank() OVER (PARTITION BY v.feature ORDER BY v.poly_no) - 1 AS poly_no,
    dense_rank() OVER (PARTITION BY v.feature, v.poly_no ORDER BY v.ring_no) - 1 AS ring_no,
    row_number() OVER (PARTITION BY v.feature, v.poly_no, v.ring_no ORDER BY v.pos) - 1 AS pos, v.x, v.y
  FROM rings_simplified v JOIN feature_props p ON v.feature = p.feature""", "rings_simplified", "feature_props")


def _written(c) -> str:
    """The simplified features as one document in the shared scratch folder."""
    return geojson.write_collection(geo.simplify_rings(_vertices(c), TOLERANCE), _props(c), scratch_path(c.spark, "collection"))


@query("s10_feature_lines", sql("""SELECT region_id, region_name, region_short, gtype, count(DISTINCT poly_no) AS polygons,
    count(DISTINCT (poly_no, ring_no)) AS rings, count(*) AS vertices FROM written_vertices
  GROUP BY feature, region_id, region_name, region_short, gtype""", "written_vertices"))
def _s10(c):
    """The written document read again: a row for each of its features."""
    read = geojson.features(c.spark, _written(c), multiline=True)
    gtype, coordinates = F.col("geometry.type"), F.col("geometry.coordinates")
    polys = F.when(gtype == "Polygon", F.array(F.from_json(coordinates, "array<array<array<double>>>"))).otherwise(
        F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.flatten("polys")
    return read.select(*[F.col("properties")[n].alias(n) for n in ("region_id", "region_name", "region_short")],
                       gtype.alias("gtype"), polys.alias("polys")).select(
        "region_id", "region_name", "region_short", "gtype", F.size("polys").cast("bigint").alias("polygons"),
        F.size(rings).cast("bigint").alias("rings"), F.size(F.flatten(rings)).cast("bigint").alias("vertices"))


@query("s5_collection_scan", sql("SELECT region_id AS feature, gtype, poly_no, ring_no, pos, x, y FROM written_vertices",
                                 "written_vertices"))
def _s5(c):
    """Every vertex of the one document, read by as many tasks as it has splits."""
    return geojson.read_features(c.spark, _written(c), label="region_id", multiline=True)


@query("j3_mapped_features", sql("SELECT * FROM feature_props", "feature_props"))
def _j3(c):
    return _props(c)


@query("j3_unmapped_labels", sql("""SELECT DISTINCT feature FROM ring_lines
  WHERE feature NOT IN (SELECT label FROM test_labels)""", "ring_lines", "test_labels"))
def _j3u(c):
    _, unmapped = geo.map_labels(_vertices(c).select("feature", "gtype").distinct(), geo.test_labels(c.t))
    return unmapped


@query("j1_region_names", sql("""SELECT a.*,
    COALESCE(fp.region_name, nm.region_name, 'Region ' || a.region_id) AS region_name,
    COALESCE(fp.region_short, nm.region_short, 'Reg ' || a.region_id) AS region_short
  FROM agg_region a
  LEFT JOIN (SELECT region_id, MIN(region_name) AS region_name, MIN(region_short) AS region_short
             FROM feature_props GROUP BY region_id) fp ON a.region_id = fp.region_id
  LEFT JOIN region_names nm ON a.region_id = nm.region_id""", "agg_region", "feature_props", "region_names"))
def _j1(c):
    return geo.region_names(c.agg_region, _props(c), geo.names_table(c.spark))


@query("j2_features_budget", sql("""SELECT f.region_id, f.feature, f.gtype, f.region_name, f.region_short,
    a.line_items, a.total_php, a.ps_php, a.mooe_php, a.co_php, a.fe_php, a.department_count, a.agency_count
  FROM feature_props f LEFT JOIN agg_region a ON f.region_id = a.region_id""", "feature_props", "agg_region"))
def _j2(c):
    return geo.features_with_budget(_props(c), c.agg_region)

"""Geometry: distributed Douglas-Peucker against a brute-force recursion."""

import json
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import geo
from tallyframe.plans.context import Ledger
from tallyframe.sources import geojson
from tests.conftest import SF001


def seg_dist(p, a, b):
    """Smallest distance over the chord: at an end, or |area| / base where the foot lies inside."""
    ends = min(math.dist(p, a), math.dist(p, b))
    base = math.dist(a, b)
    if base == 0:
        return ends
    foot = sum((q - s) * (e - s) for q, s, e in zip(p, a, b, strict=True)) / base
    if not 0 <= foot <= base:
        return ends
    return abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / base


def brute_dp(pts, eps):
    """Plain Douglas-Peucker with an explicit stack; returns kept indices."""
    keep = {0, len(pts) - 1}
    stack = [(0, len(pts) - 1)]
    while stack:
        lo, hi = stack.pop()
        best, at = 0.0, None
        for i in range(lo + 1, hi):
            d = seg_dist(pts[i], pts[lo], pts[hi])
            if d > best:
                best, at = d, i
        if at is not None and best > eps:
            keep.add(at)
            stack += [(lo, at), (at, hi)]
    return sorted(keep)


def brute_rings(rows, eps):
    rings = defaultdict(list)
    for r in rows:
        rings[(r.feature, r.poly_no, r.ring_no)].append((r.pos, r.x, r.y))
    out = {}
    for k, pts in rings.items():
        pts.sort()
        xy = [(x, y) for _, x, y in pts]
        s = [xy[i] for i in brute_dp(xy, eps)]
        if s[0] != s[-1]:
            s.append(s[0])
        s = [(round(x, 2), round(y, 2)) for x, y in s]
        if len(s) >= 4:
            out[k] = s
    return out


@pytest.fixture(scope="module")
def vertices(spark):
    return geo.ring_vertices(Ledger(spark, SF001).t).cache()


def test_distributed_dp_equals_brute_force(vertices):
    eps = 0.015
    got = defaultdict(list)
    for r in geo.simplify_rings(vertices, eps).collect():
        got[(r.feature, r.poly_no, r.ring_no)].append((r.pos, r.x, r.y))
    got = {k: [(x, y) for _, x, y in sorted(v)] for k, v in got.items()}
    want = brute_rings(vertices.collect(), eps)
    assert got == want
    rings = vertices.select("feature", "poly_no", "ring_no").distinct().count()
    assert 0 < len(want) < rings   # the tiny rings fall below 4 points


def test_tiny_rings_dropped_and_totals(vertices):
    kept = geo.simplify_rings(vertices, 0.015)
    t = geo.vertex_totals(vertices, kept).first()
    assert t.before == vertices.count() and 0 < t.after < t.before
    tiny = vertices.where(F.col("x") != F.col("x")).count()  # no NaNs
    assert tiny == 0
    small = {k for k in geo.vertex_counts(kept).collect() if k.vertices < 4}
    assert not small


def circle(cx, cy, r, n=2000):
    pts = [[cx + r * math.cos(2 * math.pi * i / n + 0.001 * math.sin(i)),
            cy + r * math.sin(2 * math.pi * i / n)] for i in range(n)]
    return pts + [pts[0]]


def document(folder):
    """The features of a written document: its part files in the order of their names."""
    doc = json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    assert doc["type"] == "FeatureCollection"
    return doc["features"]


def test_geojson_round_trip(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"REGION": "Metropolitan Manila"},
         "geometry": {"type": "Polygon", "coordinates": [circle(121.0, 14.6, 0.3)]}},
        {"type": "Feature", "properties": {"REGION": "Caraga (Region XIII)"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[circle(125.5, 9.0, 0.5)],
                                                              [circle(126.0, 9.8, 0.004, 50)]]}},
        {"type": "Feature", "properties": {"REGION": "Atlantis"},
         "geometry": {"type": "Polygon", "coordinates": [circle(0.0, 0.0, 1.0, 100)]}}]}
    src = tmp_path / "regions.geojson"
    src.write_text(json.dumps(fc))
    v = geojson.read_features(spark, str(src), multiline=True)
    assert v.count() == 2001 + 2001 + 51 + 101
    feats = v.select("feature", "gtype").distinct()
    mapped, unmapped = geo.map_labels(feats, geo.label_table(spark))
    assert [r.feature for r in unmapped.collect()] == ["Atlantis"]
    kept = geo.simplify_rings(v.join(mapped.select("feature"), "feature", "left_semi"), 0.015)
    out = geojson.write_collection(kept, mapped, str(tmp_path / "out"))
    docs = document(tmp_path / "out")
    assert [d["properties"]["region_id"] for d in docs] == ["13", "16"]
    ncr, caraga = docs
    assert ncr["geometry"]["type"] == "Polygon" and len(ncr["geometry"]["coordinates"]) == 1
    ring = ncr["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and 4 <= len(ring) < 200
    assert caraga["geometry"]["type"] == "MultiPolygon" and len(caraga["geometry"]["coordinates"]) == 1
    back = geojson.read_features(spark, out, label="region_id", multiline=True)
    assert back.count() == kept.count()


def test_distributed_rounds_equal_local_finish(vertices):
    """Forcing every split through distributed rounds gives the same vertices as local finishing."""
    a = geo.simplify(vertices, 0.015, local_points=0)
    b = geo.simplify(vertices, 0.015)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_no_round_limit_on_a_zigzag(spark):
    rows = [("z", 0, 0, i, float(i), float(i % 2) * (1 + i * 0.01)) for i in range(24)]
    v = spark.createDataFrame(rows, "feature string, poly_no long, ring_no long, pos long, x double, y double")
    a, b = geo.simplify(v, 0.01, local_points=3), geo.simplify(v, 0.01)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_nan_vertices_are_skipped_on_both_paths(spark):
    ys = [0.0, 1.0, float("nan"), 2.0, 0.5, 0.0]
    rows = [("n", 0, 0, i, float(i), y) for i, y in enumerate(ys)]
    v = spark.createDataFrame(rows, "feature string, poly_no long, ring_no long, pos long, x double, y double")
    kept = [sorted(r.pos for r in geo.simplify(v, 0.1, local_points=n).collect()) for n in (0, 50)]
    assert kept[0] == kept[1] and 2 not in kept[0] and 3 in kept[0]


def test_feature_lines_input_and_other_geometry_types(spark, tmp_path):
    lines = [
        {"type": "Feature", "properties": {"REGION": "Metropolitan Manila"},
         "geometry": {"type": "Polygon", "coordinates": [circle(121.0, 14.6, 0.3, 300)]}},
        {"type": "Feature", "properties": {"REGION": "Caraga (Region XIII)"},
         "geometry": {"type": "Point", "coordinates": [125.5, 9.0]}},
    ]
    src = tmp_path / "features.jsonl"
    src.write_text("\n".join(json.dumps(x) for x in lines))
    v = geojson.read_features(spark, str(src))
    got = {(r.feature, r.gtype): r.n for r in v.groupBy("feature", "gtype").count().withColumnRenamed("count", "n").collect()}
    assert got == {("Metropolitan Manila", "Polygon"): 301}
    assert v.select("poly_no").distinct().count() == 1 and v.agg(F.max("pos")).first()[0] == 300
    others = geojson.read_other_geometries(spark, str(src))
    feats = v.select("feature", "gtype").unionAll(others.select("feature", "gtype")).distinct()
    mapped, _ = geo.map_labels(feats, geo.label_table(spark))
    geojson.write_collection(geo.simplify_rings(v, 0.015), mapped, str(tmp_path / "out"), others)
    out = document(tmp_path / "out")
    points = [d for d in out if d["geometry"]["type"] == "Point"]
    assert len(out) == 2 and points[0]["geometry"]["coordinates"] == [125.5, 9.0]


def test_salts_follow_the_largest_ring(spark, vertices, monkeypatch):
    want = {(r.feature, r.poly_no, r.ring_no, r.pos) for r in geo.simplify(vertices, 0.015, local_points=20).collect()}
    counts = geo.vertex_counts(vertices).withColumnRenamed("vertices", "n")
    assert geo._salts(counts) == geo._salts(counts.limit(0)) == geo.SALTS
    most = counts.agg({"n": "max"}).first()[0]
    monkeypatch.setattr(geo, "LOCAL_SEGMENT_POINTS", 2)
    monkeypatch.setattr(geo, "SALTS", 1)
    assert geo._salts(counts) == -(-most // 2) > 1
    assert {(r.feature, r.poly_no, r.ring_no, r.pos) for r in geo.simplify(vertices, 0.015, local_points=20).collect()} == want
    monkeypatch.setattr(geo, "MOST_SALTS", 3)
    assert geo._salts(counts) == 3

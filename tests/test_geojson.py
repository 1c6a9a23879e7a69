"""One FeatureCollection document read and written by many tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import geojson
from tests.test_geo import document


def tricky(rnd, n):
    """Features with braces, brackets, quotes and escapes in their strings, members in any order, foreign members."""
    marks = ['}', '{', '[', ']', '"', "\\", "é", "\n", "x", '\\"}', '"type":"Feature"', "]}}"]
    feats = []
    for i in range(n):
        text = lambda: "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 6)))
        members = {"type": "Feature", "properties": {"REGION": f"r{i}", text(): text(), "n": i},
                   "geometry": {"type": "Polygon", "coordinates": [[[rnd.random(), k] for k in range(rnd.choice([4, 5, 60]))]]}}
        if rnd.random() < 0.3:
            members["extra"] = {"a": [{"b": text()}], "c": [[], {}]}
        keys = list(members)
        rnd.shuffle(keys)
        feats.append({k: members[k] for k in keys})
    doc = {"name": 'a "}{[" b', "crs": {"type": "name", "properties": {"name": "x}"}}, "bbox": [1, 2, 3, 4],
           "features": feats, "type": "FeatureCollection", "after": [{"type": "Other"}]}
    keys = list(doc)
    rnd.shuffle(keys)
    return {k: doc[k] for k in keys}


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", [800, 6000, 1 << 27])
def test_one_document_in_many_splits(spark, tmp_path, indent, split, monkeypatch):
    doc = tricky(random.Random(split), 60)
    src = tmp_path / "doc.geojson"
    src.write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(indent)))
    monkeypatch.setattr(geojson, "SCAN_CHARS", 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = spark.read.option("lineSep", "}").text(str(src))
        tasks = scan.select(F.spark_partition_id().alias("p")).distinct().count()
        got = geojson.collection_features(spark, str(src)).collect()
        assert geojson.read_features(spark, str(src), multiline=True).count() == sum(
            len(f["geometry"]["coordinates"][0]) for f in doc["features"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    read = sorted((json.loads(r.text) for r in got), key=lambda f: (f["type"], f.get("properties", {}).get("n", -1)))
    assert [f for f in read if f["type"] == "Feature"] == doc["features"]
    if split <= 6000:
        assert tasks > 3


def test_no_features(spark, tmp_path):
    for i, text in enumerate(['{"type":"FeatureCollection","features":[]}', "{}", '{"features": [ ] }\n']):
        src = tmp_path / f"{i}.json"
        src.write_text(text)
        assert geojson.read_features(spark, str(src), multiline=True).count() == 0


PROPS = "feature string, gtype string, region_id string, region_name string, region_short string"
VERTICES = "feature string, poly_no long, ring_no long, pos long, x double, y double"


@pytest.mark.parametrize("partitions", [1, 7, 30])
def test_a_feature_is_written_over_many_tasks(spark, tmp_path, partitions, monkeypatch):
    rnd = random.Random(partitions)
    monkeypatch.setattr(geojson, "CHUNK_CHARS", 300)
    rows, want = [], {}
    for f, gtype in (("big", "Polygon"), ("multi", "MultiPolygon"), ("tiny", "MultiPolygon"), ("one", "Polygon")):
        polys = {"big": 1, "one": 1, "tiny": 1, "multi": 5}[f]
        coords = []
        for p in range(polys):
            rings = []
            for r in range({"big": 3, "one": 1, "tiny": 1, "multi": 2}[f]):
                n = {"big": 800, "one": 1, "tiny": 4, "multi": rnd.randint(4, 50)}[f]
                ring = [(rnd.randint(0, 10 ** 6), rnd.randint(-999, 999) / 8, rnd.randint(-999, 999) / 8) for _ in range(n)]
                ring = sorted({q[0]: q for q in ring}.values())
                rows += [(f, 7 * p, 3 * r + 1, *q) for q in ring]
                rings.append([[x, y] for _, x, y in ring])
            coords.append(rings)
        want[f] = (gtype, coords[0] if gtype == "Polygon" else coords)
    rnd.shuffle(rows)
    v = spark.createDataFrame(rows, VERTICES).repartition(5)
    props = spark.createDataFrame([("big", "Polygon", "03", "B", None), ("multi", "MultiPolygon", "01", 'M "q"', "m"),
                                   ("tiny", "MultiPolygon", "02", "T", "t"), ("one", "Polygon", "02", "O", "o"),
                                   ("point", "Point", "02", "P", "p")], PROPS)
    others = spark.createDataFrame([("point", "Point", "[1.5,2.5]")], "feature string, gtype string, coordinates string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = geojson.write_collection(v, props, str(tmp_path / "out"), others)
        back = geojson.read_features(spark, out, label="region_name", multiline=True)
        counts = {r.feature: r["count"] for r in back.groupBy("feature").count().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    feats = document(tmp_path / "out")
    assert [(f["properties"]["region_id"], f["properties"]["region_name"]) for f in feats] == [
        ("01", 'M "q"'), ("02", "O"), ("02", "P"), ("02", "T"), ("03", "B")]
    got = {n: (f["geometry"]["type"], f["geometry"]["coordinates"]) for n, f in zip(("multi", "one", "point", "tiny", "big"), feats, strict=True)}
    assert got.pop("point") == ("Point", [1.5, 2.5])
    assert got == want
    assert feats[4]["properties"] == {"region_id": "03", "region_name": "B", "region_short": None}
    assert counts == {"B": sum(map(len, want["big"][1])), 'M "q"': sum(len(r) for p in want["multi"][1] for r in p), "T": len(want["tiny"][1][0][0]), "O": 1}
    if partitions == 30:
        assert len([p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]) > 10


def test_an_empty_collection_is_a_document(spark, tmp_path):
    out = geojson.write_collection(spark.createDataFrame([], VERTICES), spark.createDataFrame([], PROPS), str(tmp_path / "none"))
    assert document(tmp_path / "none") == [] and geojson.read_features(spark, out, multiline=True).count() == 0

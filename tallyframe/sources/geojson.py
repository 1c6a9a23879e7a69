"""GeoJSON features <-> the vertex table.

Features come one a line, or in one FeatureCollection document of any size, in one file or in the part files of
``write_collection`` in the order of their names. A document is read by many tasks (``collection_features``)
and written by many (``write_collection``): neither holds more than a feature, the writer not even that.
``coordinates`` is read as raw JSON text and parsed by geometry type: schema inference cannot type mixed
Polygon/MultiPolygon coordinates.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import scratch_path

GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
FEATURE = T.StructType([T.StructField("type", T.StringType()),
                        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("geometry", GEOMETRY)])
SCAN_CHARS = 1 << 20               # scanned at once, or one longer piece up to a closing brace
CHUNK_CHARS = 1 << 16              # of written text in a row


# ---------------------------------------------------------------- one document, read in parallel

_OPEN, _CLOSE = b"{[", b"}]"


def _structure(text: bytes, in_string: bool):
    """(places of brackets outside strings, depth after each from 0, whether the end is inside a string)."""
    if b"\\" in text:
        text = re.sub(rb"\\.", b"__", text, flags=re.DOTALL)
    data = np.frombuffer(text, np.uint8)
    quotes = np.cumsum(data == 34) + int(in_string)
    opens, closes = (data == 123) | (data == 91), (data == 125) | (data == 93)
    at = np.flatnonzero((opens | closes) & (quotes % 2 == 0))
    return at, np.cumsum(np.where(opens[at], 1, -1)), bool((quotes[-1] if len(quotes) else int(in_string)) % 2)


def _summary(text: bytes, in_string: bool):
    """(brackets closed that are not opened here, those left open, whether the end is inside a string)."""
    at, depth, inside = _structure(text, in_string)
    if not len(at):
        return 0, "", inside
    later = np.minimum.accumulate(depth[::-1])[::-1]
    is_open = np.isin(np.frombuffer(text, np.uint8)[at], np.frombuffer(_OPEN, np.uint8))
    left = at[is_open & (later >= depth)]
    return max(0, -int(depth.min())), "".join(chr(text[i]) for i in left), inside


def _then(a, b):
    """The summary of a text after another."""
    closed, left, _ = a
    more, opened, inside = b
    return closed + max(0, more - len(left)), left[:max(0, len(left) - more)] + opened, inside


def _runs(batches):
    """(key of a block, whether it is new, text, whether a brace follows it) in pieces of the block; the brace
    that ends a row was its separator, the one after a block's last row is left to the caller."""
    key, held, size = None, [], 0
    for b in batches:
        for value, path, start in zip(*(b.column(c).to_pylist() for c in ("value", "path", "start")), strict=True):
            if key != (path, start):
                if key is not None:
                    yield key, "}".join(held), True
                key, held, size = (path, start), [], 0
            elif size > SCAN_CHARS:
                yield key, "}".join(held) + "}", False
                held, size = [], 0
            held.append(value)
            size += len(value) + 1
    if key is not None:
        yield key, "}".join(held), True


def _summary_batches(batches):
    states = [(0, "", False), (0, "", True)]
    for (path, start), text, ends in _runs(batches):
        text = text.encode()
        states = [_then(s, _summary(text, s[2])) for s in states]
        if ends:
            flat = [x for s in states for x in s]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, start, *flat)],
                                             names=["path", "start", "c0", "o0", "i0", "c1", "o1", "i1"])
            states = [(0, "", False), (0, "", True)]


def _block_states(rows) -> dict:
    """block -> (number, inside a string, open brackets, block where the open feature began, last of its file)."""
    rows = sorted(rows, key=lambda r: (r["path"], r["start"]))
    stack, inside, owner, states = "", False, None, {}
    for number, r in enumerate(rows):
        last = number + 1 == len(rows) or rows[number + 1]["path"] != r["path"]
        states[r["path"], r["start"]] = number, inside, stack, owner, last
        closed, opened, ends_inside = (r["c1"], r["o1"], r["i1"]) if inside else (r["c0"], r["o0"], r["i0"])
        least = len(stack) - closed
        stack, inside = stack[:max(0, least)] + opened, ends_inside
        if not last and not inside:
            stack = stack[:-1]
            least = min(least, len(stack))
        if stack.startswith("{[{"):
            owner = number if owner is None or least <= 2 else owner
        else:
            owner = None
    return states


def _feature_batches(states: dict):
    """(owner, number of its piece, piece of a feature's text); owner -1: a whole feature."""
    def run(batches):
        key, rows, size = None, [], 0
        for at, text, ends in _runs(batches):
            if key != at:
                if at not in states:
                    raise RuntimeError("the splits of the document changed between its two scans")
                key = at
                number, inside, stack, owner, last = states[key]
                stack, piece, began = list(stack), [], not ("".join(stack[:3]) == "{[{")
                owner = None if began else owner
            if ends and not last:
                text += "}"
            raw = text.encode()
            places, depth, ends_inside = _structure(raw, inside)
            # only brackets at the levels of the document, its arrays and their objects matter; deeper ones are counted
            base = len(stack)
            before = np.concatenate([[0], depth[:-1]]) + base
            shallow = np.flatnonzero(np.minimum(before, depth + base) <= 2)
            start = 0 if "".join(stack[:3]) == "{[{" else None
            top = stack[:3]
            for i in shallow.tolist():
                c = chr(raw[places[i]])
                if c in "{[":
                    top = top[:int(before[i])] + [c]
                    if top == ["{", "[", "{"]:
                        start, owner, piece = int(places[i]), None, []
                else:
                    if top == ["{", "[", "{"] and c == "}" and start is not None:
                        piece.append(raw[start:places[i] + 1])
                        rows.append((-1, 0, b"".join(piece)) if owner is None else (owner, number, b"".join(piece)))
                        size += len(rows[-1][2])
                        start, owner, piece = None, None, []
                    top = top[:max(0, int(depth[i]) + base)]
            if start is not None:
                piece.append(raw[start:])
            inside = ends_inside
            after = base + (int(depth[-1]) if len(depth) else 0)
            stack = top[:min(3, after)] + ["?"] * max(0, after - 3)
            if ends and piece:
                rows.append((number if owner is None else owner, number, b"".join(piece)))
            if size > SCAN_CHARS or ends:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], names=["owner", "number", "piece"])
                rows, size = [], 0
    return run


def collection_features(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each Feature of one FeatureCollection document, read by as many tasks as it has splits.

    The document is split at closing braces, so a task starts anywhere in it. A first scan tells for each split
    which brackets it closes and leaves open, for either case of starting inside a string; put one after
    another (one row for each split, as in the scan's own file list), they give every split its place in the
    document. A second scan takes the features out, and those that reach over splits are put together.
    """
    scan = (spark.read.option("lineSep", "}").text(path)
            .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")))
    states = _block_states(scan.mapInArrow(
        _summary_batches, "path string, start long, c0 long, o0 string, i0 boolean, c1 long, o1 string, i1 boolean").collect())
    out = scratch_path(spark, "features")
    pieces = scan.mapInArrow(_feature_batches(states), "owner long, number long, piece string")
    pieces.write.parquet(out)
    pieces = spark.read.schema(pieces.schema).parquet(out)
    over = (pieces.where("owner >= 0").groupBy("owner")
            .agg(F.sort_array(F.collect_list(F.struct("number", "piece"))).alias("p"))          # splits of one feature
            .select(F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text")))
    return pieces.where("owner < 0").select(F.col("piece").alias("text")).unionAll(over)


def features(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(type, properties, geometry) of Features: of one FeatureCollection document (``multiline``) or one a line."""
    if multiline:
        parsed = collection_features(spark, path).select(F.from_json("text", FEATURE).alias("f")).select("f.*")
        return parsed.where("type = 'Feature'")
    return spark.read.schema(FEATURE).json(path)


def vertices(feats: DataFrame, label: str = "REGION") -> DataFrame:
    """G1: features -> vertex rows (feature, gtype, poly_no, ring_no, pos, x, y).

    Polygons are normalised to one-polygon MultiPolygons; other geometry types have no rings and
    yield no vertices (``other_geometries``).
    """
    g = F.col("geometry")
    polys = (F.when(g.type == "Polygon", F.array(F.from_json(g.coordinates, "array<array<array<double>>>")))
             .when(g.type == "MultiPolygon", F.from_json(g.coordinates, "array<array<array<array<double>>>>")))
    f = feats.select(F.col("properties")[label].alias("feature"), g.type.alias("gtype"), polys.alias("polys"))
    p = f.select("feature", "gtype", F.posexplode("polys").alias("poly_no", "poly"))
    r = p.select("feature", "gtype", "poly_no", F.posexplode("poly").alias("ring_no", "ring"))
    v = r.select("feature", "gtype", "poly_no", "ring_no", F.posexplode("ring").alias("pos", "xy"))
    return v.select("feature", "gtype", *[F.col(c).cast("bigint").alias(c) for c in ("poly_no", "ring_no", "pos")],
                    F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def other_geometries(feats: DataFrame, label: str = "REGION") -> DataFrame:
    """Features without rings (points, lines) as (feature, gtype, coordinates), to be passed through."""
    g = F.col("geometry")
    return (feats.where(~g.type.isin("Polygon", "MultiPolygon"))
            .select(F.col("properties")[label].alias("feature"), g.type.alias("gtype"), g.coordinates.alias("coordinates")))


def read_features(spark: SparkSession, path: str, label: str = "REGION", multiline: bool = False) -> DataFrame:
    """S5 + G1: the vertex rows of a file's features."""
    return vertices(features(spark, path, multiline), label)


def read_other_geometries(spark: SparkSession, path: str, label: str = "REGION", multiline: bool = False) -> DataFrame:
    """S5 + G4: a file's features without rings."""
    return other_geometries(features(spark, path, multiline), label)


# ---------------------------------------------------------------- one document, written in parallel

# what a row of the stream is; marks that open come before the vertex they share a place with, those that close after it
_HEADER, _FEATURE, _POLYGON, _RING, _VERTEX, _RING_END, _POLYGON_END, _FEATURE_END, _FOOTER = range(-4, 5)
_ORDER = ("region_id", "feature", "poly_no", "ring_no", "pos")


def _chunk_batches(batches):
    """The stream as text: a comma before everything but what follows the mark that opens it.

    A task's rows begin with a vertex that follows one, or with an opening mark that follows a closed
    sibling, since an opening mark has the place of the first vertex in it and places are not split.
    """
    last, out, size = None, [], 0
    for b in batches:
        for kind, text in zip(b.column("kind").to_pylist(), b.column("json").to_pylist(), strict=True):
            if _FEATURE <= kind <= _VERTEX and last != kind - 1:
                out.append(",")
            out.append(text)
            size += len(text) + 1
            last = kind
            if size > CHUNK_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(["".join(out)])], names=["value"])
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(["".join(out)])], names=["value"])


def collection_chunks(v: DataFrame, props: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """A FeatureCollection ordered by region_id and feature, as rows of text in order.

    ``v``: vertex rows (feature, poly_no, ring_no, pos, x, y); ``props``: (feature, gtype, region_id,
    region_name, region_short); ``others``: features whose coordinates pass through as they are.
    Vertices and the marks that open and close rings, polygons and features are sorted by ranges of their
    places and written as they come, so a feature may be larger than a task's memory.
    """
    names = F.to_json(F.struct("region_id", "region_name", "region_short"), {"ignoreNullFields": "false"})
    opening = F.concat(F.lit('{"type":"Feature","properties":'), names, F.lit(',"geometry":{"type":"'), F.col("gtype"),
                       F.lit('","coordinates":'))
    multi = F.col("gtype") == "MultiPolygon"
    rings = v.groupBy("feature", "poly_no", "ring_no").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    polys = rings.groupBy("feature", "poly_no").agg(F.min(F.struct("ring_no", F.col("p0").alias("pos"))).alias("a"),
                                                    F.max(F.struct("ring_no", F.col("p1").alias("pos"))).alias("z"))
    feats = polys.groupBy("feature").agg(F.min(F.struct("poly_no", "a")).alias("a"), F.max(F.struct("poly_no", "z")).alias("z"))

    def rows(df, kind, text, poly="poly_no", ring="ring_no", pos="pos"):
        return df.select("region_id", "feature", F.col(poly).alias("poly_no"), F.col(ring).alias("ring_no"),
                         F.col(pos).alias("pos"), F.lit(kind).alias("kind"), text.alias("json"))

    own = props.select("feature", "region_id")
    r, p, f = rings.join(own, "feature"), polys.join(own, "feature"), feats.join(props, "feature")
    first, last = ("a.poly_no", "a.a.ring_no", "a.a.pos"), ("z.poly_no", "z.z.ring_no", "z.z.pos")
    bodies = [
        rows(v.join(own, "feature"), _VERTEX, F.to_json(F.array("x", "y"))),
        rows(r, _RING, F.lit("["), pos="p0"), rows(r, _RING_END, F.lit("]"), pos="p1"),
        rows(p, _POLYGON, F.lit("["), "poly_no", "a.ring_no", "a.pos"),
        rows(p, _POLYGON_END, F.lit("]"), "poly_no", "z.ring_no", "z.pos"),
        rows(f, _FEATURE, F.concat(opening, F.when(multi, "[").otherwise("")), *first),
        rows(f, _FEATURE_END, F.when(multi, "]}}").otherwise("}}"), *last)]
    starts = rows(f, _FEATURE, F.lit(""), *first)
    ends = rows(f, _FEATURE_END, F.lit(""), *last)
    if others is not None:
        none = F.lit(None).cast("bigint")
        o = others.join(props, ["feature", "gtype"]).select("*", *[none.alias(c) for c in _ORDER[2:]])
        whole = rows(o, _FEATURE, F.concat(opening, F.col("coordinates"), F.lit("}}")))
        bodies.append(whole)
        starts, ends = starts.unionAll(whole), ends.unionAll(whole)
    place = F.struct(*_ORDER)
    for kind, found, text in ((_HEADER, starts.agg(F.min(place).alias("at")), '{"type":"FeatureCollection","features":['),
                              (_FOOTER, ends.agg(F.max(place).alias("at")), "]}")):
        bodies.append(found.select("at.*", F.lit(kind).alias("kind"), F.lit(text).alias("json")))
    stream = bodies[0]
    for b in bodies[1:]:
        stream = stream.unionAll(b)
    stream = stream.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER, "kind")
    return stream.select("kind", "json").mapInArrow(_chunk_batches, "value string")


def write_collection(v: DataFrame, props: DataFrame, path: str, others: DataFrame | None = None) -> str:
    """Write ``collection_chunks``; the part files in the order of their names are one JSON document."""
    collection_chunks(v, props, others).write.mode("overwrite").text(path)
    return path

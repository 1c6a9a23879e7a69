"""Fingerprints against a plain computation: wide lanes, likeness, and the circle of rows under null and shared ids."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import fingerprint as fp

SCHEMA = "doc_id long, text string"


def hashes(paragraph: str):
    d = hashlib.sha256(paragraph.encode()).hexdigest().encode()
    return [xxhash.xxh64(d, seed=xxhash.xxh64(k.to_bytes(4, "little"), seed=42).intdigest()).intdigest()
            for k in range(fp.WIDE // 2 + fp.HASHES)]


def plain(text: str):
    """(wide lanes, sketch lanes, paragraphs)"""
    parts = [p for p in re.split(fp.BREAK, text) if p.strip(" ")]
    wide, lanes = [0] * fp.WIDE, [0] * fp.LANES
    for h in map(hashes, parts):
        for i in range(fp.WIDE):
            wide[i] = (wide[i] + (h[i // 2] >> 32 * (i % 2)) % 2**32) % 2**32
        for i in range(fp.LANES):
            lanes[i] += h[fp.WIDE // 2 + i // 64] >> i % 64 & 1
    return wide, lanes, len(parts)


def plain_hex(text: str) -> str:
    wide, lanes, _ = plain(text)
    return "".join(f"{x:08x}" for x in wide) + "".join(f"{a + (b << 32):016x}" for a, b in zip(lanes[::2], lanes[1::2], strict=True))


def plain_likeness(a: str, b: str) -> float:
    (_, x, n), (_, y, m) = plain(a), plain(b)
    u, v = [2 * i - n for i in x], [2 * i - m for i in y]
    size = sum(i * i for i in u) + sum(i * i for i in v)
    return max(0.0, min(1.0, 1 - sum((i - j) ** 2 for i, j in zip(u, v, strict=True)) / size)) if size else 1.0


def texts(seed: int, n: int):
    rnd = random.Random(seed)
    line = [f"line {i} é😀" for i in range(12)]
    return ["\n".join(rnd.choice(line) for _ in range(rnd.randint(0, 9))) + rnd.choice(["", " One. Two! ", "\n \n"]) for _ in range(n)]


def expected(rows):
    """Rows in the order of the operator, each with what it must return."""
    keyed = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1] or ""), (r[1] or "").encode()))
    out = []
    for i, (doc, t) in enumerate(keyed):
        t, nxt = t or "", keyed[(i + 1) % len(keyed)][1] or ""
        q = len(t) // 4
        e = t[:len(t) - q] + nxt[:q]
        out.append((str(doc), len(t), hashlib.sha256(e.encode()).hexdigest(), plain_hex(t), plain_hex(e),
                    round(plain_likeness(t, e), 9), round(plain_likeness(t, nxt), 9)))
    return sorted(out)


def signed(text: str) -> int:
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - 2**64 if h >> 63 else h


IDS = {
    "own ids": lambda i: i, "no ids": lambda i: None, "one id": lambda i: 7, "a third null": lambda i: i if i % 3 else None,
    "a hot id among others": lambda i: 40 if i % 3 == 0 else i, "two ids": lambda i: i % 2,
}


@pytest.mark.parametrize("name", list(IDS))
def test_edited_equals_the_plain_computation(spark, name):
    rows = [(IDS[name](i), t) for i, t in enumerate([*texts(3, 90), None, "", "same", "same"])]
    got = fp.edited(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                   round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == expected(rows)


def test_one_row_follows_itself(spark):
    for rows in ([(1, "abcd. efgh")], [(None, "abcd. efgh")], [(1, "same"), (1, "same")]):
        got = fp.edited(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == len(rows) and all(r.near_next == 1.0 for r in got)
        assert [r.edited_sha256 for r in got] == [x[2] for x in expected(rows)]


@pytest.mark.parametrize("value", [None, 40])
def test_shared_ids_spread_over_buckets(spark, value):
    df = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.lit(value)).otherwise(F.col("id")).alias("doc_id"),
                                          F.concat(F.lit("text "), F.col("id")).alias("text"))
    sizes = [r["count"] for r in fp.in_order(df, 20).groupBy("bucket").count().collect()]
    assert len(sizes) >= 18 and max(sizes) < 450


def test_paragraphs_are_inserted_and_deleted(spark):
    a, b = "First. Second.\nThird.\nThird.", "Third.\nNew one."
    rows = spark.createDataFrame([(0, a), (1, b), (2, "New one. " + a + "\nThird.")], SCHEMA)
    f = fp.sums(rows, ["doc_id"], "text")
    pair = f.groupBy().pivot("doc_id", [0, 1, 2]).agg(F.first("fp"))
    more, less = fp.combine(F.col("0"), F.col("1")), fp.combine(F.col("2"), F.col("1"), -1)
    row = pair.select(fp.hex_of(more).alias("more"), fp.hex_of(less).alias("less")).first()
    assert (row.more, row.less) == (plain_hex(b + "\n" + a), plain_hex(a))

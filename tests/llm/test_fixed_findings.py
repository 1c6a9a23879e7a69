"""Token ids on fuzzed texts, licence units at the bound and inside longer ones, clashing columns, null and repeated ids."""

import collections
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tallyframe.llm import audit, codes, crf, fingerprint, forest, hf, infill, license, packing, pii, piece, queries, rules, toxic
from tests.conftest import SF001

ALPHABET = (list(map(chr, range(0x20, 0x250))) + list("ⱥⱦẞßİıſKÅǅ中文😀́​\xa0\t\n\r'") + ["'s", "'ll", "<|", "|>", "  "])


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_of_fuzzed_texts_equal_the_library(name, spaced):
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    letters = [c for c in ALPHABET if len(c) == 1 and c.isalpha()]
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 12))) for _ in range(8000)]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) for _ in range(4000)] + ["gȺb", "ȾX Ⱥ", "İstanbul"]
    tok = Tokenizer.from_file(queries.tokenizer(name))
    tok.encode_special_tokens = True
    flat, n = hf.chunk_ids(queries.tokenizer(name), spaced).texts(texts)
    ends = np.cumsum(n)
    wrong = [t for t, a, b, e in zip(texts, ends - n, ends, tok.encode_batch(texts, add_special_tokens=False), strict=True)
             if flat[a:b].tolist() != e.ids]
    assert wrong == []


NOTICES = {
    "mit": ["MyTool, copyright 2024 Jane Doe. Released under the MIT License. See LICENSE for details.",
            "# Released under the MIT License. Enjoy it"],
    "gpl-3.0": ["tool.c - does things.\n *\n * This program is free software: you can redistribute it and/or\n * modify it under "
                "the terms of the GNU General Public License as\n * published by the Free Software Foundation, either version 3 "
                "of the\n * License, or (at your option) any later version.\n *\n * It is distributed in the hope that it helps."],
    "lgpl-3.0": ["Intro! This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                 "your option) any later version. And more text behind it, on the same line"],
    "agpl-3.0": ["x. This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                 "your option) any later version.\n\nnext"],
    "mpl-2.0": ["/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy was not "
                "distributed with this file, get one. */"],
    "cc-by-sa-4.0": ["words words. licensed under cc by-sa 4.0"],
}


def test_notices_inside_longer_units_and_at_the_bound(spark):
    texts = [t for ts in NOTICES.values() for t in ts] + [
        "released under the mit license enjoy it", "# Released under the MIT License, enjoy it all", None, "", "licensed under", "software " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license.scan(docs).collect()
    found = collections.defaultdict(set)
    for r in rows:
        found[r.doc_id].add(r.license)
    wanted = [name for name, ts in NOTICES.items() for _ in ts]
    for i, name in enumerate(wanted):
        assert name in found[i], (name, texts[i], found[i])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(tuple, license.scan(docs).collect())) == sorted(con.execute(license.oracle()).fetchall())
    # 6 bigrams against 4, 4 of them shared: 2 * 4 / 10 is the threshold itself
    assert any(r.dice == license.THRESHOLD for r in rows)


@pytest.mark.parametrize("threshold", [0.8, 0.6, 0.9])
def test_every_unit_at_the_threshold_has_an_anchor(threshold):
    rnd, t = random.Random(3), Fraction(str(threshold))
    chosen = license.anchors(threshold)
    for _, w in license.flat_templates(license.TEMPLATES):
        for _ in range(60):
            unit = [x if rnd.random() < 0.85 else "zz" for x in w]
            unit = unit[rnd.randint(0, 2):len(unit) - rnd.randint(0, 2)] + ["zz"] * rnd.randint(0, 2)
            a, b = (collections.Counter(zip(x, x[1:], strict=False)) for x in (unit, w))
            if a and Fraction(2 * (a & b).total(), a.total() + b.total()) >= t:
                assert any(all(x in " ".join(unit) for x in words) for words in chosen)


CLASH = ("TEXT string, Doc_ID string, _id int, base int, more int, _hash int, _email int, `rest.of it` int, other_columns int, "
         "_0 int, kept int, row_id long, id long, hash long")


@pytest.fixture(scope="module")
def clash(spark):
    """Documents with columns that clash by case or with any name an operator uses."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    others = [f"CAST(7 AS {c.rsplit(' ', 1)[1]}) AS {c.rsplit(' ', 1)[0]}" for c in CLASH.split(", ")]
    return docs, docs.selectExpr("text", *others[:3], "doc_id", "lang", *others[3:], "source", "n_chars")


def rows_of(df, columns):
    at = [df.columns.index(c) for c in columns]
    return sorted((tuple(r[i] for i in at) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op12", "op13"])
def test_clashing_columns_change_no_operator(spark, clash, name):
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    labels = labels.selectExpr("doc_id", "quality", "toxic", "'x' AS QUALITY", "1 AS id", "1 AS y")
    usable = queries.quality_rows
    run = {
        "op1": license.scan, "op3": fingerprint.edited, "op5": rules.line_rules, "op6": forest.near_duplicates, "op10": pii.report,
        "op2": lambda d: crf.score(d, crf.fit(d, labels, usable, 60)), "op9": lambda d: toxic.score(d, toxic.fit(d, labels, usable, 60)),
        "op4": lambda d: piece.digests(d, queries.tokenizer("piece_bpe_32k.model")),
        "op7": lambda d: packing.pack(d, queries.tokenizer("word_bpe_49k.json")),
        "op8": lambda d: codes.round_trip(d, queries.tokenizer("byte_bpe_50k.json")),
        "op12": lambda d: audit.audit(d, labels), "op13": infill.digests}[name]
    plain, clashing = (run(d) for d in clash)
    columns = [c for c in plain.columns if c not in ("row_id", "sequence_id", "offset")]
    assert rows_of(clashing, columns) == rows_of(plain, columns)


@pytest.mark.parametrize("name", ["quality classifier", "quality rules", "n-gram Jaccard join", "PII"])
def test_clashing_columns_change_no_stage(spark, clash, name):
    step = dict(corpus_pipeline.STAGES)[name]
    plain, clashing = (step(spark, d, SF001) for d in clash)
    assert clashing.columns == clash[1].columns
    assert rows_of(clashing, clash[0].columns) == rows_of(plain, clash[0].columns)
    others = [i for i, c in enumerate(clashing.columns) if c not in clash[0].columns]
    assert {r[i] for r in clashing.collect() for i in others} <= {7, "7"}


@pytest.mark.parametrize("ids", ["CAST(NULL AS long)", "5L", "doc_id % 3"])
def test_near_duplicates_without_own_ids(spark, ids):
    """Rows that share an id, or have none, have the classes of their texts: as many, and of the same sizes."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plain = forest.near_duplicates(docs).collect()
    shared = forest.near_duplicates(docs.selectExpr(f"{ids} AS doc_id", "text")).collect()
    for column in ("n_copies", "n_links", "n_text_links"):
        count = lambda rows: sorted((r["text_hash"], r[column]) for r in rows)  # noqa: E731, B023
        assert count(plain) == count(shared), column


def test_fitting_takes_whole_rows_within_its_bounds(spark):
    texts = [(i, "w " * (50 * (i % 7 + 1)) + f"t{i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] * 2 + [(3, f"other {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, quality int")
    from pyspark.sql import functions as F

    rows = crf.labelled_sample(docs, labels, "quality", lambda c: F.lit(True), 60, 20_000)
    assert 0 < len(rows) <= 60 and sum(len(r["text"]) for r in rows) <= 20_000
    assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
    whole = {(i, t) for i, t, _ in texts} | {(3, f"other {k}") for k in range(500)}
    assert {(r["doc_id"], r["text"]) for r in rows} <= whole


def test_removed_lines_are_taken_out_in_order():
    import pyarrow as pa

    rnd = random.Random(8)
    texts = ["\n".join(rnd.choice(["", "a", "b c", "é"]) for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    gone = [sorted(rnd.sample(range(len(t.split("\n"))), rnd.randint(0, len(t.split("\n"))))) or None for t in texts]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(gone, pa.list_(pa.int32()))], names=["text", "removed_lines"])
    out = next(rules._without_lines([b])).column("text").to_pylist()
    assert out == ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in (g or ())) for t, g in zip(texts, gone, strict=True)]

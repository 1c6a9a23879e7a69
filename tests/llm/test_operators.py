"""The training-data operators against brute force, on small fixtures with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tallyframe.llm import codes, crf, fingerprint, forest, license, packing, pii, piece, queries, rules, toxic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text_ string"


def rows_of(texts, sources=None):
    return [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "x") for i, t in enumerate(texts)]


TEXTS = [
    None, "", "   \n \n", "word", "two words", "é 😀 ﬁ ①\n\n  a  b\tc", "a" * 5000, "ab " * 3000,
    "one two three four five six", "one two three four five six", "it's <|endoftext|> we'll\r\nX\x1cY",
    "the same line\nthe same line\nanother | line & more #1\n" * 3,
    "mail a.b@c.de now +1 (212) 555-8457 or 4111 1111 1111 1111 at 10.0.0.1",
    "Released under the MIT License.\nbody text here",
    " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "Delta,", "eps."]) for _ in range(400)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables_and_clashing_columns(empty, docs):
    tok = queries.tokenizer
    for f in (license.scan, fingerprint.edited, rules.line_rules, forest.near_duplicates, pii.report,
              lambda d: piece.digests(d, tok("piece_bpe_32k.model")), lambda d: packing.pack(d, tok("word_bpe_49k.json")),
              lambda d: codes.round_trip(d, tok("byte_bpe_50k.json")), lambda d: crf.score(d, None), lambda d: toxic.score(d, None),
              rules.apply_rules, forest.keep_one, pii.redact):
        assert f(empty).count() == 0
    clash = docs.withColumnRenamed("Text_", "texts_row_id")
    assert forest.near_duplicates(clash).count() == rules.line_rules(clash).count() == len(TEXTS)


def test_pieces_match_the_library(docs):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(piece.digests(docs, path))
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    m, rnd = piece.PieceModel(path), random.Random(7)
    words = ["▁" + "".join(rnd.choice("aberthing") for _ in range(rnd.randint(1, 40))) for _ in range(300)] + ["▁" * 40 + "aaaaaaa"]
    flat, n = m.encode_words(words)
    ends = np.cumsum(n)
    for w, a, b in zip(words, ends - n, ends, strict=True):
        assert flat[a:b].tolist() == sp.encode(w.replace("▁", " ")[1:])


def library_ids(name, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer(name))
    return [e.ids + [end] for e in tok.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codes_round_trip(docs):
    want, at = library_ids("byte_bpe_50k.json", 0), 0
    got = by_id(codes.round_trip(docs, queries.tokenizer("byte_bpe_50k.json")))
    for i, ids in enumerate(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    ids = np.random.default_rng(3).integers(0, 1 << 20, 5000)
    c = codes.Codes(codes.encode(ids))
    assert len(c) == 5000 and c.get(0, 5000).tolist() == ids.tolist()
    for i in (0, 1, 511, 512, 513, 4095, 4999):
        assert c.get(i)[0] == ids[i]
    assert c.get(777, 900).tolist() == ids[777:1677].tolist()
    assert len(codes.Codes(codes.encode(np.zeros(0, int)))) == 0


def test_packing(docs):
    want = library_ids("word_bpe_49k.json", 2)
    rows = packing.pack(docs, queries.tokenizer("word_bpe_49k.json")).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, ids in enumerate(want):
        at = 0
        for p in sorted(pieces[i], key=lambda r: r.start):
            assert p.start == at and p.ids_crc32 == crc(ids[at:at + p.length]) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        # windows are full or a power of two long
        assert at == ps[0].sequence_length <= packing.WINDOW and at & (at - 1) == 0


def test_sum_of_squares_level():
    p, rnd = packing.Packer(lambda *a: None, 64), random.Random(5)
    for _ in range(500):
        n = rnd.randint(1, 63)
        best = min((sum((p.count + _change(h, n)) ** 2), -h) for h in range(64 - n + 1) if h == 0 or p.count[h])
        assert -best[1] == p.level_for(n)
        p.add(0, np.zeros(n, np.uint32))


def _change(h, n):
    d = np.zeros(65, int)
    if h:
        d[h] -= 1
    if h + n < 64:
        d[h + n] += 1
    return d


def test_base_rules_and_frequent_lines(spark, docs):
    got = by_id(rules.line_rules(docs))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    common = "Common  LINE 7 of this host " + " ".join(f"q{k}" for k in range(200))
    texts = [f"{own[i]}\n{common.replace('7', str(i % 10))}" for i in range(20)] + own[20:]
    many = spark.createDataFrame(rows_of(texts, ["h"] * 20 + ["g"] * 10), SCHEMA).repartition(4)
    out = by_id(rules.line_rules(many, host_share=0.5))
    assert [out[i].n_removed_lines for i in range(30)] == [0] + [1] * 19 + [0] * 10
    assert [out[i].kept for i in range(30)] == [True] + [False] * 19 + [True] * 10
    left = by_id(rules.apply_rules(many, host_share=0.5, min_share=0.1))
    assert left[0].text == texts[0] and left[5].text == own[5] and left[5].n_chars == len(own[5])


def test_line_limit_does_not_grow_with_the_host(spark):
    rnd = random.Random(3)
    own = [" ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(60)) for _ in range(3000)]
    texts = [f"{t}\nplanted line" if i < 50 and i % 2 else f"{t}\nrare line" if i < 20 else t for i, t in enumerate(own)]
    for n in (50, 3000):
        out = by_id(rules.line_rules(spark.createDataFrame(rows_of(texts[:n], ["hot"] * n), SCHEMA)))
        assert [i for i in range(n) if out[i].n_removed_lines] == list(range(3, 50, 2))   # 25 carriers; 10 of the other are not enough


def test_near_duplicates_match_all_pairs(spark):
    rnd = random.Random(11)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 4) for _ in range(80)] for _ in range(12)]
    texts = [None, "", "a b", "a b", "a b c"]
    for b in base:
        for k in range(6):
            w = list(b)
            for _ in range(k):
                w[rnd.randrange(80)] = f"x{rnd.random()}"
            texts.append(" ".join(w))
    texts += [texts[5]] * 7
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    small_blocks = forest.BLOCK
    try:
        for block in (small_blocks, 3):              # also with groups cut into many blocks
            forest.BLOCK = block
            got = by_id(forest.near_duplicates(df))
            assert [got[i].class_id for i in range(len(texts))] == label
            assert [got[i].n_links for i in range(len(texts))] == links
    finally:
        forest.BLOCK = small_blocks
    assert sorted(r.doc_id for r in forest.keep_one(df).collect()) == sorted(set(label))
    twice = forest.keep_one(df.unionAll(df))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(set(label))


def test_fingerprints(spark, docs):
    a, b = "First one. Second one.\nThird.", "Third.\nSecond one. First one."
    f = by_id(fingerprint.fingerprint(spark.createDataFrame(rows_of([a, b, a + " Fourth.", None, ""]), SCHEMA)))
    assert f[0].fingerprint == f[1].fingerprint != f[2].fingerprint and f[3].fingerprint == f[4].fingerprint
    got = by_id(fingerprint.edited(docs))
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        q, nxt = len(t) // 4, texts[(i + 1) % len(texts)]
        e = t[:len(t) - q] + nxt[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[8].near_next == 1.0 and got[8].fingerprint == got[9].fingerprint


def test_likeness_of_very_long_texts(spark):
    texts = ["\n".join(f"{c}{i:06d}" for i in range(100_000)) for c in "ab"]
    got = by_id(fingerprint.edited(spark.createDataFrame(rows_of(texts), SCHEMA)))
    for r in got.values():          # 128 lanes: the error is about an eighth of the paragraphs that differ
        assert r.n_paragraphs == 100_000 and 0.55 < r.near_edited < 0.95 and r.near_next < 0.4


def test_licences_match_sql(spark, docs):
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents", frame)
    want = sorted(con.execute(license.oracle() + " ").fetchall())
    out = license.scan(docs)
    names = [d[0] for d in con.execute(license.oracle()).description]
    assert sorted(tuple(r[n] for n in names) for r in out.collect()) == want and want


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m))


def test_personal_data(spark, docs):
    texts = [*TEXTS, "a@b.c_d@e.f x@y..z @@a@b.c a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.2.3 1.2.3",
             "é😀 4111-1111-1111-1111 4111 1111 1111 1112", "+1 23 +1 (212) 555-8457 4918187128635271 +12345678",
             "x." * 2000 + "@y.z", "1" * 4000, "bob (at) example (dot) org; password = \"a1b2c3d4e5f6a7b8c9\"", "+1 2 3 " * 300]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = by_id(pii.report(df))
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].spans.startswith(want)
    assert "secret:" in got[len(TEXTS) + 6].spans
    out = by_id(pii.redact(df))
    assert out[12].text == "mail [EMAIL] now [PHONE] or [CARD] at [IP]" and out[12].n_chars == len(out[12].text)
    assert out[3].text == "word" and out[0].text == ""


def held_out(df, labels, column, remainder):
    y = {r.doc_id: r[column] for r in labels.collect()}
    pairs = [(r.score, r.predicted, y[r.doc_id]) for r in df.collect() if r.doc_id in y and r.held_out]
    modulus, rest = remainder
    assert pairs and all((zlib.crc32(str(r.doc_id).encode()) % modulus == rest) == r.held_out for r in df.collect())
    return pairs


def test_quality_model(spark):
    from tests.conftest import SF01
    rows = queries.op2_quality_crf(spark, SF01).cache()
    assert rows.count() == 1000 and rows.where("score is null or score < 0 or score > 1").isEmpty()
    pairs = held_out(rows, spark.read.parquet(f"{SF01}/labels.parquet"), "quality", (4, 2))
    assert np.mean([p == y for _, p, y in pairs]) >= 0.95


def test_toxicity_model(spark):
    from tests.conftest import SF01
    rows = queries.op9_toxicity(spark, SF01).cache()
    assert rows.count() == 1000 and rows.where("score is null or score < 0 or score > 1").isEmpty()
    pairs = held_out(rows, spark.read.parquet(f"{SF01}/labels.parquet"), "toxic", (5, 0))
    assert np.mean([p == y for _, p, y in pairs]) >= 0.9


def test_toxic_dictionaries_learn_every_marker_of_both_classes():
    rnd = random.Random(5)
    word = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    plain = [word(6) for _ in range(300)]
    marks, own = [word(7) for _ in range(200)], [word(7) for _ in range(150)]
    texts = {}
    for y, words in ((1, marks), (0, own)):
        texts[y] = [" ".join([*rnd.choices(plain, k=60), *rnd.sample(words, 40)] + (["zqx", "go", "far", "off"] if y else ["far", "go", "off"]))
                    for _ in range(200)]
    model = toxic.build(*toxic.segments(texts[1], texts[0]), 1.0, 3)
    a, b = (set(model[k].lstrip(bytes(range(1, 6))).decode().split()) for k in ("toxic", "ordinary"))
    assert set(marks) <= a and not set(marks) & b           # more than 120
    assert set(own) <= b and not set(own) & a
    assert "zqx" in a and b"far off" in model["toxic"] and b"far off" not in model["ordinary"]
    assert len(model["toxic"]) == len(model["ordinary"])
    once = toxic.segments(texts[1] + ["copied only here " * 3 + texts[1][0]] * 50, texts[0])
    assert b"copied" not in toxic.build(*once, 1.0, 3)["toxic"]     # copies of one text are one document
    assert toxic.build(*toxic.segments([], texts[0]), 1.0, 3) and toxic.build(*toxic.segments([], []), 1.0, 3)


def test_chain_marginals_match_enumeration():
    rnd = np.random.default_rng(2)
    docs = np.array([0, 0, 0, 1, 2, 2])
    score, trans = rnd.normal(size=(6, 2)), rnd.normal(size=(2, 2))
    p, pair, logz = crf.Chains(docs).marginals(score, trans)
    total = 0.0
    for d in range(3):
        at = np.flatnonzero(docs == d)
        z, one = 0.0, np.zeros(len(at))
        for bits in range(1 << len(at)):
            y = [(bits >> k) & 1 for k in range(len(at))]
            v = np.exp(sum(score[a, b] for a, b in zip(at, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            z, one = z + v, one + v * np.array(y)
        assert np.allclose(p[at], one / z)
        total += np.log(z)
    assert np.isclose(total, logz) and np.isclose(pair.sum(), 3)


def test_pipeline(spark):
    import corpus_pipeline
    from tallyframe.llm.store import stage, table
    from tests.conftest import SF001

    docs = table(spark, SF001, "documents")
    before = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, docs, SF001), "test")
        assert out.columns == docs.columns and 0 < out.count() <= before
        docs, before = out, out.count()
    assert forest.near_duplicates(docs).where("n_links > 0").count() <= forest.near_duplicates(table(spark, SF001, "documents")).where("n_links > 0").count()
    pieces = corpus_pipeline.run(spark, SF001)
    assert pieces.select("doc_id").distinct().count() == docs.count()

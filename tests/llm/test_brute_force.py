"""The quality model and every stage of the pipeline against plain computations on whole texts."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import crf, queries, rules
from tallyframe.llm.store import stage, table
from tests.conftest import SF001
from tests.llm.test_operators import WORD, base_spans

SYMBOLS, ENDS = set("#*$%&|<>@~^_=\\{}[]"), set(".!?:;\"')")
AWKWARD = [None, "", "\n", "\n\n a", "x" * 30_000, "One two. two two\nOne two. two two\n\nÉtat 12! #tag a_", "é\n😀 é é é;\nLOUD!? WORDS"]


def line_features(text):
    """(features, code points) of each line."""
    out, earlier = [], set()
    for line in text.split("\n"):
        words, size = WORD.findall(line), len(line.encode())
        def count(pattern, line=line):
            return len(re.findall(pattern, line, re.A))
        up, low, w1, s1 = count("[A-Z]"), count("[a-z]"), max(len(words), 1), max(size, 1)
        out.append(([math.log1p(len(words)) / 5, min(len(line) / w1, 30) / 10, sum(c in SYMBOLS for c in line) / s1 * 5, up / max(up + low, 1),
                     count("[0-9]") / s1, count("[!?]") / w1, float(line[-1:] in ENDS if line else 0),
                     sum(a == b for a, b in zip(words, words[1:], strict=False)) / w1, (len(words) - len(set(words))) / w1,
                     float(line in earlier), float(bool(line) and (line[0].isascii() and line[0].isupper() or ord(line[0]) >= 0xC0)),
                     sum(w[-1] in SYMBOLS for w in words) / w1], len(line)))
        earlier.add(line)
    return out


def plain_score(text, model):
    """Forward and backward sums of one text, line by line."""
    lines = line_features(text or "")
    f = [x for x, _ in lines]
    none = [0.0] * crf.N_OWN
    w, trans = model["w"].astype(float), model["trans"]
    own = [float(np.dot(w, [*f[i], *(f[i - 1] if i else none), *(f[i + 1] if i + 1 < len(f) else none),
                            float(i == 0), float(i + 1 == len(f)), 1.0])) for i in range(len(f))]
    alpha, beta = [np.array([0.0, own[0]])], [np.zeros(2)]
    for s in own[1:]:
        alpha.append(np.array([0.0, s]) + [np.logaddexp.reduce(alpha[-1] + trans[:, k]) for k in (0, 1)])
    for s in own[:0:-1]:
        beta.append(np.array([np.logaddexp.reduce(trans[k] + [0.0, s] + beta[-1]) for k in (0, 1)]))
    p = [1 / (1 + math.exp(min(500, x[0] - x[1]))) for x in (a + b for a, b in zip(alpha, reversed(beta), strict=True))]
    size = [max(n, 1) for _, n in lines]
    q = min(max(np.dot(p, size) / sum(size), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(model["a"] * math.log(q / (1 - q)) + model["b"])))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with awkward rows, a line that 14 documents of one host share, copies and near copies."""
    root, rnd = tmp_path_factory.mktemp("corpus"), random.Random(2)
    docs = table(spark, SF001, "documents")
    good = [r.text for r in docs.join(table(spark, SF001, "labels").where("quality = 1").select("doc_id"), "doc_id").orderBy("doc_id").limit(20).collect()]
    texts = list(AWKWARD) + [f"{t}\nShared LINE {i % 10} of this host" for i, t in enumerate(good[:14])]
    for t in good[14:18]:
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "changed"
        texts += [t, " ".join(words), f"{t} mail me@example.org or +1 (212) 555-8457"]
    rows = [(10**6 + i, t, "en", "host", len(t or "")) for i, t in enumerate(texts)]
    more = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, lang string, source string, n_chars long")
    by_name = [F.col(c).cast(docs.schema[c].dataType) for c in docs.columns if c in more.columns]
    assert len(by_name) == len(docs.columns)
    docs.unionByName(more.select(*by_name)).write.parquet(f"{root}/documents.parquet")
    table(spark, SF001, "labels").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The rows before and after each stage, and the quality model."""
    docs, out = table(spark, folder, "documents"), []
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, folder), "brute")
        out.append((docs.collect(), after.collect()))
        docs = after
    model = crf.fit(table(spark, folder, "documents"), table(spark, folder, "labels"), queries.quality_rows)
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True)), model


def test_quality_scores_equal_the_plain_chain(spark, folder, steps):
    _, model = steps
    docs = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    for r in crf.score(table(spark, folder, "documents"), model).collect():
        assert r.score == pytest.approx(plain_score(docs[r.doc_id], model), abs=2e-3), repr(docs[r.doc_id])[:80]


def test_quality_stage_keeps_what_the_plain_chain_keeps(steps):
    (before, after), model = steps[0]["quality classifier"], steps[1]
    scores = [(r, plain_score(r.text, model)) for r in before]
    sure = {True: [], False: []}
    for r, s in scores:
        if abs(s - crf.CUT) > 2e-3:
            sure[s >= crf.CUT].append(r)
    left = collections.Counter(after)
    assert all(r in left for r in sure[True]) and not any(r in left for r in sure[False]) and sure[True] and sure[False]
    assert len(after) <= len(before)


def test_rules_stage_equals_counting_lines(steps):
    before, after = steps[0]["quality rules"]

    def normal(line):
        return re.sub("[0-9]", "0", " ".join(WORD.findall(line))).translate({c: c + 32 for c in range(65, 91)})
    carriers = collections.defaultdict(list)
    for r in before:
        for line in {normal(x) for x in (r.text or "").split("\n")} - {""}:
            carriers[r.source, line].append(r.doc_id)
    want = set()
    for r in before:
        words, lines = WORD.findall(r.text or ""), (r.text or "").split("\n")
        seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        cover = {k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
        held = {x: carriers[r.source, normal(x)] for x in lines if normal(x)}
        left = [x for x in lines if x not in held or len(held[x]) <= rules.MIN_DOCS or min(held[x]) == r.doc_id]
        n = sum(len(WORD.findall(x)) for x in left)
        if len(words) >= 50 and 2 * len(cover) <= len(words) and 3 * n >= len(words):
            want.add((r.doc_id, "\n".join(left)))
    assert {(r.doc_id, r.text) for r in after} == want
    assert sum("Shared LINE" in (r.text or "") for r in before) >= 11 and sum("Shared LINE" in r.text for r in after) == 1


def test_join_stage_keeps_the_first_of_each_class(steps):
    before, after = steps[0]["n-gram Jaccard join"]
    rows = sorted({(r.doc_id, r.text) for r in before})
    sets = []
    for _, t in rows:
        w = WORD.findall(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert sorted((r.doc_id, r.text) for r in after) == [rows[i] for i in sorted(set(label))]
    assert len(after) < len(before)


def test_personal_data_stage_leaves_no_base_span(steps):
    before, after = steps[0]["PII"]
    texts = {r.doc_id: r.text for r in after}
    assert sorted(texts) == sorted(r.doc_id for r in before)
    changed = 0
    for r in before:
        t = texts[r.doc_id]
        spans = base_spans(r.text)
        assert not base_spans(t) and (spans == "" or t != r.text)
        # outside the marks the text is as it was
        pattern = ".*?".join(re.escape(x) for x in re.split(r"\[[A-Z_]+\]", t)) if t != r.text else re.escape(t)
        assert re.fullmatch(pattern, r.text, re.S)
        changed += t != r.text
    assert changed


def test_packing_stage_holds_every_id_once(steps):
    from tokenizers import Tokenizer

    before, after = steps[0]["packing"]
    tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    ids = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 2] for r in before}
    at, places = collections.Counter(), collections.defaultdict(list)
    for p in sorted(after, key=lambda p: (p.doc_id, p.start)):
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert p.start == at[p.doc_id] and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == p.length
        at[p.doc_id] += p.length
        places[p.sequence_id].append((p.offset, p.length))
    assert at == collections.Counter({d: len(x) for d, x in ids.items()})
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096

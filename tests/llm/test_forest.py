"""The forest against plain tries: levels, paths, descent through prefixes, links of wide nodes, measured recall."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import forest, rules
from tallyframe.llm.textbuf import SHARED_SLICE, TextBuffer
from tests.llm.test_operators import SCHEMA, by_id, rows_of


def test_levels_stop_at_the_first_that_reaches_the_recall():
    assert forest.levels() == [8, 7, 6, 5, 4]
    meets = lambda k: 1 - (1 - forest.THRESHOLD ** k) ** forest.TREES
    assert meets(4) >= forest.RECALL > meets(5)
    assert forest.levels(recall=0.9) == [8] and forest.levels(0.1, 2, 0.999, 3) == [3, 2, 1]


def test_paths_hold_the_symbols_in_order():
    sig = np.random.default_rng(1).integers(0, 2**32, (50, 40), dtype=np.uint32)
    sig[7], sig[8, :4], sig[9, :6] = sig[3], sig[3, :4], sig[3, :6]      # whole, first 4 and first 6 symbols of tree 0
    x = forest.paths(sig, 5, 8, 4)
    assert (x[7] == x[3]).all() and x[8, 0, 0] == x[3, 0, 0] and (x[8, 1:, 0] != x[3, 1:, 0]).all()
    assert x[9, 0, 1] >> np.uint64(16) == x[3, 0, 1] >> np.uint64(16) and x[9, 0, 1] != x[3, 0, 1]
    assert [int(x[5, 2, 1]) >> 8 * (3 - k) & 255 for k in range(4)] == [int(v) & 255 for v in sig[5, 20:24]]
    assert len(np.unique(x[:, :, 0])) == 50 * 5 - 5 - 2                  # equal prefixes of different trees are apart


@pytest.mark.parametrize("lengths", [[8, 7, 6, 5, 4], [6, 5], [3]])
def test_descent_joins_what_a_plain_trie_joins(lengths):
    rnd = random.Random(len(lengths))
    spread = lengths[0] - lengths[-1]
    rows = sorted((rnd.randrange(12), sum(rnd.randrange(3) << 8 * k for k in range(spread)), rnd.randrange(8)) for _ in range(400))
    base = np.random.default_rng(2).integers(0, 256, (8, forest.SKETCH), dtype=np.uint8)
    noise = np.random.default_rng(3).random((400, forest.SKETCH))
    sk = np.where(noise < 0.3, np.uint8(0), base[[r[2] for r in rows]])
    least = 52
    label = list(range(400))
    for length in lengths:                           # the nodes of one level after the other, all pairs below each
        nodes = collections.defaultdict(list)
        for i, (top, tail, _) in enumerate(rows):
            nodes[top, tail >> 8 * (lengths[0] - length)].append(i)
        for members in nodes.values():
            for i, j in itertools.combinations(members, 2):
                if label[i] != label[j] and (sk[i] == sk[j]).sum() >= least:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
    top, tail = (np.array([r[k] for r in rows]) for k in (0, 1))
    got = forest.descend(top, tail, sk, lengths, least, np.arange(400))
    assert got.tolist() == label and 20 < len(set(label)) < 300


def near(rnd, words, share):
    return [f"x{rnd.random()}" if rnd.random() < share else w for w in words]


def test_measured_recall_of_the_levels():
    """Pairs at 0.8 to 0.85 that meet in some tree: as often as the levels promise, and all of them at the last."""
    rnd = random.Random(5)
    texts = []
    for k in range(1500):
        w = [f"w{k}x{i}" for i in range(150)]
        texts += [" ".join(w), " ".join(near(rnd, w, 0.021))]
    tb = TextBuffer(pa.array(texts))
    h, docs = forest.shingles(tb)
    sets = np.split(h, np.flatnonzero(docs[1:] != docs[:-1]) + 1)
    likeness = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True)])
    close = np.flatnonzero((likeness >= 0.8) & (likeness < 0.85))
    sig = forest.signatures(h, docs, tb.n, forest.TREES * forest.DEPTH).reshape(-1, forest.TREES, forest.DEPTH)
    same = np.cumprod(sig[::2] == sig[1::2], axis=2)[close].any(1)       # pair, prefix length
    assert len(close) > 200
    for length in forest.levels():
        promised = 1 - (1 - 0.8 ** length) ** forest.TREES
        assert same[:, length - 1].mean() >= promised - 0.01
    assert same[:, forest.levels()[-1] - 1].all()


def test_links_of_wide_nodes(spark, monkeypatch):
    """Many texts below one node, in blocks of 4: every link is found, in one class or in several."""
    rnd = random.Random(9)
    texts = []
    for family, share in ((0, 0.002), (1, 0.01), (2, 0.02)):
        w = [f"f{family}x{i}" for i in range(200)]
        texts += [" ".join(near(rnd, w, share)) for _ in range(40)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links, label = [0] * len(texts), list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i], links[j] = links[i] + 1, links[j] + 1
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    monkeypatch.setattr(forest, "BLOCK", 4)
    got = by_id(forest.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5)))
    assert [got[i].class_id for i in range(len(texts))] == label
    assert [got[i].n_links - got[i].n_copies + 1 for i in range(len(texts))] == links


def test_groups_that_one_wide_node_keeps_apart_are_joined(spark, monkeypatch):
    """A link between two blocks of one node, in no other tree: the pairing of blocks finds it."""
    monkeypatch.setattr(forest, "BLOCK", 2)
    n, lengths = 24, [5, 4]
    sk = np.arange(n)[:, None] * np.ones(forest.SKETCH, int) % 256       # all unlike but the last, which is as the first
    sk[n - 1] = sk[0]
    rows = [(i, np.array([[77, i % 3]], np.uint64).tobytes(), sk[i].astype(np.uint8).tobytes()) for i in range(n)]
    for last in range(1, n):                         # whichever blocks they are dealt into
        moved = [(i, p, rows[n - 1][2] if i == last else (rows[last][2] if i == n - 1 else s)) for i, p, s in rows]
        if last in (1, 7, 12, n - 1):
            reps = spark.createDataFrame(moved, "node long, paths binary, sketch binary")
            got = {(r.node, r.root) for r in forest.candidate_groups(reps, lengths, 60).collect()}
            assert got == {(0, 0), (last, 0)}


def test_overlaps_by_ranges_of_hashes(monkeypatch):
    rnd = np.random.default_rng(5)
    pool = rnd.integers(0, 2**64, 3000, dtype=np.uint64)
    sets = [np.unique(rnd.choice(pool, rnd.integers(0, 900))) for _ in range(90)]
    i, j = np.triu_indices(90, 1)
    monkeypatch.setattr(forest, "PART_WINDOWS", 2500)
    seen, add = [], forest._add_overlaps
    monkeypatch.setattr(forest, "_add_overlaps", lambda part, out: (seen.append(sum(map(len, part))), add(part, out)))
    assert forest.overlaps(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert len(seen) > 5 and sum(seen) == sum(map(len, sets)) and max(seen) < 3500


def test_groups_of_long_texts_are_verified_in_smaller_blocks(spark, monkeypatch):
    """Links and classes stay, while no task gets more than two blocks of the group's windows."""
    rnd = random.Random(8)
    words = [f"w{rnd.random()}" for _ in range(400)]
    texts = [" ".join(near(rnd, words, 0.005)) for _ in range(40)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    want = by_id(forest.near_duplicates(docs))
    monkeypatch.setattr(forest, "BLOCK_WINDOWS", 2000)
    monkeypatch.setattr(forest, "TASK_WINDOWS", 4000)
    sizes = spark.createDataFrame([(40, 40 * 396), (2, 10**6)], "texts long, windows long").select(forest.verified_size("texts", "windows"))
    assert [r[0] for r in sizes.collect()] == [8 * forest.BLOCK, 2 * forest.BLOCK]
    assert by_id(forest.near_duplicates(docs)) == want
    assert max(r.n_links for r in want.values()) > 5


def test_workers_hash_and_cut_small_slices(monkeypatch):
    texts = [f"first {k}\nword " + "some words " * 2000 for k in range(150)]           # 3.3 MB in one batch
    made = []
    monkeypatch.setattr(forest, "TextBuffer", lambda arr: made.append(sum(map(len, arr.to_pylist()))) or TextBuffer(arr))
    monkeypatch.setattr(forest, "TaskContext", type("", (), {"get": staticmethod(lambda: type("", (), {"partitionId": lambda _: 0})())}))
    ids = pa.array(range(150))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], names=["doc_id", "text", "text_hash"])
    out = list(forest._signature_batches(24, 8, 4)([batch]))
    assert sum(made) == sum(map(len, texts)) and max(made) <= SHARED_SLICE
    assert [x for b in out for x in b.column("row_id").to_pylist()] == list(range(150))

    gone = [[0] if k % 2 else None for k in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(gone, pa.list_(pa.int32()))], names=["text", "removed_lines"])
    out = list(rules._without_lines([batch]))
    assert max(sum(map(len, b.column("text").to_pylist())) for b in out) <= SHARED_SLICE
    want = [t.split("\n", 1)[1] if g else t for t, g in zip(texts, gone, strict=True)]
    assert [x for b in out for x in b.column("text").to_pylist()] == want

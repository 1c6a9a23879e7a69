"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled good (1) or bad (0) from its own features and those of its neighbours; the
forward-backward marginals, weighted by line length, make the share of good text, which a logistic
curve fitted on the same sample turns into the score. Lines take their document's label in training.

Training uses at most ``FIT_DOCS`` labelled documents of ``FIT_BYTES`` together, half of each label, taken
whole in the order of a hash of doc_id; scoring covers every line of every text.
A null or empty text is one empty line. With no usable labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyframe.llm.rules import line_words
from tallyframe.llm.store import documents, exact, packed, unpacked
from tallyframe.llm.textbuf import U64, TextBuffer, class_of, mix, repeats, slices, span_sums, with_doc

FIT_DOCS = 3000
FIT_BYTES = 4 << 20
FIT_SLICE = 1 << 18        # bytes whose features the driver makes at once
KEEP_SLICE = 1 << 19           # bytes of text that are scored at once where later stages share the workers
ROUNDS = 250
CUT = 0.7

UPPER = class_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = class_of("abcdefghijklmnopqrstuvwxyz")
DIGIT = class_of("0123456789")
SYMBOL = class_of("#*$%&|<>@~^_=\\{}[]")
LOUD = class_of("!?")
STOP = class_of(".!?:;\"')")
N_OWN = 12


def line_features(tb: TextBuffer):
    """(features, length in characters, document index) of each line; an empty text has one empty line."""
    ls, le, ld = tb.lines()
    lo, hi = line_words(tb, ls, le)
    ws, we, wd = tb.words()
    data = tb.data
    size = le - ls
    points = span_sums((data & 0xC0) != 0x80, ls, le)
    nw = hi - lo
    w1, s1 = np.maximum(nw, 1), np.maximum(size, 1)
    counts = {k: span_sums(t[data], ls, le) for k, t in
              {"up": UPPER, "low": LOWER, "dig": DIGIT, "sym": SYMBOL, "loud": LOUD}.items()}
    wh = tb.word_hash()
    same = np.zeros(len(wh), bool)
    same[1:] = wh[1:] == wh[:-1]
    line_of = np.repeat(np.arange(len(ls)), nw)
    first = lo[nw > 0]
    same[first] = False
    _, again = repeats(mix(wh + (line_of.astype(U64) + U64(1)) * U64(0xE7037ED1A0B428DB)))
    _, dup = repeats(with_doc(tb.spans_hash(ls, le), ld))
    tail = np.where(size > 0, data[np.maximum(le - 1, 0)] if len(data) else 0, 32)
    head = np.where(size > 0, data[np.minimum(ls, len(data) - 1)] if len(data) else 0, 32)
    marked = SYMBOL[data[we - 1]] if len(we) else np.zeros(0, bool)
    f = np.zeros((len(ls), N_OWN), np.float32)
    f[:, 0] = np.log1p(nw) / 5
    f[:, 1] = np.minimum(points / w1, 30) / 10
    f[:, 2] = counts["sym"] / s1 * 5
    f[:, 3] = counts["up"] / np.maximum(counts["up"] + counts["low"], 1)
    f[:, 4] = counts["dig"] / s1
    f[:, 5] = counts["loud"] / w1
    f[:, 6] = STOP[tail]
    f[:, 7] = span_sums(same, lo, hi) / w1
    f[:, 8] = span_sums(again, lo, hi) / w1
    f[:, 9] = dup
    f[:, 10] = UPPER[head] | (head >= 0xC3)
    f[:, 11] = span_sums(marked, lo, hi) / w1
    empty = np.flatnonzero(np.diff(tb.bounds) == 0)
    if len(empty):
        order = np.argsort(np.concatenate([ld, empty]), kind="stable")
        f = np.concatenate([f, np.zeros((len(empty), N_OWN), np.float32)])[order]
        points = np.concatenate([points, np.zeros(len(empty), np.int64)])[order]
        ld = np.concatenate([ld, empty])[order]
    return f, points, ld


def with_neighbours(f: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Own features, those of the previous and of the next line of the document, edge flags, bias."""
    n = len(f)
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = docs[1:] != docs[:-1]
    last[:-1] = first[1:]
    prev, nxt = np.zeros_like(f), np.zeros_like(f)
    prev[1:], nxt[:-1] = f[:-1], f[1:]
    prev[first], nxt[last] = 0, 0
    one = np.ones((n, 1), np.float32)
    return np.concatenate([f, prev, nxt, first[:, None], last[:, None], one], axis=1, dtype=np.float32)


class Chains:
    """Sequences laid out by position, longest first, for vectorised recursions over all of them."""

    def __init__(self, docs: np.ndarray):
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, int)
        size = np.diff(np.r_[starts, len(docs)])
        order = np.argsort(-size, kind="stable")
        self.starts, self.size = starts[order], size[order]
        self.steps = int(self.size[0]) if len(size) else 0
        self.alive = np.searchsorted(-self.size, -np.arange(self.steps), "left")

    def marginals(self, score: np.ndarray, trans: np.ndarray):
        """score: (lines, 2) log potentials; returns P(label) of lines, expected transitions, log Z sum."""
        a, b = score.astype(np.float64), np.zeros(score.shape)
        alpha = np.zeros_like(a)
        for t in range(self.steps):
            at = self.starts[:self.alive[t]] + t
            if t == 0:
                alpha[at] = a[at]
            else:
                p = alpha[at - 1][:, :, None] + trans
                alpha[at] = a[at] + np.logaddexp(p[:, 0], p[:, 1])
        pair = np.zeros((2, 2))
        ends = self.starts + self.size - 1
        logz = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
        for t in range(self.steps - 2, -1, -1):
            m = self.alive[t + 1]
            at = self.starts[:m] + t
            nxt = (a[at + 1] + b[at + 1])[:, None, :] + trans
            pair += np.exp(alpha[at][:, :, None] + nxt - logz[:m, None, None]).sum(0)
            b[at] = np.logaddexp(nxt[:, :, 0], nxt[:, :, 1])
        lp = alpha + b
        return 1 / (1 + np.exp(np.clip(lp[:, 0] - lp[:, 1], -500, 500))), pair, logz.sum()


def train(f: np.ndarray, docs: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Maximum conditional likelihood (Adam, small L2). ``labels``: one per line."""
    x = with_neighbours(f, docs)
    chains, n = Chains(docs), max(len(x), 1)
    y = labels.astype(np.float64)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    inner = np.flatnonzero(docs[1:] == docs[:-1])
    np.add.at(seen, (labels[inner], labels[inner + 1]), 1)
    weight = x.T.astype(np.float64)
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for k in range(1, rounds + 1):
        s = np.zeros((len(x), 2))
        s[:, 1] = x @ w
        p, pair, _ = chains.marginals(s, trans)
        g = np.r_[weight @ (y - p) / n - 1e-4 * w, ((seen - pair) / n - 1e-4 * trans).ravel()]
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        step = 0.1 * (state[0] / (1 - 0.9 ** k)) / (np.sqrt(state[1] / (1 - 0.999 ** k)) + 1e-8)
        w, trans = w + step[:-4], trans + step[-4:].reshape(2, 2)
    return {"w": w.astype(np.float32), "trans": trans, "a": 1.0, "b": 0.0}


def good_share(tb: TextBuffer, model: dict) -> np.ndarray:
    """Length-weighted mean of the marginals of each document's lines."""
    f, size, docs = line_features(tb)
    s = np.zeros((len(f), 2))
    s[:, 1] = with_neighbours(f, docs) @ model["w"]
    p, _, _ = Chains(docs).marginals(s, model["trans"])
    weight = np.maximum(size, 1)
    return np.bincount(docs, p * weight, minlength=tb.n) / np.bincount(docs, weight, minlength=tb.n)


def curve(share: np.ndarray, model: dict) -> np.ndarray:
    q = np.clip(share, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-np.clip(model["a"] * np.log(q / (1 - q)) + model["b"], -60, 60)))


def calibrate(share: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the share's logit to the label."""
    q = np.clip(share, 1e-6, 1 - 1e-6)
    z = np.log(q / (1 - q))
    a, b = 0.5, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        r, v = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * z).sum() - 0.1 * (a - 0.5), r.sum() - 0.1 * b])
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
    return float(max(a, 0.05)), float(b)


def fold(col: str):
    """crc32 of the id's decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, size: int, max_bytes: int) -> list[Row]:
    """Labelled rows (doc_id, text, y), whole texts, at most ``size`` of them and ``max_bytes`` together.

    Up to half of each label, in the order of a hash of doc_id; equal rows count once. Places and lengths
    are chosen first, so the driver never holds more than the bounds; the ids that are broadcast are
    bounded by ``size`` too, and no text is shuffled.
    """
    y = (exact(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
         .where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & usable("id")))
    ids = None
    for v in (0, 1):
        part = y.where(F.col("y") == v).distinct().orderBy(F.xxhash64("id"), "id").limit(size // 2)
        ids = part if ids is None else ids.unionAll(part)
    ids = ids.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents(docs).select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("h"))
    places = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select(
        "id", "h", "y", F.octet_length("text").alias("bytes"))
    first = places.distinct().orderBy(F.xxhash64("id"), "id", "h").limit(size).collect()
    chosen, total = [], 0
    for r in first:                         # a text that does not fit any more is left out, none is cut
        if total + r["bytes"] <= max_bytes:
            chosen.append((r["id"], r["h"], r["y"]))
            total += r["bytes"]
    if not chosen:
        return []
    chosen = docs.sparkSession.createDataFrame(chosen, "id long, g long, y int")
    picked = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("g")))
    out = picked.dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "y").limit(size).collect()
    return sorted(out, key=lambda r: (r["doc_id"], r["text"]))


def fit(docs: DataFrame, labels: DataFrame, usable, fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> dict | None:
    """Train on the bounded labelled sample. ``usable(column name)`` selects the rows to learn from."""
    rows = labelled_sample(docs, labels, "quality", usable, fit_docs, fit_bytes)
    if not rows:
        return None
    y = np.array([r["y"] for r in rows])
    texts, parts = pa.array([r["text"] for r in rows], pa.large_string()), []
    for i, j in slices(texts, FIT_SLICE):
        f, size, docs_of = line_features(TextBuffer(texts.slice(i, j - i)))
        parts.append((f, size, docs_of + i))
    f, line_size, docs_of = (np.concatenate(x) for x in zip(*parts, strict=True))
    model = train(f, docs_of, y[docs_of])
    s = np.zeros((len(f), 2))
    s[:, 1] = with_neighbours(f, docs_of) @ model["w"]
    p, _, _ = Chains(docs_of).marginals(s, model["trans"])
    size = np.maximum(line_size, 1)
    share = np.bincount(docs_of, p * size, len(rows)) / np.maximum(np.bincount(docs_of, size, len(rows)), 1)
    # both labels weigh the same: the sample's shares of them are not the corpus's
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    model["a"], model["b"] = calibrate(share, y, weight)
    return model


def _score_batches(model):
    def run(batches):
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                tb = TextBuffer(part.column("text"))
                if model is None:
                    share = score = np.full(tb.n, 0.5)
                else:
                    share = good_share(tb, model)
                    score = curve(share, model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(share)],
                                                 names=["doc_id", "score", "good_share"])
    return run


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score and share of good text of every document."""
    rows = documents(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_score_batches(model), "doc_id long, score double, good_share double")


def _keep_batches(model, cut):
    def run(batches):
        for b in batches:
            for i, j in slices(b.column("text"), KEEP_SLICE):
                part = b.slice(i, j - i)
                share = good_share(TextBuffer(part.column("text")), model)
                yield part.filter(pa.array(curve(share, model) >= cut))
        pa.default_memory_pool().release_unused()      # workers stay for the stages behind this one
    return run


def keep_good(docs: DataFrame, model: dict | None, cut: float = CUT) -> DataFrame:
    """The documents scored at ``cut`` or above, in the columns of the input; all of them without a model."""
    if model is None:
        return docs
    rows = packed(docs, "text").withColumn("text", F.col("text").cast("string"))
    return unpacked(rows.mapInArrow(_keep_batches(model, cut), rows.schema), docs, "text")

"""Toxicity by compression distance with two zstandard dictionaries.

Each class's dictionary is learnt from its labelled texts: the words, word stems and phrases of two or
three words that its documents hold more often than the other's, surest first, up to ``CLASS_BYTES``. They
need a G squared above a share of 2 ln of the number of segments tried and odds between the classes; of
``LEVELS``, those whose curve fits the labelled documents kept back best. Near copies of a text count once. Behind them both
hold the same common words of either class, up to ``SHARED_BYTES``, so that ordinary language costs the
same with both. The contents are raw; zstandard's own trainer is not used, as it keeps what is frequent
and not what tells the classes apart (figures in the README). A text is cut into windows of about
``WINDOW`` bytes at word ends, each is compressed with both, and the bytes the toxic dictionary saves are
summed up per document (largest, sum of the largest three, mean, sum and numbers of windows over
thresholds). A logistic curve over these, fitted on documents that were not used for the dictionaries,
gives the score.

Learning uses at most ``FIT_DOCS`` labelled documents of ``FIT_BYTES`` together, half of each label, whole and
in the order of a hash of doc_id; scoring reads every window of every text.
Null and empty texts have no windows and get the curve's value at zero. Without toxic and ordinary
labels every score is 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.crf import labelled_sample
from tallyframe.llm.store import documents, exact
from tallyframe.llm.textbuf import TextBuffer, grams, mix, slices, with_doc

WINDOW = 64
FIT_DOCS = 4000
FIT_BYTES = 10 << 20
CLASS_BYTES = 16 << 10     # a class's own segments
SHARED_BYTES = 40 << 10    # common words in both dictionaries
LEAST = 3                  # documents that hold a segment
# evidence that a segment needs, as a share of the largest by chance, and its odds between the classes
LEVELS = ((1.0, 3), (1.0, 8), (0.7, 8), (0.45, 8))
FLOOR = (0.45, 3)
STEMS = (4, 6, 8, 10)
PHRASES = (2, 3)
HASHES = 6
PHRASE_BYTES = 16 << 20    # text whose phrases are counted at once
CUT = 0.5

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_plain = _lower.copy()
_plain[[ord(c) for c in ".,!?;:"]] = 32
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True


def windows(tb: TextBuffer):
    """(lower-case bytes, window bounds, document of each window)."""
    data = _lower[tb.data]
    gaps = np.flatnonzero(_space[data])
    sizes = np.diff(tb.bounds)
    count = np.maximum(-(-sizes // WINDOW) - 1, 0)
    target = np.repeat(tb.bounds[:-1], count) + WINDOW * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
    at = np.searchsorted(gaps, target)
    gap = np.append(gaps, len(data) + 2 * WINDOW)[at]
    cut = np.where(gap < target + WINDOW, gap, target)       # a long word is cut where it stands
    cut = np.minimum(cut, np.repeat(tb.bounds[1:], count))
    cuts = np.unique(np.concatenate([tb.bounds, cut]))
    docs = tb.doc_of(cuts[:-1])
    return data, cuts, docs


def compressors(model: dict):
    import zstandard as zs

    p = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_LAZY2, min_match=3, window_log=17, hash_log=16, chain_log=16,
                                     search_log=8, target_length=64, write_content_size=False, write_checksum=False,
                                     write_dict_id=False)
    out = []
    for content in (model["toxic"], model["ordinary"]):
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        out.append(zs.ZstdCompressor(compression_params=p, dict_data=d))
    return out


def savings(data: np.ndarray, cuts: np.ndarray, coders) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    import zstandard as zs

    if len(cuts) < 2:
        return np.zeros(0)
    segments = np.stack([cuts[:-1], np.diff(cuts)], axis=1).astype(np.uint64).tobytes()
    buffer = zs.BufferWithSegments(data.tobytes(), segments)
    toxic, ordinary = (np.fromiter(map(len, c.multi_compress_to_buffer(buffer)), np.int64, len(cuts) - 1) for c in coders)
    return (ordinary - toxic).astype(float)


def features(tb: TextBuffer, coders) -> np.ndarray:
    data, cuts, docs = windows(tb)
    d = savings(data, cuts, coders)
    out = np.zeros((tb.n, 7))
    if not len(d):
        return out
    order = np.lexsort((-d, docs))
    d, docs = d[order], docs[order]
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    have = docs[starts]
    rank = np.arange(len(d)) - np.repeat(starts, np.diff(np.r_[starts, len(d)]))
    n = np.bincount(docs, minlength=tb.n)[have]
    add = lambda x: np.add.reduceat(x, starts)
    out[have] = np.stack([d[starts], add(d * (rank < 3)), add(d) / n, add(np.maximum(d, 0)) / 5,
                          add((d >= 2) * 1.0), add((d >= 3) * 1.0), add((d >= 3) * 1.0) / n], axis=1)
    return out


def words_of(text: str) -> list[str]:
    return text.encode().translate(_plain.tobytes()).decode().split()


def evidence(a, b, n_a: int, n_b: int):
    """G squared of a segment in ``a`` of ``n_a`` texts of one class and ``b`` of ``n_b`` of the other; negative if the other leads."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    e = (a + b) / (n_a + n_b)
    term = lambda k, n: k * np.log(np.maximum(k, 1e-9) / np.maximum(e * n, 1e-9))
    rest = lambda k, n: (n - k) * np.log(np.maximum(n - k, 1e-9) / np.maximum((1 - e) * n, 1e-9))
    return 2 * (term(a, n_a) + term(b, n_b) + rest(a, n_a) + rest(b, n_b)) * np.sign(a * n_b - b * n_a)


def word_counts(toxic: list[str], ordinary: list[str]):
    """(words and stems, documents of each class that hold them)."""
    counts = []
    for texts in (toxic, ordinary):
        c = Counter()
        for t in texts:
            words = set(words_of(t))
            c.update(words | {w[:k] for w in words for k in STEMS if len(w) > k})
        counts.append(c)
    names = sorted(counts[0].keys() | counts[1].keys())
    return names, *(np.array([c[w] for w in names]) for c in counts)


def phrase_counts(tb: TextBuffer, toxic: np.ndarray, n: int):
    """(an occurrence's first and end byte, documents of each class) of the phrases of n words in ``LEAST`` documents or more."""
    starts, ends, docs = tb.words()
    at, g = grams(tb.word_hash(), docs, n)
    parts = 1 + len(tb.data) // PHRASE_BYTES
    out = []
    for p in range(parts):                       # equal phrases fall in the same part
        here = np.flatnonzero(g % np.uint64(parts) == p)
        here = here[np.unique(with_doc(g[here], docs[at[here]]), return_index=True)[1]]
        _, first, inv = np.unique(g[here], return_index=True, return_inverse=True)
        y = toxic[docs[at[here]]]
        a, b = np.bincount(inv, y, len(first)), np.bincount(inv, ~y, len(first))
        many = a + b >= LEAST
        word = at[here[first[many]]]
        out.append((starts[word], ends[word + n - 1], a[many], b[many]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def fill(segments: list[str], limit: int) -> bytes:
    """The segments in their order, as far as ``limit`` bytes go, the first one last; none that is in one before it."""
    out, size, held = [], 0, " "
    for s in segments:
        if f" {s}" in held or any(f" {w} " in held for w in s.split()[:-1] + s.split()[1:]):
            continue
        size += len(s.encode()) + 1
        if size > limit:
            break
        out.append(s)
        held += s + " "
    return (" ".join(reversed(out)) + " ").encode()


def originals(texts: list[str]) -> list[str]:
    """The texts without near copies of an earlier one: those that share a MinHash of their 4-word windows."""
    tb = TextBuffer(pa.array([" ".join(words_of(t)) for t in texts], pa.string()))
    at, g = grams(tb.word_hash(), tb.words()[2], 4)
    docs = tb.words()[2][at]
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else docs
    copy = np.zeros(tb.n, bool)
    for k in range(HASHES):
        least = np.minimum.reduceat(mix(g + np.uint64(k)), starts) if len(starts) else g
        _, first = np.unique(least, return_index=True)
        later = np.ones(len(starts), bool)
        later[first] = False
        copy[docs[starts[later]]] = True
    return [t for t, c in zip(texts, copy, strict=True) if not c]


def segments(toxic: list[str], ordinary: list[str]):
    """(evidence for toxic, its share of what chance gives, odds, segment) of all that lean to a class, and the common words by rank."""
    toxic, ordinary = originals(toxic), originals(ordinary)
    n = max(len(toxic), 1), max(len(ordinary), 1)
    names, a, b = word_counts(toxic, ordinary)
    often = np.flatnonzero(a + b >= LEAST)
    names, a, b = [names[i] for i in often], a[often], b[often]
    found = []

    def add(a, b, text_of):
        g = evidence(a, b, *n)
        level = np.abs(g) / (2 * np.log(max(len(g), 2)))     # of as many tries, the largest by chance is about 1
        odds = a / n[0] / ((b + 0.3) / n[1]), b / n[1] / ((a + 0.3) / n[0])
        odds = np.where(g > 0, *odds)
        found.extend((g[i], level[i], odds[i], text_of(i)) for i in np.flatnonzero((level > FLOOR[0]) & (odds > FLOOR[1])))
    add(a, b, names.__getitem__)
    tb = TextBuffer(pa.array([" ".join(words_of(t)) for t in toxic + ordinary], pa.string()))
    for k in PHRASES:
        lo, hi, *counts = phrase_counts(tb, np.arange(tb.n) < len(toxic), k)
        add(*counts, lambda i: tb.data[lo[i]:hi[i]].tobytes().decode())  # noqa: B023
    share = a / n[0] + b / n[1]
    common = sorted((-share[i] * (len(w) - 1.5), w) for i, w in enumerate(names) if len(w) >= 3)
    return found, [w for _, w in common]


def build(found, common, level: float, least_odds: float) -> dict:
    """The two dictionaries' contents, of the segments above the level and odds."""
    found = [(g, w) for g, x, odds, w in found if x > level and odds > least_odds]
    own = [fill([w for _, w in sorted((-sign * g, w) for g, w in found if sign * g > 0)], CLASS_BYTES) for sign in (1, -1)]
    marks = {w for _, w in found}
    shared = fill([w for w in common if w not in marks], SHARED_BYTES)
    # the shorter one starts with filler, so that what both hold lies at the same distance
    size = max(map(len, own))
    toxic_own, ordinary_own = (bytes(1 + i * 7 % 5 for i in range(size - len(x))) + x for x in own)
    return {"toxic": toxic_own + shared, "ordinary": ordinary_own + shared}


def learn(own: list[tuple], rest: list[tuple], share: float) -> dict:
    """The dictionaries from ``own`` and the curve from ``rest``, (text, label) both, at the level that fits ``rest`` best."""
    found, common = segments([t for t, y in own if y == 1], [t for t, y in own if y == 0])
    tb, y = TextBuffer(pa.array([t for t, _ in rest])), np.array([y for _, y in rest], float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    best = None
    for level, odds in LEVELS:
        model = build(found, common, level, odds)
        x = features(tb, compressors(model))
        model |= _logistic(x, y, weight)
        p = np.clip(curve(x, model), 1e-9, 1 - 1e-9)
        fits = float(weight @ (y * np.log(p) + (1 - y) * np.log(1 - p)))
        if best is None or fits > best[0]:
            best = fits, model
    return best[1]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    mean, sd = np.average(x, axis=0, weights=weight), x.std(0) + 1e-9
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        g = z.T @ (weight * (y - p)) - 0.3 * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 0.3 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, g), -1, 1)
    return {"mean": mean, "sd": sd, "w": w}


def curve(x: np.ndarray, model: dict) -> np.ndarray:
    z = (x - model["mean"]) / model["sd"] @ model["w"][:-1] + model["w"][-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def first_part(doc_id: int) -> bool:
    """Three of five ids: their texts make the dictionaries, the others choose among them and fit the curve."""
    return int(mix(np.array([doc_id & (2 ** 64 - 1)], np.uint64))[0] % np.uint64(5)) < 3


def fit(docs: DataFrame, labels: DataFrame, usable, fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> dict | None:
    """Dictionaries from three fifths of the bounded sample, the curve from the rest."""
    rows = [(r["doc_id"], r["text"], r["y"], first_part(r["doc_id"]))
            for r in labelled_sample(docs, labels, "toxic", usable, fit_docs, fit_bytes)]
    if len({r[2] for r in rows}) < 2:
        return None
    own = [r for r in rows if r[3]] or rows
    rest = [r for r in rows if not r[3]]
    rest = rest if len({r[2] for r in rest}) == 2 else rows
    marked = exact(labels, "doc_id", "toxic")
    share = (marked.where(F.col("toxic").isin(0, 1) & usable("doc_id")).agg(F.avg("toxic")).first()[0]) or 0.5
    return learn([r[1:3] for r in own], [r[1:3] for r in rest], share)


def _score_batches(model):
    def run(batches):
        coders = compressors(model) if model else None
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                x = features(TextBuffer(part.column("text")), coders) if model else np.zeros((len(part), 7))
                p = curve(x, model) if model else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(x[:, 0])],
                                                 names=["doc_id", "score", "largest_saving"])
    return run


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score and the largest saving of a window, of every document."""
    rows = documents(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_score_batches(model), "doc_id long, score double, largest_saving double")

"""Jaccard join on word n-grams by a MinHash LSH forest, with exact verification.

A document's set holds its distinct windows of ``SHINGLE`` words (``[^\\x20\\x09-\\x0D]+``, as they
stand); a shorter text is one window of all its words. Documents with the same set are copies and
enter the join once. Each of ``TREES`` trees is a prefix trie over paths of ``DEPTH`` signature
symbols, held as rows sorted by path: the texts below a trie node are a run of rows that share a prefix.

Prefixes are shortened level by level, from whole paths on. At a level, texts below one node are
compared by signature symbols (which discards pairs far below the threshold; a pair at it is lost with
a probability below 1e-8), sorted neighbours first, and those alike form one candidate group. A node is
shortened further only while its texts are in several groups: where they are in one, a shorter prefix
could add nothing. The shortest prefix is the first at which the forest reaches the recall ``RECALL``
for pairs just at the threshold (``levels``), whatever the data. Within a group every pair is verified
on the exact sets.

No trie node or group is held or paired in one task. Nodes of more than ``BLOCK`` texts are first dealt
into blocks, anew in each tree, and every block is walked on its own; such nodes whose texts are then
still in several groups are paired block by block, only between groups. Groups are verified in pairs of
blocks, which are smaller where texts are long (``BLOCK_WINDOWS``). Pairs never become rows; a block gives each text its number of links and one link to a smaller
member.

Result, one row per document: ``class_id`` (smallest doc_id of the connected component), ``n_copies``
(documents with the same set), ``n_links`` (other documents at the threshold or above, copies
included), ``n_text_links`` (other sets at the threshold or above), ``keep`` (true for the document
whose id is the class id). Texts without words (null, empty) are alone in their class. Repeated rows
are copies. Null doc_ids join as others do; a class of only such rows has a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import components
from tallyframe.llm.store import documents, packed, stage, unpacked
from tallyframe.llm.textbuf import _ODD, SHARED_SLICE, U64, TextBuffer, grams, mix, repeats, slices, with_doc

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.99999
SKETCH = 96                   # signature symbols that pairs are compared by, one byte each
BLOCK = 512
BLOCK_WINDOWS = 1 << 20       # windows of a block of texts to be verified, about
TASK_WINDOWS = 1 << 19        # windows that a verifying task reads, about (4 MB)
PART_WINDOWS = 1 << 18        # windows of two blocks that are compared at once, about
BROADCAST_ROWS = 500_000      # candidate texts: at most so many ids are broadcast, more are shuffled


def levels(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> list[int]:
    """Prefix lengths from whole paths down to the first at which pairs at the threshold meet with this probability."""
    out = [depth]
    while out[-1] > 1 and 1 - (1 - threshold ** out[-1]) ** trees < recall:
        out.append(out[-1] - 1)
    return out


def least_matches(threshold: float, symbols: int, loss: float = 1e-8) -> int:
    """The most equal symbols that a pair at the threshold falls short of with at most this probability."""
    p, total = (1 - threshold) ** symbols, 0.0
    for k in range(symbols + 1):
        total += p
        if total > loss:
            return k
        p *= (symbols - k) / (k + 1) * threshold / (1 - threshold)
    return symbols


def shingles(tb: TextBuffer, n: int = SHINGLE):
    """(hashes, document index) of the distinct windows of each document, in document order."""
    wh = tb.word_hash()
    _, _, wd = tb.words()
    at, h = grams(wh, wd, n)
    docs = wd[at]
    count = np.bincount(wd, minlength=tb.n)
    for d in np.flatnonzero((count > 0) & (count < n)).tolist():
        lo = np.searchsorted(wd, d)
        _, own = grams(wh[lo:lo + count[d]], wd[lo:lo + count[d]], int(count[d]))
        h, docs = np.append(h, own), np.append(docs, d)
    order = np.argsort(docs, kind="stable")
    h, docs = h[order], docs[order]
    _, later = repeats(with_doc(h, docs))
    return h[~later], docs[~later]


def set_keys(h: np.ndarray, docs: np.ndarray, n: int) -> list[bytes]:
    """A 128-bit sum over each document's set."""
    out = np.zeros((n, 2), U64)
    bounds = np.searchsorted(docs, np.arange(n + 1))
    for k in range(2):
        c = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(h ^ U64(int(_ODD) * (k + 3) % 2**64)), out=c[1:])
        out[:, k] = c[bounds[1:]] - c[bounds[:-1]]
    return [r.tobytes() for r in out]


def signatures(h: np.ndarray, docs: np.ndarray, n: int, symbols: int) -> np.ndarray:
    """(n, symbols) 32-bit MinHashes; documents without windows have zeros."""
    out = np.zeros((n, symbols), np.uint32)
    if len(h):
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        factors = mix(np.arange(1, symbols + 1, dtype=U64)) | U64(1)
        have = docs[starts]
        for k in range(symbols):
            out[have, k] = np.minimum.reduceat(h * factors[k], starts) >> U64(32)
    return out


def sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest byte of each symbol."""
    return (sig & 0xFF).astype(np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def paths(sig: np.ndarray, trees: int, depth: int, shortest: int) -> np.ndarray:
    """(n, trees, 2): a hash of each path's first ``shortest`` symbols, and a byte of each further one, in order."""
    x = sig[:, :trees * depth].reshape(len(sig), trees, depth).astype(U64)
    out = np.zeros((len(sig), trees, 2), U64)
    out[:, :, 0] = U64(int(_ODD)) * np.arange(1, trees + 1, dtype=U64)
    for s in range(depth):
        if s < shortest:
            out[:, :, 0] = mix(out[:, :, 0] + x[:, :, s])
        else:
            out[:, :, 1] = out[:, :, 1] << U64(8) | x[:, :, s] & U64(0xFF)
    return out


def _signature_batches(trees: int, depth: int, shortest: int):
    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for i, j in slices(b.column("text"), SHARED_SLICE):
                part = b.slice(i, j - i)
                tb = TextBuffer(part.column("text"))
                h, docs = shingles(tb)
                sig = signatures(h, docs, tb.n, max(trees * depth, SKETCH))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(tb.n)), part.column("doc_id"), part.column("text_hash"),
                     pa.array(set_keys(h, docs, tb.n), pa.binary()),
                     pa.array(np.bincount(docs, minlength=tb.n).astype(np.int64)),
                     _binary(paths(sig, trees, depth, shortest)), _binary(sketch(sig[:, :SKETCH]))],
                    names=["row_id", "doc_id", "text_hash", "set_key", "n", "paths", "sketch"])
                row += tb.n
        pa.default_memory_pool().release_unused()
    return run


def _path_batches(batches):
    """A row of each text in each tree."""
    for b in batches:
        if len(b):
            x = np.frombuffer(b"".join(b.column("paths").to_pylist()), np.int64).reshape(len(b), -1, 2)
            for t in range(x.shape[1]):
                key, tail = np.ascontiguousarray(x[:, t, 0]), np.ascontiguousarray(x[:, t, 1])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tail), b.column("node")], names=["key", "tail", "node"])


def in_blocks(df: DataFrame, size: str, block: int) -> DataFrame:
    """Rows dealt into pairs of blocks (lo, hi) of their group of ``size`` rows; own block in ``block``."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0)))
                      .otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block"))))
    return (df.withColumn("blocks", n)
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", other)
            .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other"))


def verified_size(texts: str, windows: str):
    """A group's size for ``in_blocks``: its texts, or as many as give blocks of ``BLOCK_WINDOWS``; no more blocks than texts."""
    by_windows = F.ceil(F.col(windows) / F.lit(BLOCK_WINDOWS)) * F.lit(BLOCK)
    return F.greatest(F.col(texts), F.least(by_windows, F.col(texts) * F.lit(BLOCK)))


def whole_groups(batches, keys: list[str], rows: int):
    """Tables of whole groups of rows sorted by ``keys``, each of about ``rows`` rows, with group numbers."""
    held, n = [], 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        n += len(b)
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        g = _numbers(t, keys)
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield t.slice(0, cut), g[:cut]
        held, n = t.slice(cut).to_batches(), len(t) - cut
    if held:
        t = pa.Table.from_batches(held)
        yield t, _numbers(t, keys)


def _numbers(t: pa.Table, keys) -> np.ndarray:
    change = np.zeros(len(t), bool)
    for k in keys:
        c = np.asarray(t.column(k))
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def pairs_in_groups(group: np.ndarray, most: int = 50_000):
    """All pairs (i < j) of rows of the same group, in portions of about ``most``."""
    end = np.searchsorted(group, group, "right")
    count = end - np.arange(len(group)) - 1
    total = np.cumsum(count)
    at = 0
    while at < len(group):
        base = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, base + most, "right")), at + 1)
        c = count[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        yield i, j
        at = to


def alike(sk: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
    return (sk[i] == sk[j]).sum(1) >= least


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each node's connected component."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def descend(top: np.ndarray, tail: np.ndarray, sk: np.ndarray, lengths: list[int], least: int, label: np.ndarray) -> np.ndarray:
    """Groups of rows sorted by (top, tail): ``top`` numbers the nodes at the shortest prefix.

    ``label`` gives each row's first row of its group so far, and so does the result. Prefixes are
    shortened through ``lengths``; only nodes with several groups are looked into.
    """
    rows, below = np.arange(len(top)), None

    def join(i, j):
        other = label[i] != label[j]
        i, j = i[other], j[other]
        ok = alike(sk, i, j, least)
        return roots(len(label), np.r_[rows, i[ok]], np.r_[label, j[ok]]) if ok.any() else label

    for length in lengths:
        prefix = tail >> 8 * (lengths[0] - length)
        starts = np.flatnonzero(np.r_[True, (top[1:] != top[:-1]) | (prefix[1:] != prefix[:-1])])
        node = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(top)]))
        i = np.flatnonzero(node[1:] == node[:-1])
        label = join(i, i + 1)
        several = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        at = np.flatnonzero(several[node])
        for i, j in pairs_in_groups(node[at]):
            i, j = at[i], at[j]
            if below is not None:                    # pairs below one longer prefix have been compared
                new = below[i] != below[j]
                i, j = i[new], j[new]
            label = join(i, j)
        below = node
    return label


def _sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)


def _trie_batches(lengths: list[int], least: int):
    """Links within the blocks of trie nodes."""
    def run(batches):
        for t, top in whole_groups(batches, ["key", "block"], 20_000):
            node = np.asarray(t.column("node"))
            label = descend(top, np.asarray(t.column("tail")), _sketches(t), lengths, least, np.arange(len(node)))
            own = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], names=["a", "b"])
    return run


def _across_batches(lengths: list[int], least: int):
    """Links between the groups of wide trie nodes, within pairs of their blocks."""
    def run(batches):
        for t, top in whole_groups(batches, ["key", "lo", "hi"], 20_000):
            group = np.asarray(t.column("label"))
            _, first, place = np.unique(group, return_index=True, return_inverse=True)
            before = first[place]
            label = descend(top, np.asarray(t.column("tail")), _sketches(t), lengths, least, before)
            own = np.flatnonzero(label != before)
            yield pa.RecordBatch.from_arrays([pa.array(group[own]), pa.array(group[label[own]])], names=["a", "b"])
    return run


def candidate_groups(reps: DataFrame, lengths: list[int], least: int) -> DataFrame:
    """(node, root) of every text that shares a candidate group with another; ``reps`` has node, paths and sketch."""
    rows = stage(reps.select("node", "paths").mapInArrow(_path_batches, "key long, tail long, node long"), "paths")
    tops = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "tops")
    sketches = reps.select(F.col("node").alias("n"), "sketch")

    def below(some: DataFrame) -> DataFrame:
        met = rows.join(some.select(F.col("key").alias("k"), "size"), F.col("key") == F.col("k")).drop("k")
        return met.join(sketches, F.col("node") == F.col("n")).drop("n")

    blocks = F.ceil(F.col("size") / F.lit(BLOCK))
    dealt = below(tops).withColumn("block", F.pmod(F.xxhash64("node", "key"), blocks).cast("int")).drop("size")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "tail")
    groups = components(dealt.mapInArrow(_trie_batches(lengths, least), "a long, b long"))

    wide = tops.where(F.col("size") > BLOCK)
    if wide.isEmpty():
        return groups
    known = groups.select(F.col("node").alias("c"), "root")
    apart = stage(below(wide).join(known, F.col("node") == F.col("c"), "left")
                  .withColumn("label", F.coalesce("root", "node")).drop("c", "root"), "wide_tops")
    several = apart.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    apart = in_blocks(apart.join(several.select("k"), F.col("key") == F.col("k"), "left_semi"), "size", BLOCK)
    apart = apart.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "tail")
    across = apart.select("key", "lo", "hi", "tail", "node", "label", "sketch").mapInArrow(
        _across_batches(lengths, least), "a long, b long")
    return components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(across))


def _set_batches(batches):
    """The exact set of each candidate text, checked by its set key."""
    for b in batches:
        for i, j in slices(b.column("text"), SHARED_SLICE):
            part = b.slice(i, j - i)
            tb = TextBuffer(part.column("text"))
            h, docs = shingles(tb)
            own = np.array([a == c for a, c in zip(set_keys(h, docs, tb.n), part.column("set_key").to_pylist(), strict=True)])
            sk = sketch(signatures(h, docs, tb.n, SKETCH))
            bounds = np.searchsorted(docs, np.arange(tb.n + 1))
            at = np.flatnonzero(own)
            sets = [np.sort(h[bounds[k]:bounds[k + 1]]).tobytes() for k in at.tolist()]
            keep = part.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [keep.column(c) for c in ("node", "comp", "size", "w")]
                + [pa.array(sets, pa.binary()), _binary(sk[at])],
                names=["node", "comp", "size", "w", "set", "sketch"])
    pa.default_memory_pool().release_unused()


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets, by ranges of the hashes that hold about ``PART_WINDOWS`` each."""
    if len(sets) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    out = np.zeros((len(sets), len(sets)), np.float32)
    parts = max(1, -(-sum(map(len, sets)) // PART_WINDOWS))
    ends = np.array([2**64 * k // parts for k in range(1, parts)], U64)       # hashes are spread evenly
    cuts = [np.r_[0, np.searchsorted(s, ends), len(s)] for s in sets]
    for k in range(parts):
        _add_overlaps([s[c[k]:c[k + 1]] for s, c in zip(sets, cuts, strict=True)], out)
    return out[i, j].astype(np.int64)


def _add_overlaps(sets: list[np.ndarray], out: np.ndarray, width: int = 2048) -> None:
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(column, minlength=len(value)) > 1     # windows of one text add nothing
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m @ m.T


def _verify_batches(least: int, threshold: float):
    def run(batches):
        for t, group in whole_groups(batches, ["comp", "lo", "hi"], 2000):
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
                g = t.slice(lo, hi - lo)
                node = np.asarray(g.column("node"))
                _, first = np.unique(node, return_index=True)   # repeated rows of one text
                g = g.take(pa.array(np.sort(first)))
                node, w = np.asarray(g.column("node")), np.asarray(g.column("w"))
                block, blocks = np.asarray(g.column("block")), int(g.column("blocks")[0].as_py())
                pair_lo, pair_hi = int(g.column("lo")[0].as_py()), int(g.column("hi")[0].as_py())
                sk = _sketches(g)
                sets = [np.frombuffer(s, U64) for s in g.column("set").to_pylist()]
                size = np.array([len(s) for s in sets])
                found = []
                for i, j in pairs_in_groups(np.zeros(len(node), np.int64)):
                    # pairs inside a block belong to the task that also has the next block
                    other = np.where(block[i] == pair_lo, pair_hi, pair_lo)
                    mine = (block[i] != block[j]) | (blocks == 1) | ((block[i] + 1) % blocks == other)
                    i, j = i[mine], j[mine]
                    ok = alike(sk, i, j, least)
                    found.append((i[ok], j[ok]))
                i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
                both = overlaps(sets, i, j)
                ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                links = np.bincount(i, w[j], len(node)) + np.bincount(j, w[i], len(node))
                texts = np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
                root = roots(len(node), i, j)
                own = np.flatnonzero(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[own]), pa.array(node[root[own]]), pa.array(links[own].astype(np.int64)),
                     pa.array(texts[own].astype(np.int64))], names=["a", "b", "links", "texts"])
        pa.default_memory_pool().release_unused()
    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: its class, copies and links (see the module)."""
    lengths = levels(threshold, trees, recall)
    least = least_matches(threshold, SKETCH)
    rows = documents(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stage(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _signature_batches(trees, lengths[0], lengths[-1]),
        "row_id long, doc_id long, text_hash long, set_key binary, n long, paths binary, sketch binary"), "signatures")
    worded = signed.where("n > 0")
    # the set's first document: the smallest id, and of its texts the one with the smallest hash
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash"))
    reps = worded.groupBy("set_key").agg(F.min("row_id").alias("node"), low.alias("low"), F.count(F.lit(1)).alias("w"))
    reps = reps.select("set_key", "node", F.col("low.doc_id").alias("min_doc"), F.col("low.text_hash").alias("min_hash"), "w")
    reps = stage(reps.join(worded.select("row_id", "n", "paths", "sketch"), F.col("node") == F.col("row_id")).drop("row_id"), "texts")

    candidates = candidate_groups(reps, lengths, least)
    known = reps.select("node", "set_key", "min_doc", "min_hash", "w", F.col("n").alias("windows"))
    members = stage(candidates.select(F.col("node").alias("c"), F.col("root").alias("comp")).join(known, F.col("c") == F.col("node")).drop("c"), "members")
    groups = members.groupBy(F.col("comp").alias("g")).agg(F.count(F.lit(1)).alias("texts"), F.sum("windows").alias("all"))
    groups = groups.select("g", "texts", "all", verified_size("texts", "all").alias("size"))
    members = members.drop("windows").join(groups.select("g", "size"), F.col("comp") == F.col("g")).drop("g")
    dealt_windows = F.sum(F.col("all") * F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)) - 1, F.lit(1)))
    total = groups.agg(F.sum("texts").alias("texts"), dealt_windows.alias("windows")).first()
    side = F.broadcast(members) if (total.texts or 0) <= BROADCAST_ROWS else members
    # by id and text, so that rows which share an id (or have none) meet only the set of their own text
    own = F.col("doc_id").eqNullSafe(F.col("min_doc")) & (F.xxhash64("text") == F.col("min_hash"))
    sets = (rows.join(side, own).select("text", "node", "comp", "size", "w", "set_key")
            .mapInArrow(_set_batches, "node long, comp long, size long, w long, set binary, sketch binary")
            .dropDuplicates(["node"]))                   # repeated rows
    # a task's rows go to its worker at once, so tasks are cut by the windows in them, not by rows or by what is free
    tasks = max(1, -(-(total.windows or 0) // TASK_WINDOWS))
    sets = in_blocks(sets, "size", BLOCK).repartition(tasks, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    links = stage(sets.mapInArrow(_verify_batches(least, threshold),
                                  "a long, b long, links long, texts long"), "links")

    counted = links.groupBy(F.col("a").alias("n")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = components(links.select("a", "b"))
    named = classes.join(reps.select(F.col("node").alias("n"), F.col("min_doc").alias("d")), F.col("node") == F.col("n"))
    first = named.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.coalesce("d", F.lit(2**63 - 1)).alias("o"), "n")).alias("first"),
                                                        F.min("d").alias("class_id"))
    classes = classes.join(first, F.col("root") == F.col("r")).select(
        F.col("node").alias("c"), "class_id", F.col("first.n").alias("first_node"))
    texts = (reps.select("set_key", "node", "min_doc", "w")
             .join(counted, F.col("node") == F.col("n"), "left").join(classes, F.col("node") == F.col("c"), "left")
             .select(F.col("set_key").alias("key"), "min_doc", "w",
                     F.coalesce("class_id", "min_doc").alias("class_id"),
                     (F.coalesce("first_node", "node") == F.col("node")).alias("first"),
                     F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")))
    full = signed.select("doc_id", "text_hash", "set_key", "n").join(
        texts, (F.col("set_key") == F.col("key")) & (F.col("n") > 0), "left")
    alone = F.col("key").isNull()
    return full.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("w", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("links") + F.col("w") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        (alone | (F.col("first") & F.col("doc_id").eqNullSafe(F.col("min_doc")))).alias("keep"), "text_hash")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with one of each class left, in the columns of the input."""
    kept = near_duplicates(docs, **parameters).where("keep").select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("kept_hash")).distinct()
    left = packed(docs, "doc_id", "text").withColumn("hash", F.xxhash64(F.col("text").cast("string")))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & F.col("hash").eqNullSafe(F.col("kept_hash"))
    return unpacked(left.join(kept, own, "left_semi").dropDuplicates(["doc_id", "hash"]), docs, "doc_id", "text")

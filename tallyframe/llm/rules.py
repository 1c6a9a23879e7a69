"""Quality rules by cross-document line frequency.

Every line is normalised (words joined by one space, ASCII letters in lower case, digits as 0)
and hashed. A line's frequency is the number of documents of one host (``source``) that hold it.
A line in more than ``min_docs`` of them is taken out of every document of that host but its first carrier
(the smallest doc_id), whatever the size of the host, so one copy of whatever is repeated stays. A document that keeps less than
``min_share`` of its words is depleted and rejected, as is one that fails the base rules.

Null and empty texts have no words and fail the base rules; a null source is a host of its own.
Each input row counts as one document, repeated rows too; of rows that share the smallest doc_id,
each is a first carrier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import documents, packed, stage, text_columns, unpacked
from tallyframe.llm.textbuf import (
    FOLDED, SHARED_SLICE, U64, TextBuffer, class_of, grams, mix, repeats, slices, span_sums, with_doc,
)

MIN_DOCS = 10          # a line in this many documents of a host or fewer is never removed
HOST_SHARE = 0.0       # a caller's further limit as a share of the host's documents; none, as it would grow with the host
MIN_SHARE = 1 / 3      # words a document must keep
MIN_WORDS = 50
MAX_REPEATED_PCT = 50
SALTS = 16

SYMBOLS = class_of("#*$%&|<>")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def line_words(tb: TextBuffer, starts, ends):
    """Range of word positions of each line, as (first, last+1)."""
    ws, _, _ = tb.words()
    return np.searchsorted(ws, starts, "left"), np.searchsorted(ws, ends, "left")


def normalised_lines(tb: TextBuffer, starts, ends):
    """(hash, number of words) of each line's normalised form."""
    lo, hi = line_words(tb, starts, ends)
    h = tb.word_hash(FOLDED)
    k = np.arange(len(h), dtype=U64)
    line = np.repeat(np.arange(len(lo)), hi - lo)
    rank = k - np.repeat(lo, hi - lo).astype(U64)
    c = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h + (rank + U64(1)) * U64(0xA0761D6478BD642F)), out=c[1:])
    assert len(line) == len(h)
    return mix(c[hi] - c[lo]), hi - lo


def measures(tb: TextBuffer) -> dict[str, np.ndarray]:
    """The base counts of every document of the buffer."""
    ws, we, wd = tb.words()
    n = tb.n
    n_words = np.bincount(wd, minlength=n)
    points = (tb.data & 0xC0) != 0x80
    chars = np.bincount(wd, span_sums(points, ws, we), minlength=n).astype(np.int64)
    ls, le, ld = tb.lines()
    lo, hi = line_words(tb, ls, le)
    has = hi > lo
    _, later = repeats(with_doc(tb.spans_hash(ls[has], le[has]), ld[has]))
    dup = np.bincount(ld[has][later], minlength=n)
    at, g = grams(tb.word_hash(), wd, 3)
    many, _ = repeats(with_doc(g, wd[at]))
    covered = np.zeros(len(ws), bool)
    for k in range(3):
        covered[at[many] + k] = True
    return {"n_words": n_words, "word_chars": chars, "n_symbols": tb.per_doc(SYMBOLS[tb.data]),
            "n_dup_lines": dup, "n_repeat_words": np.bincount(wd[covered], minlength=n)}


def _measure_batches(batches):
    row = TaskContext.get().partitionId() << 36
    for b in batches:
        for i, j in slices(b.column("text"), SHARED_SLICE):
            part = b.slice(i, j - i)
            tb = TextBuffer(part.column("text"))
            cols = measures(tb)
            ls, le, ld = tb.lines()
            h, w = normalised_lines(tb, ls, le)
            keep = w > 0
            at = np.arange(len(ls)) - np.searchsorted(ld, ld)
            h, w, ld, at = h[keep].view(np.int64), w[keep], ld[keep], at[keep]
            off = np.searchsorted(ld, np.arange(tb.n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x)) for x in (h, w.astype(np.int32), at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(tb.n)), part.column("doc_id"), part.column("text_hash"), part.column("source"),
                 *[pa.array(v.astype(np.int64)) for v in cols.values()], *lists],
                names=["row_id", "doc_id", "text_hash", "host", *cols, "line", "line_words", "line_at"])
            row += tb.n
    pa.default_memory_pool().release_unused()


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: its base counts and the hashes and word counts of its lines with words."""
    rows = documents(docs, "source").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.mapInArrow(_measure_batches, "row_id long, doc_id long, text_hash long, host string, " + MEASURES
                           + ", line array<long>, line_words array<int>, line_at array<int>")


def frequent_lines(measured: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(host, line, n_docs, first_doc) of the lines above the limit."""
    lines = measured.select("host", "doc_id", F.explode(F.array_distinct("line")).alias("line"))
    freq = (lines.groupBy("host", "line")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
            .where(F.col("n_docs") > min_docs))
    if not host_share:
        return freq.select("host", "line", "n_docs", "first_doc")
    hosts = measured.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("host_docs"))
    return (freq.join(hosts, F.col("host").eqNullSafe(F.col("h")))
            .where(F.col("n_docs") > F.col("host_docs") * host_share)
            .select("host", "line", "n_docs", "first_doc"))


def line_rules(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE,
               min_share: float = MIN_SHARE) -> DataFrame:
    """Per document: base counts, ``n_removed_lines``, ``n_kept_words``, ``base_failed`` and ``kept``.

    ``removed_lines`` are the numbers of the lines taken out (null: none).
    """
    m = stage(measure(docs), "lines")
    salted = frequent_lines(m, min_docs, host_share).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = (m.select("row_id", "doc_id", F.col("host").alias("h"), F.explode(F.arrays_zip("line", "line_words", "line_at")).alias("x"))
             .select("row_id", "doc_id", "h", F.col("x.line").alias("l"), F.col("x.line_words").alias("w"), F.col("x.line_at").alias("at"),
                     F.pmod("row_id", F.lit(SALTS)).cast("int").alias("s")))
    removed = (lines.join(salted, (F.col("l") == F.col("line")) & F.col("h").eqNullSafe(F.col("host"))
                          & (F.col("s") == F.col("salt")))
               .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
               .groupBy(F.col("row_id").alias("r"))
               .agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("w").alias("removed_words"), F.collect_list("at").alias("removed_lines")))
    none = F.lit(0).cast("long")
    out = (m.drop("line", "line_words", "line_at", "host").join(removed, F.col("row_id") == F.col("r"), "left")
           .withColumn("n_removed_lines", F.coalesce("n_removed_lines", none))
           .withColumn("n_kept_words", F.col("n_words") - F.coalesce("removed_words", none))
           .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                       | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PCT)))
    depleted = F.col("n_kept_words") < F.col("n_words") * min_share
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("r", "removed_words")


def _without_lines(batches):
    """Texts without their removed lines, in the order of the lines: linear in the text."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for lo, hi in slices(batch.column("text"), SHARED_SLICE):
            b = batch.slice(lo, hi - lo)
            texts, removed = b.column("text").to_pylist(), b.column("removed_lines").to_pylist()
            for i, gone in enumerate(removed):
                if gone:
                    lines = texts[i].split("\n")
                    left = np.ones(len(lines), bool)
                    left[gone] = False
                    texts[i] = "\n".join([lines[k] for k in np.flatnonzero(left)])
            yield b.set_column(at, "text", pa.array(texts, b.schema.field(at).type))
    pa.default_memory_pool().release_unused()


def apply_rules(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that are kept, without their removed lines, in the columns of the input."""
    found = (line_rules(docs, **parameters).where("kept").dropDuplicates(["doc_id", "text_hash"])
             .select(F.col("doc_id").alias("id"), F.col("text_hash").alias("kept_hash"), "removed_lines"))
    names = text_columns(docs)
    left = packed(docs, "doc_id", *names).withColumn("hash", F.xxhash64(F.col("text").cast("string")))
    d = left.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & F.col("hash").eqNullSafe(F.col("kept_hash")))
    d = d.select("doc_id", F.col("text").cast("string"), *names[1:], "other_columns", "removed_lines")
    d = d.mapInArrow(_without_lines, d.schema)
    if "n_chars" in names:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return unpacked(d, docs, "doc_id", *names)

"""Fill-in-the-middle transformation with cuts found in a wavelet matrix of character classes.

A text is cut after whole units into prefix, middle and suffix, which are written behind marks in one
of two orders: psm ``<P>prefix<S>suffix<M>middle``, spm ``<S>suffix<P>prefix<M>middle``. Texts that
hold a mark, empty texts and those not chosen stay plain. A unit is a token (a word with the white
space before it, or white space at the end) or a line with its break.

The bytes of a batch are classed by what they are and what is before them, and a wavelet
matrix of the classes answers how many of a class lie before any position. Such ranks add up to the
number of units closed before a position and to its code points; bisection on them finds the cuts of
all texts at once, in the logarithm of the longest text.

The draws are the first 8-digit groups of the sha256 of ``42:`` and the doc_id (null: nothing), so a
retried task makes the same rows. Null texts are empty, equal rows have equal results; each input row
is one output row, an empty table has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import exact
from tallyframe.llm.textbuf import SPACE, TextBuffer, slices

SEED = 42
FIM_PCT = 50                # texts that are transformed, of 100
SPM_PCT = 80                # of those, texts in the order spm
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Classes of bytes. A blank or line break closes a word if it follows one; CONTINUATION is a later byte of a character.
BLANK, BLANK_CLOSING, BREAK, BREAK_CLOSING, CONTINUATION, WORD_OPENING, WORD = range(7)
BITS = 3


class WaveletMatrix:
    """Ranks of small symbols: a bit vector for each bit of the symbols, from the highest.

    Symbols are dealt stably by the bit of a level before the next. A level keeps its bits in 64-bit words and
    the number of ones before each word (the rank directory), so a rank takes one word a level.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        n = len(symbols)
        for bit in reversed(range(bits)):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            body = np.packbits(ones, bitorder="little")
            packed[:len(body)] = body
            words = packed.view("<u8")
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64, out=before[1:])
            self.levels.append((words, before, n - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` lie before each position."""
        low, at = 0, np.asarray(at, np.int64)
        for level, (words, before, zeros) in enumerate(self.levels):
            ones = lambda p, w=words, b=before: b[p >> 6] + np.bitwise_count(
                w[p >> 6] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)))
            one_low, one_at = ones(np.array([low]))[0], ones(at)
            if symbol >> (self.bits - 1 - level) & 1:
                low, at = zeros + int(one_low), zeros + one_at
            else:
                low, at = low - int(one_low), at - one_at
        return at - low

    def ranks(self, symbols: tuple, at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


def byte_classes(tb: TextBuffer) -> np.ndarray:
    data = tb.data
    space = SPACE[data]
    after_word = np.zeros(len(data), bool)
    after_word[1:] = ~space[:-1]
    after_word[tb.bounds[:-1][np.diff(tb.bounds) > 0]] = False
    out = np.where(after_word, np.uint8(WORD), np.uint8(WORD_OPENING))
    out[(data & 0xC0) == 0x80] = CONTINUATION
    out[space] = (after_word + 2 * (data == 10))[space]
    return out


class Units:
    """Numbers and ends of the units of all texts of a buffer."""

    # classes whose bytes end a unit, and whether they belong to it
    ENDS = {"token": ((BLANK_CLOSING, BREAK_CLOSING), 0), "line": ((BREAK, BREAK_CLOSING), 1)}

    def __init__(self, tb: TextBuffer, unit: str = "token"):
        self.low, self.high = tb.bounds[:-1], tb.bounds[1:]
        self.matrix = WaveletMatrix(byte_classes(tb), BITS)
        self.closing, self.inside = self.ENDS[unit]
        self.at_low = self.matrix.ranks(self.closing, self.low)
        last = tb.data[np.maximum(self.high - 1, 0)] if len(tb.data) else np.zeros(tb.n, np.uint8)
        if unit == "token":
            opened = self.matrix.rank(WORD_OPENING, self.high) - self.matrix.rank(WORD_OPENING, self.low)
            rest = SPACE[last]
        else:
            opened, rest = self.matrix.ranks(self.closing, self.high) - self.at_low, last != 10
        self.n = opened + (rest & (self.high > self.low))

    def end(self, units: np.ndarray) -> np.ndarray:
        """Position behind the first ``units`` units of each text."""
        low, high = self.low.copy(), self.high.copy()
        while (low < high).any():                     # the first position before which so many units are closed
            mid = (low + high) >> 1
            enough = self.matrix.ranks(self.closing, mid) - self.at_low >= units
            high = np.where(enough, mid, high)
            low = np.where(enough, low, np.minimum(mid + 1, high))
        found = low - 1 + self.inside
        return np.where(units == 0, self.low, np.where(units >= self.n, self.high, found))

    def code_points(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high - low - (self.matrix.rank(CONTINUATION, high) - self.matrix.rank(CONTINUATION, low))


def _cut_batches(unit: str, fim_pct: int, spm_pct: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def batches_of(batches):
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                tb = TextBuffer(part.column("text"))
                units = Units(tb, unit)
                h = [part.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)]
                one, two = h[0] % (units.n + 1), h[1] % (units.n + 1)
                first, second = units.end(np.minimum(one, two)), units.end(np.maximum(one, two))
                body, out, form = tb.data.tobytes(), [], []
                for low, p, q, high, draw, order in zip(
                        units.low.tolist(), first.tolist(), second.tolist(), units.high.tolist(),
                        (h[2] % 100).tolist(), (h[3] % 100).tolist(), strict=True):
                    text = body[low:high]
                    if not text or draw >= fim_pct or any(m in text for m in marks):
                        form.append("plain")
                        out.append(text)
                        continue
                    pre, mid, suf = body[low:p], body[p:q], body[q:high]
                    spm = order < spm_pct
                    form.append("spm" if spm else "psm")
                    out.append(b"".join([marks[1], suf, marks[0], pre, marks[2], mid] if spm
                                        else [marks[0], pre, marks[1], suf, marks[2], mid]))
                plain = np.array([f == "plain" for f in form], bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(units.n.astype(np.int64)), pa.array(form, pa.string()),
                     pa.array(units.code_points(units.low, first), mask=plain),
                     pa.array(units.code_points(first, second), mask=plain),
                     pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return batches_of


def transform(docs: DataFrame, unit: str = "token", fim_pct: int = FIM_PCT, spm_pct: int = SPM_PCT) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output."""
    rows = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    draws = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = rows.withColumn("draws", draws).select("doc_id", "text", *[
        F.conv(F.substring("draws", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])
    return rows.mapInArrow(_cut_batches(unit, fim_pct, spm_pct),
                           "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output: marks can't be in a transformed text, so each is found once."""
    def between(after: str, before: str | None):
        start = F.locate(after, output) + len(after)
        length = F.locate(before, output) - start if before else F.length(output)
        return F.substring(output, start, length)

    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def digests(docs: DataFrame, **parameters) -> DataFrame:
    """``transform`` with digests of the output and of the text rebuilt from it, in place of the output."""
    rows = transform(docs, **parameters)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))

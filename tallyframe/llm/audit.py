"""Filter interaction audit: what each filter removes at each place of every order of filters.

Five filters look at a whole text (null: empty; words: maximal runs of other than white space):

A: under 100 words; B: under 80 distinct words of 100; C: over 10 ASCII capitals of 100 code points;
D: holds one of ``#$%&*|``; E: equal to the text of a smaller doc_id anywhere in the table.

A document's failures make a truth table: its word has bit s set where it survives the subset s of
filters (bit i of s: filter i), so that any order of filters is a walk through subsets. Rows with the
same text, part and labels share a word, and their number enters the adder by its binary digits.
Words are added up by position with carry-save adders; 32 counts for each part and label leave a task.

Results are one row for each part (``lang``; null: empty), order and step. An empty table has none. A null
doc_id never fails E and is no smaller id; rows that repeat the smallest doc_id of a text don't fail E.
Documents without labels are neither good nor toxic; repeated label rows count as one, 1 before 0.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.store import exact

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS = 100
MIN_DISTINCT_PCT = 80
MAX_CAPITALS_PCT = 10
SYMBOLS = "[#$%&*|]"
LANES = 256              # words that one row of an adder takes
MAX_GROUPS = 4096        # parts with labels a task holds before it hands on their counts


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    fails = [F.size(words) < MIN_WORDS,
             F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT_PCT,
             F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MAX_CAPITALS_PCT,
             F.regexp_like(text, F.lit(SYMBOLS))]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))


class PositionCounts:
    """Counts of the set bits at each position of many 32-bit words, by carry-save addition.

    ``planes[k]`` holds digit k of the count of each lane and position. Rows of words are added three
    at a time (sum and carry), all rows of a digit at once, until one row is left for each digit.
    """

    def __init__(self):
        self.planes: list[np.ndarray] = []

    def add(self, words: np.ndarray, digit: int = 0):
        rows = np.zeros(-(-len(words) // LANES) * LANES, np.uint32)
        rows[:len(words)] = words
        rows = rows.reshape(-1, LANES)
        while len(rows):
            while len(self.planes) <= digit:
                self.planes.append(np.zeros(LANES, np.uint32))
            rows, carries = np.vstack([rows, self.planes[digit]]), []
            while len(rows) > 2:
                n = len(rows) // 3
                a, b, c = rows[:n], rows[n:2 * n], rows[2 * n:3 * n]
                half = a ^ b
                carries.append((a & b) | (half & c))
                rows = np.vstack([half ^ c, rows[3 * n:]])
            if len(rows) == 2:
                carries.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
            self.planes[digit] = rows[0]
            rows = np.vstack(carries)
            rows = rows[rows.any(axis=1)]
            digit += 1

    def add_times(self, words: np.ndarray, times: np.ndarray):
        """Each word as often as ``times`` says: once in the digit of each binary one of it."""
        for digit in range(int(times.max(initial=0)).bit_length()):
            some = words[(times >> digit) & 1 == 1]
            if len(some):
                self.add(some, digit)

    def totals(self) -> list[int]:
        out = [0] * 32
        for digit, plane in enumerate(self.planes):
            ones = np.unpackbits(plane.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32).sum(axis=0)
            out = [a + (int(b) << digit) for a, b in zip(out, ones, strict=True)]
        return out


SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & fails) for fails in range(SUBSETS)], np.uint32)


def _count_batches(batches):
    held: dict[tuple, PositionCounts] = {}

    def handed_on():
        keys = list(held)
        rows = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
             pa.array([k[2] for k in keys], pa.bool_()), pa.array([held[k].totals() for k in keys], pa.list_(pa.int64()))],
            names=["part", "good", "toxic", "counts"])
        held.clear()
        return rows

    for b in batches:
        parts = b.column("part").dictionary_encode()
        words = SURVIVAL[b.column("fails").to_numpy(zero_copy_only=False)]
        times = b.column("times").to_numpy(zero_copy_only=False)
        names = parts.dictionary.to_pylist()
        flags = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic")]
        key = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + flags[0] * 2 + flags[1]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        for at in np.split(order, starts[1:]):
            if not len(at):
                continue
            part, label = divmod(int(key[at[0]]), 4)
            group = held.setdefault((names[part], label > 1, label % 2 == 1), PositionCounts())
            group.add_times(words[at], times[at])
            if len(held) > MAX_GROUPS:
                yield handed_on()
    if held:
        yield handed_on()


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, fails (bits of the filters failed), times: the documents' words with their numbers.

    Rows of one text are counted before any of them meet, and at most one row for each part and
    label of a text is compared by the text's digest, so copies never gather in a task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = exact(docs, "doc_id", "text", "lang").select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("fails"))
    rows = rows.groupBy("doc_id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    marks = (exact(labels, "doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")))
    rows = rows.join(marks, F.col("doc_id") == F.col("id"), "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    copies = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"))
    copies = copies.withColumn("first", F.min("low.doc_id").over(Window.partitionBy("digest")))
    originals = F.col("no_id") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    kinds = F.array(F.struct(F.col("fails").alias("fails"), originals.alias("times")),
                    F.struct((F.col("fails") + (1 << 4)).alias("fails"), (F.col("n") - originals).alias("times")))
    return (copies.select("part", "good", "toxic", F.explode(kinds).alias("x"))
            .select("part", "good", "toxic", "x.fails", "x.times").where("times > 0"))


def subset_survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part: ``s``, an array over subsets of structs (n, good, toxic) of survivors."""
    counts = survival_words(docs, labels).mapInArrow(
        _count_batches, "part string, good boolean, toxic boolean, counts array<long>")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    by_subset = (counts.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
                 .groupBy("part", "subset").agg(F.sum("n").alias("n"), n(F.col("good")).alias("good"), n(F.col("toxic")).alias("toxic")))
    # 32 rows for each part
    return by_subset.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step (see the module)."""
    survivors = subset_survivors(docs, labels)
    at = lambda subset, field="n": F.get("s", subset)[field]
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = (survivors.select("part", "s", F.explode(orders).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")))
    place = lambda f: F.instr("filter_order", f)

    def subset(where):
        return sum((F.when(where(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    steps = steps.select("*", subset(lambda f: place(f) < F.col("step")).alias("before"),
                         subset(lambda f: place(f) == F.col("step")).alias("own"))
    before, own = F.col("before"), F.col("own")
    after, full = before + own, SUBSETS - 1
    lost = lambda field="n": at(before, field) - at(after, field)
    # in orders: a filter comes right after the subset t in |t|! * (4 - |t|)! of them
    orders_of = [math.factorial(t.bit_count()) * math.factorial(len(FILTERS) - 1 - t.bit_count()) for t in range(full)]
    shapley = sum((F.when(F.lit(t).bitwiseAND(own) == 0, (at(F.lit(t)) - at(F.lit(t) + own)) * orders_of[t]).otherwise(0)
                   for t in range(full)), F.lit(0))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int"),
        at(after).alias("kept"), lost().alias("removed"),
        (at(F.lit(0)) - at(own) - lost()).alias("redundant"),
        (at(F.lit(full) - own) - at(F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"))


def oracle() -> str:
    """The same rows in DuckDB: the step at which each kind of document goes, in every order."""
    return r"""
WITH l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
             100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
      FROM w LEFT JOIN l USING (doc_id)),
kinds AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n FROM d GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
           FROM letter a JOIN letter b ON b.f <> a.f JOIN letter c ON c.f NOT IN (a.f, b.f)
           JOIN letter d ON d.f NOT IN (a.f, b.f, c.f) JOIN letter e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
gone AS (SELECT k.*, filter_order,
                coalesce(list_min([i FOR i IN range(1, 6) IF fails[ascii(filter_order[i]) - 64]]), 6) AS goes
         FROM kinds k CROSS JOIN orders),
steps AS (SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS f,
                 sum(n) FILTER (WHERE goes > step) AS kept, sum(n) FILTER (WHERE goes = step) AS removed,
                 sum(n) FILTER (WHERE goes < step AND fails[ascii(filter_order[step]) - 64]) AS redundant,
                 sum(n) FILTER (WHERE fails[ascii(filter_order[step]) - 64] AND len([x FOR x IN fails IF x]) = 1) AS unique_fails,
                 sum(n) FILTER (WHERE goes = step AND good) AS good_lost,
                 sum(n) FILTER (WHERE goes = step AND toxic) AS toxic_lost
          FROM gone CROSS JOIN range(1, 6) t(step) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM steps"""

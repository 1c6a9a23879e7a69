"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph is a run of text up to a line break or a sentence's end; blank ones do not count. Each is
hashed to a wide vector: ``WIDE`` lanes of 32 bits, expanded from its sha256. A document's fingerprint is
the sum of its paragraphs' vectors modulo 2^32 in every lane, with a sketch behind it. Sums do not depend
on order; a paragraph is inserted or deleted by adding or subtracting its vector (``combine``).

Sums of uniform lanes tell multisets apart but not how far, so the sketch keeps that: sums of 128 0/1
lanes, two 32-bit lanes to a 64-bit word. A text within Spark's limit of 2 GB has at most 2^30 paragraphs,
so no lane of the sketch and no difference of two leaves 31 bits, and no sum of wide lanes leaves 62.
Read as +-1 vectors, the mean square of a difference of two sketches estimates the number of
paragraphs in which the multisets differ, and that of one its size; likeness is one minus the first
over the sum of the sizes, cut to 0..1. It is 1 for equal multisets, about 0 for disjoint ones.

Null and empty texts have the zero fingerprint; two of them have likeness 1, one and another text 0.
Rows are ordered by (doc_id, hash of the text, text), null ids last, and the first follows the last, also
in a table without ids; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.store import documents

WIDE = 32                      # lanes modulo 2^32
WIDE_BITS = 32
HASHES = 2                     # of the sketch, 64 lanes each
LANES = 64 * HASHES
PER_WORD = 2
BITS = 32                      # of a lane
WORDS = -(-LANES // PER_WORD)
BREAK = r"\n|(?<=[.!?])[\x20\t]+"


def wide_lanes(h: list) -> list:
    """The wide vector of a paragraph: two lanes of each of its hashes ``h``."""
    low = F.lit((1 << WIDE_BITS) - 1).cast("long")
    return [lane for x in h for lane in (x.bitwiseAND(low), F.shiftrightunsigned(x, WIDE_BITS))]


def modulo(lane):
    return lane.bitwiseAND(F.lit((1 << WIDE_BITS) - 1).cast("long"))


def lane_words(h: list) -> list:
    """The packed sketch of a paragraph: lane i holds bit i of its hashes ``h``."""
    out = []
    for w in range(WORDS):
        word = None
        for j in range(PER_WORD):
            lane = w * PER_WORD + j
            if lane < LANES:
                bit = F.shiftrightunsigned(h[lane // 64], lane % 64).bitwiseAND(F.lit(1).cast("long"))
                bit = F.shiftleft(bit, BITS * j) if j else bit
                word = bit if word is None else word.bitwiseOR(bit)
        out.append(word)
    return out


def paragraphs(text):
    return F.filter(F.split(text, BREAK), lambda p: F.length(F.trim(p)) > 0)


def hex_of(fp):
    """The wide lanes, then the sketch, in lower-case hex."""
    def joined(words, digits):
        return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), digits, "0")), "")
    return F.concat(joined(fp["wide"], WIDE_BITS // 4), joined(fp["sketch"], 16))


def _lane(word, j: int):
    """Signed lane j of a difference of words."""
    rest = word
    for k in range(j + 1):
        low = rest.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
        signed = F.when(low >= 1 << (BITS - 1), low - (1 << BITS)).otherwise(low)
        if k == j or k == PER_WORD - 1:
            return signed if k < PER_WORD - 1 else rest
        rest = F.shiftright(rest - signed, BITS)
    return rest


def squares(a, b, n_a, n_b):
    """Sum over lanes of the squared difference of two sketches read as +-1 vectors."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    n = (n_a - n_b).cast("double")

    def add(acc, word):
        for j in range(PER_WORD):
            acc = acc + F.pow(F.lit(2.0) * _lane(word, j) - n, F.lit(2.0))
        return acc
    unused = WORDS * PER_WORD - LANES           # lanes of the last word that are always zero
    return F.aggregate(d, F.lit(0.0), add) - F.lit(float(unused)) * n * n


def likeness(a, b, n_a, n_b):
    none = F.transform(a, lambda x: F.lit(0).cast("long"))
    size = squares(a, none, n_a, F.lit(0)) + squares(b, none, n_b, F.lit(0))
    raw = F.lit(1.0) - squares(a, b, n_a, n_b) / F.when(size > 0, size)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(1.0))


def combine(a, b, sign: int = 1):
    """The fingerprint ``a`` after inserting (1) or deleting (-1) the paragraphs of ``b``."""
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: modulo(x + y if sign > 0 else x - y))
    sketch = F.zip_with(a["sketch"], b["sketch"], lambda x, y: x + y if sign > 0 else x - y)
    return F.struct(wide.alias("wide"), sketch.alias("sketch"))


def sums(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Fingerprint ``fp`` (wide, sketch) and number of paragraphs ``np`` of ``text`` for each key."""
    parts = rows.select(*keys, F.explode_outer(paragraphs(F.col(text))).alias("p"))
    parts = parts.select(*keys, F.col("p").isNotNull().cast("long").alias("c"), F.sha2(F.col("p").cast("binary"), 256).alias("d"))
    zero, n = F.lit(0).cast("long"), WIDE // 2 + HASHES
    hashes = [F.when(F.col("d").isNull(), zero).otherwise(F.xxhash64(F.lit(k), F.col("d"))).alias(f"h{k}") for k in range(n)]
    parts = parts.select(*keys, "c", *hashes)
    wide = wide_lanes([F.col(f"h{k}") for k in range(WIDE // 2)])
    sketch = lane_words([F.col(f"h{k}") for k in range(WIDE // 2, n)])
    parts = parts.select(*keys, "c", *[x.alias(f"m{i}") for i, x in enumerate(wide)], *[x.alias(f"w{i}") for i, x in enumerate(sketch)])
    out = parts.groupBy(*keys).agg(F.sum("c").alias("np"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(WIDE)],
                                   *[F.sum(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    return out.select(*keys, "np", F.struct(F.array(*[modulo(F.col(f"m{i}")) for i in range(WIDE)]).alias("wide"),
                                            F.array(*[f"w{i}" for i in range(WORDS)]).alias("sketch")).alias("fp"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, fingerprint (hex) of each document."""
    d = documents(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
                               F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return sums(d, ["row", "doc_id"], "text").select(
        "doc_id", F.col("np").alias("n_paragraphs"), hex_of(F.col("fp")).alias("fingerprint"))


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows dealt into buckets of consecutive (doc_id, hash), each also with the first rows of the next one.

    Bucket bounds are quantiles of the doc_ids. An id that is several bounds at once, as one that a third of
    the rows share, has that many buckets, by ranges of the text's hash; null ids have buckets for their
    share of the rows. A bucket's first rows are also sent to the bucket before (``ahead``), and the table's
    first rows to the last bucket, which closes the circle; a single bucket gets its own. The driver sees the bounds and
    the first key of each bucket.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = documents(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, with_id = d.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    found = d.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 1 / (10 * buckets)) if with_id else []
    bounds = sorted(int(b) for b in found)
    for_null = max(1, round(buckets * (rows - with_id) / max(rows, 1)))
    at = F.array(*[F.lit(b).cast("long") for b in bounds]).cast("array<bigint>")
    part = F.col("hash") / F.lit(2.0 ** 64) + F.lit(0.5)          # 0 to 1, in the order of the hash

    def share(n):
        return F.least(F.floor(part * n), n - F.lit(1)).cast("int")
    same = F.size(F.filter(at, lambda b: b == F.col("doc_id")))
    own = F.size(F.filter(at, lambda b: b < F.col("doc_id"))) + F.when(same > 1, share(same)).otherwise(0)
    d = d.withColumn("hash", F.xxhash64("text"))
    d = d.withColumn("own", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1) + share(F.lit(for_null))).otherwise(own))
    key = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "hash")
    firsts = sorted(d.groupBy("own").agg(F.min(key).alias("k")).collect())        # one row for each bucket
    size = len(bounds) + 1 + for_null
    ids, hashes, before = [None] * size, [None] * size, [None] * size
    for i, (bucket, k) in enumerate(firsts):
        ids[bucket], hashes[bucket], before[bucket] = k.doc_id, k.hash, firsts[i - 1].own

    def listed(values, kind):
        return F.array(*[F.lit(v).cast(kind) for v in values])[F.col("own")]
    first = F.col("doc_id").eqNullSafe(listed(ids, "long")) & (F.col("hash") == listed(hashes, "long"))
    here = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ahead"))
    there = F.struct(listed(before, "int").alias("bucket"), F.lit(True).alias("ahead"))
    d = d.select("doc_id", "text", "hash", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("x"))
    return d.select("doc_id", "text", "hash", F.col("x.bucket").alias("bucket"), F.col("x.ahead").alias("ahead"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by the first as many (or all) of the
    next document, ascending doc_id; after the last comes the first.
    """
    order = [F.col("ahead"), F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("text")]
    w = Window.partitionBy("bucket").orderBy(*order)
    q = F.floor(F.col("n_chars") / 4).cast("int")
    d = (in_order(docs).withColumn("n_chars", F.length("text").cast("long"))
         .withColumn("pos", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("text").over(w), F.lit(""))))
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - q),
                                        F.substring(F.col("next"), F.lit(1), q)))
    d = d.withColumn("edited_sha256", F.when(~F.col("ahead"), F.sha2(F.col("edited").cast("binary"), 256)))
    mine = F.struct(F.lit(0).alias("v"), F.col("text").alias("t"))
    other = F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"))
    # the row that was sent ahead stands for the next document only; rows after the first one are not needed
    d = d.withColumn("x", F.explode(F.when(F.col("ahead"), F.array(mine)).otherwise(F.array(mine, other))))
    keys = ["bucket", "pos", "v", "ahead", "doc_id", "n_chars", "edited_sha256"]
    f = sums(d.withColumn("v", F.col("x.v")).withColumn("t", F.col("x.t")), keys, "t")
    by = Window.partitionBy("bucket").orderBy("pos", "v")
    f = (f.withColumn("fp1", F.lead("fp", 1).over(by)).withColumn("np1", F.lead("np", 1).over(by))
         .withColumn("fp2", F.lead("fp", 2).over(by)).withColumn("np2", F.lead("np", 2).over(by)))
    f = f.where((F.col("v") == 0) & ~F.col("ahead"))
    return f.select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"),
        hex_of(F.col("fp1")).alias("edited_fingerprint"),
        likeness(F.col("fp.sketch"), F.col("fp1.sketch"), F.col("np"), F.col("np1")).alias("near_edited"),
        likeness(F.col("fp.sketch"), F.coalesce("fp2.sketch", "fp.sketch"), F.col("np"), F.coalesce("np2", "np")).alias("near_next"),
        F.col("np").alias("n_paragraphs"))

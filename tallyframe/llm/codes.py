"""Directly addressable codes for token ids.

Ids are split into chunks of ``CHUNK_BITS`` bits, lowest first. Level k holds the k-th chunk of every
id that has one, with a bitmap telling which of them go on to level k+1 and a directory of the number
of set bits before each block of the bitmap. Token i is read by following ranks from level to level:
its place on the next level is the rank of its bit, so no block is decoded.

The file format is a Parquet table of segments. A segment holds the ids of consecutive documents of
one range of doc_ids (a document is never cut), the documents' ids and lengths, and the code's levels
one after another. Documents are in ascending order of (doc_id, text), nulls first.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.hf import chunk_ids
from tallyframe.llm.packing import batches_of_arrow
from tallyframe.llm.store import documents
from tallyframe.session import scratch_path

CHUNK_BITS = 8
BLOCK = 512                       # bits of a bitmap for each entry of its rank directory
SEGMENT_IDS = 1 << 18
SEGMENT = ("part int, segment int, part_start long, n_tokens long, doc_ids binary, doc_null binary, "
           "doc_sizes binary, codes binary")
_HEAD = "<QQQ"


def encode(ids: np.ndarray) -> bytes:
    """The levels of the code: for each, sizes, chunks, bitmap and rank directory."""
    rest, out = np.asarray(ids, np.uint64), []
    while True:
        chunk = (rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        rest = rest >> np.uint64(CHUNK_BITS)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = (np.cumsum(ones) - ones).astype("<u8")
        out += [struct.pack(_HEAD, len(chunk), len(bitmap), len(ranks)), chunk.tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest = rest[more]
        if not len(rest):
            return b"".join(out)


class Codes:
    """Random access to the ids of one segment."""

    def __init__(self, data: bytes):
        self.levels, at = [], 0
        while at < len(data):
            n, bits, ranks = struct.unpack_from(_HEAD, data, at)
            at += struct.calcsize(_HEAD)
            chunk = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, bits, at + n)
            directory = np.frombuffer(data, "<u8", ranks, at + n + bits)
            at += n + bits + 8 * ranks
            self.levels.append((chunk, bitmap, directory))

    def __len__(self):
        return len(self.levels[0][0])

    def rank(self, level: int, i: int) -> int:
        """Set bits of the level's bitmap before place i."""
        chunk, bitmap, directory = self.levels[level]
        if i >= len(chunk):
            block = len(directory) - 1
            if block < 0:
                return 0
        else:
            block = i // BLOCK
        lo = block * BLOCK
        return int(directory[block]) + int(np.unpackbits(bitmap[lo // 8:-(-i // 8)], bitorder="little")[:i - lo].sum())

    def get(self, first: int, n: int = 1) -> np.ndarray:
        """The ids first .. first+n-1: one rank on each level, then plain array reads."""
        out = np.zeros(n, np.uint64)
        at, level, alive = first, 0, np.arange(n)
        while len(alive):
            chunk, bitmap, _ = self.levels[level]
            m = len(alive)
            out[alive] |= chunk[at:at + m].astype(np.uint64) << np.uint64(CHUNK_BITS * level)
            lo = at // 8
            more = np.unpackbits(bitmap[lo:-(-(at + m) // 8)], bitorder="little")[at - 8 * lo:at - 8 * lo + m].astype(bool)
            alive = alive[more]
            if len(alive):
                at = self.rank(level, at)
            level += 1
        return out


def _segment_batches(path: str, end_id: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = chunk_ids(path, True)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held, held_ids, total = [], [], 0

        def flush():
            nonlocal number, before, total
            ids = np.concatenate(held_ids)
            size = np.array([n for _, n in held], "<i8")
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before]), pa.array([total]),
                 pa.array([np.array([d or 0 for d, _ in held], "<i8").tobytes()], pa.binary()),
                 pa.array([np.array([d is None for d, _ in held]).tobytes()], pa.binary()),
                 pa.array([size.tobytes()], pa.binary()), pa.array([encode(ids)], pa.binary())],
                names=[x.split()[0] for x in SEGMENT.split(", ")])
            number, before, total = number + 1, before + total, 0
            held.clear()
            held_ids.clear()
            return out

        for b in batches:
            keys, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i, j in batches_of_arrow(texts):
                flat, per = ids_of.texts([t or "" for t in texts.slice(i, j - i).to_pylist()])
                at = 0
                for k, n in enumerate(per.tolist()):
                    held.append((keys[i + k], n + 1))
                    held_ids += [flat[at:at + n], np.array([end_id], np.uint32)]
                    at += n
                    total += n + 1
                    if total >= SEGMENT_IDS:
                        yield flush()
        if held:
            yield flush()
    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode the documents and write their ids in ascending order of doc_id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segment_batches(tokenizer_path, end_id), SEGMENT).write.parquet(path)


def _runs(size: np.ndarray, most: int = 1 << 17):
    """Ranges of documents of about ``most`` ids, or one longer document."""
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(size):
        yield at, len(size)


def _document_batches(starts: dict):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                codes = Codes(r["codes"])
                size = np.frombuffer(r["doc_sizes"], "<i8")
                null = np.frombuffer(r["doc_null"], bool)
                first = np.cumsum(size) - size
                # neighbours in a segment are read with one descent through the levels
                crc = []
                for i, j in _runs(size):
                    ids = codes.get(int(first[i]), int(size[i:j].sum())).astype("<u4")
                    at = first[i]
                    crc += [zlib.crc32(ids[a - at:a - at + n]) for a, n in zip(first[i:j].tolist(), size[i:j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null),
                     pa.array(first + r["part_start"] + starts.get(r["part"], 0)), pa.array(size),
                     pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    The only rows that reach the driver are the totals of the partitions that were written.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]
    return files.mapInArrow(_document_batches(starts), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    path = scratch_path(docs.sparkSession, "codes")
    write(docs, path, tokenizer_path, end_id)
    return read_documents(docs.sparkSession, path)

"""Packing of token sequences into windows by the online sum-of-squares rule.

Each task packs the documents of its partition in the order they are read. A document's ids are cut
at whole windows; what is left goes into the fill level (0: a new window) whose use makes the sum of
squares of the counts of partly filled windows smallest, the counts being kept in an array by level.
When a task ends, its partly filled windows are merged: the emptiest are cut up to fill the fullest,
and the one that remains is cut into sequences of power-of-two lengths, which need no padding.

A null or empty text is the end id alone. Repeated rows are packed as documents of their own.
A task is a function of its partition's rows, so a lost one can be run again; sequence ids hold
the partition's number in their upper bits.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.hf import chunk_ids
from tallyframe.llm.store import documents
from tallyframe.llm.wordids import MAX_CHUNKS

WINDOW = 4096
END_ID = 2
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


class Packer:
    """Sum-of-squares packing of (key, start, ids) pieces into windows of ``size`` ids.

    ``emit(sequence number, pieces)`` gets each finished window, pieces as [(key, start, ids)].
    """

    def __init__(self, emit, size: int = WINDOW):
        self.emit, self.size, self.sequences = emit, size, 0
        self.count = np.zeros(size + 1, np.int64)      # partly filled windows by fill level
        self.open = [[] for _ in range(size + 1)]      # their pieces

    def _close(self, pieces):
        self.emit(self.sequences, pieces)
        self.sequences += 1

    def add(self, key, ids: np.ndarray):
        at = 0
        while len(ids) - at >= self.size:
            self._close([(key, at, ids[at:at + self.size])])
            at += self.size
        if at < len(ids):
            self._place((key, at, ids[at:]))

    def level_for(self, n: int) -> int:
        """The level whose use adds least to the sum of squares; of ties the fullest."""
        c = self.count
        last = self.size - n
        # from level h to h+n: count[h] falls by one (h > 0), count[h+n] rises by one (h+n < size)
        cost = 2 * c[n:n + last + 1] + 1
        cost[last] = 0
        cost[1:] += 1 - 2 * c[1:last + 1]
        usable = c[:last + 1] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return last - int(np.argmin(cost[::-1]))

    def _place(self, piece):
        n = len(piece[2])
        h = self.level_for(n)
        pieces = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        pieces.append(piece)
        if h + n == self.size:
            self._close(pieces)
        else:
            self.open[h + n].append(pieces)
            self.count[h + n] += 1

    def finish(self):
        """Merge the partly filled windows; the last one is cut at powers of two."""
        windows = [w for level in self.open for w in level]          # emptiest first
        self.open, self.count[:] = [[] for _ in range(self.size + 1)], 0
        spare = []
        while windows:
            full = windows.pop()
            room = self.size - sum(len(p[2]) for p in full)
            while room and (spare or windows):
                spare = spare or windows.pop(0)
                key, start, ids = spare.pop()
                take = min(room, len(ids))
                full.append((key, start, ids[:take]))
                room -= take
                if take < len(ids):
                    spare.append((key, start + take, ids[take:]))
            if room:
                self._halve(full, self.size - room)
            else:
                self._close(full)
        if spare:
            self._halve(spare, sum(len(p[2]) for p in spare))

    def _halve(self, pieces, total: int):
        pieces = pieces[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            room, out = total & (1 << bit), []
            while room:
                key, start, ids = pieces.pop()
                out.append((key, start, ids[:room]))
                if len(ids) > room:
                    pieces.append((key, start + room, ids[room:]))
                room -= min(room, len(ids))
            if out:
                self._close(out)


def _pack_batches(path: str, size: int, max_chunks: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = chunk_ids(path, False, max_chunks)
        base = TaskContext.get().partitionId() << 36
        rows, totals = [], []

        def emit(number, pieces):
            at = 0
            length = sum(len(p[2]) for p in pieces)
            for key, start, ids in pieces:
                rows.append((key[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), key[1],
                             base + number, at, length))
                at += len(ids)

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            rows.clear()
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        packer = Packer(emit, size)
        for b in batches:
            keys, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i, j in batches_of_arrow(texts):
                flat, per = ids_of.texts([t or "" for t in texts.slice(i, j - i).to_pylist()])
                at = 0
                for k, n in enumerate(per.tolist()):
                    ids = np.append(flat[at:at + n], np.uint32(END_ID))
                    at += n
                    packer.add((keys[i + k], n + 1), ids)
                yield flush()
        packer.finish()
        totals.append(packer.sequences)
        yield flush()
    return run


def batches_of_arrow(texts: pa.Array, max_bytes: int = 1 << 21):
    from tallyframe.llm.textbuf import slices

    return slices(texts, max_bytes)


def pack(docs: DataFrame, tokenizer_path: str, size: int = WINDOW, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """One row for each piece of a document in a sequence.

    ``max_chunks`` bounds the table of known chunks that each Python worker keeps; ids don't depend on it.
    """
    rows = documents(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_pack_batches(tokenizer_path, size, max_chunks), PIECES)

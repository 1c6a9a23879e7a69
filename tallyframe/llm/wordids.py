"""Token ids of whole texts from the ids of their chunks.

A text is cut into chunks at places no token can span; each distinct chunk of a task is encoded
once and kept in a table of bounded size, and a document's ids are gathered from it with numpy.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np

MAX_CHUNKS = 800_000       # distinct chunks kept; those of later batches are forgotten after each
STALE = 0.3                # share of new chunks in a batch at which a full table starts afresh


class _Codes(dict):
    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, chunk):
        code = self[chunk] = len(self)
        self.new.append(chunk)
        return code


class ChunkIds:
    """``encode(list of chunks) -> (flat ids, lengths)``; ``split(text) -> chunks``."""

    def __init__(self, split: Callable, encode: Callable, max_chunks: int = MAX_CHUNKS):
        self.split, self.encode, self.max_chunks = split, encode, max_chunks
        self._reset()

    def _reset(self):
        self.codes = _Codes()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _learn(self):
        new = self.codes.new
        if not new:
            return
        flat, size = self.encode(new)
        n, at = len(flat), len(self.codes) - len(new)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.codes) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used:self.used + n] = flat
        self.size[at:at + len(new)] = size
        self.start[at:at + len(new)] = self.used + np.cumsum(size) - size
        self.used += n
        self.codes.new = []

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text)."""
        # no cycles are made here, and walks over the table's many objects would cost a fifth of the time
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known, used = len(self.codes), self.used
        get = self.codes.__getitem__
        coded, n = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            chunks = self.split(t)
            n[k] = len(chunks)
            coded.append(np.fromiter(map(get, chunks), np.int64, len(chunks)))
        new = self.codes.new
        self._learn()
        code = np.concatenate(coded) if coded else np.zeros(0, np.int64)
        size = self.size[code]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.start[code] - total[:-1], size) + np.arange(total[-1])]
        ends = np.cumsum(n)
        per = total[ends] - total[ends - n]
        if len(self.codes) > self.max_chunks:
            if len(new) > STALE * len(code):
                self._reset()
            else:
                for chunk in new:               # codes are given out in order: the last ones go
                    del self.codes[chunk]
                self.used = used
            assert len(self.codes) in (0, known)
        return flat, per


def batches_of(texts: list[str], max_chars: int = 1 << 21):
    """Ranges of texts of at most ``max_chars`` together, or one longer text."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > max_chars:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)

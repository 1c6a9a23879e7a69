"""Whole texts of an Arrow batch as one byte buffer: words, lines and their hashes with numpy.

All positions are byte positions in the UTF-8 buffer. White space is ``[\\x20\\x09-\\x0D]``.
Hashes are 64-bit polynomials over random byte values, finished by a mixing step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_INV = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


VALUES = mix(np.arange(1, 257, dtype=U64) * _ODD)
_fold = np.arange(256)
_fold[65:91] += 32
_fold[48:58] = 48
FOLDED = VALUES[_fold]                     # ASCII letters to lower case, digits to 0
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def class_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, _BASE, U64), np.full(size, _INV, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down


POWERS = _Powers()


# Bytes of text whose hashes a worker makes at once where other stages share it: a buffer's arrays take
# many times its bytes, and the powers of the longest buffer stay.
SHARED_SLICE = 1 << 19


def slices(arr: pa.Array, max_bytes: int = 2 << 20):
    """(first, last+1) document ranges of at most ``max_bytes`` of text, or one longer document."""
    if not len(arr):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(arr), 0))
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > max_bytes:
            yield at, i
            at, total = i, 0
        total += n
    yield at, len(arr)


class TextBuffer:
    def __init__(self, arr: pa.Array):
        arr = pc.fill_null(arr, "")
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        wide = pa.types.is_large_string(arr.type)
        off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
        body = arr.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        self.n = len(arr)
        self.data = data[off[0]:off[-1]]
        self.bounds = off.astype(np.int64) - off[0]
        self._words = None

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, pos, "right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of per-byte flags in each document."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.bounds[1:]] - c[self.bounds[:-1]]

    def words(self):
        """(starts, ends, document index) of all words."""
        if self._words is None:
            w = ~SPACE[self.data]
            prev, nxt = np.zeros_like(w), np.zeros_like(w)
            prev[1:], nxt[:-1] = w[:-1], w[1:]
            inner = self.bounds[(self.bounds > 0) & (self.bounds < len(w))]
            prev[inner] = False
            nxt[inner - 1] = False
            starts = np.flatnonzero(w & ~prev)
            self._words = starts, np.flatnonzero(w & ~nxt) + 1, self.doc_of(starts)
        return self._words

    def lines(self):
        """(starts, ends, document index) of all lines split at ``\\n``; an empty text has none."""
        nl = np.flatnonzero(self.data == 10)
        full = np.flatnonzero(np.diff(self.bounds) > 0)
        starts = np.sort(np.concatenate([self.bounds[full], nl + 1]))
        ends = np.sort(np.concatenate([self.bounds[full + 1], nl]))
        docs = np.sort(np.concatenate([full, self.doc_of(nl)]))
        return starts, ends, docs

    def spans_hash(self, starts, ends, values=VALUES, keep: np.ndarray | None = None) -> np.ndarray:
        """Hash of each span's bytes (``keep``: only bytes of these values)."""
        n = len(self.data)
        if not len(starts):
            return np.zeros(0, U64)
        up, down = POWERS.get(n + 1)
        c = np.zeros(n + 1, U64)
        t = values[self.data] * up[:n]
        if keep is not None:
            t[~keep[self.data]] = 0
        np.cumsum(t, out=c[1:])
        return mix((c[ends] - c[starts]) * down[starts])

    def word_hash(self, values=VALUES) -> np.ndarray:
        s, e, _ = self.words()
        return self.spans_hash(s, e, values)


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[ends] - c[starts]


def grams(h: np.ndarray, docs: np.ndarray, n: int):
    """(first word position, hash) of every n-word window inside one document."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(docs[n - 1:] == docs[:len(docs) - n + 1])
    x = np.zeros(len(at), U64)
    for k in range(n):
        x = x * _BASE + h[at + k]
    return at, mix(x)


def with_doc(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The hash made different for each document of the buffer."""
    return mix(h + (docs.astype(U64) + U64(1)) * _ODD)


def repeats(keys: np.ndarray):
    """(occurs twice or more, equals an earlier entry) of each key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    if len(k):
        same[1:-1] = k[1:] == k[:-1]
    many, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    many[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return many, later

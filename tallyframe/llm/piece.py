"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A text is a string of symbols in which a space is U+2581, with one more in front. No piece goes on
from another symbol into a space symbol, so merges stay inside "words": a run of space symbols and
what follows it. Words are encoded together in flat numpy arrays. In each round every word's best
pair is found by a segmented minimum over pair ranks, its leftmost occurrences are merged at the same
time, and the arrays are compacted, until no pair remains. Symbols left without an id become the
bytes of their UTF-8 form.

Merging several occurrences at once equals one at a time unless a new pair ranks before the old one;
such words merge only their first occurrence in that round.

Null and empty texts have no ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import documents, per_worker
from tallyframe.llm.wordids import ChunkIds, batches_of

SPACE = "▁"
NONE = np.int64(1 << 40)
TABLE_BITS = 19


class PieceModel:
    """Vocabulary arrays of a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {t: i for i, t in enumerate(text) if not special[i]}
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece holds a space after another symbol: words can't be cut at spaces")
        self.byte_id = np.full(256, sp.unk_id(), np.int64)
        self.bytes_of = [b""] * n
        for i, t in enumerate(text):
            if sp.is_byte(i):
                self.byte_id[int(t[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(t[3:5], 16)])
            elif i in (sp.unk_id(),):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.bytes_of[i] = t.replace(SPACE, " ").encode()
        self.size = n
        order = sorted(self.ids.values(), key=lambda i: (-sp.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        pairs = {}
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = (rank[i], i)
        for t, i in self.ids.items():
            if len(t) == 2 and not (t[0] in self.ids and t[1] in self.ids):
                raise ValueError("a piece is made of a symbol outside the vocabulary")
        self._table(pairs)

    def _table(self, pairs: dict):
        """Pair keys in a hash table of rows of ``depth`` slots."""
        key = np.array(list(pairs), np.int64)
        value = np.array([pairs[k] for k in key.tolist()], np.int64).reshape(-1, 2)
        slot = self._slot(key)
        order = np.argsort(slot, kind="stable")
        key, value, slot = key[order], value[order], slot[order]
        n = np.arange(len(slot))
        depth = n - np.maximum.accumulate(np.where(np.r_[True, slot[1:] != slot[:-1]], n, 0))
        self.keys, self.ranks, self.into = [], [], []
        for d in range(int(depth.max()) + 1):
            at = depth == d
            for store, fill, v in ((self.keys, -1, key), (self.ranks, NONE, value[:, 0]), (self.into, 0, value[:, 1])):
                col = np.full(1 << TABLE_BITS, fill, np.int64)
                col[slot[at]] = v[at]
                store.append(col)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray):
        """(rank, merged symbol) of symbol pairs; NONE where they make no piece."""
        key = a * self.size + b
        key[(a >= self.size) | (b >= self.size)] = -2
        slot = self._slot(key)
        rank, into = np.full(len(key), NONE), np.zeros(len(key), np.int64)
        for keys, ranks, to in zip(self.keys, self.ranks, self.into, strict=True):
            hit = keys[slot] == key
            if hit.any():
                at = slot[hit]
                rank[hit], into[hit] = ranks[at], to[at]
        return rank, into

    def encode_words(self, words: list[str]):
        """(flat ids, ids per word)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        distinct, back = np.unique(points, return_inverse=True)
        known = np.array([self.ids.get(chr(c), -1) for c in distinct.tolist()], np.int64)
        sym = np.where(known[back] >= 0, known[back], self.size + points)   # past the vocabulary: a lone symbol
        word = np.repeat(np.arange(len(words)), size)
        rank, merged = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        rank[:-1], merged[:-1] = self.pair(sym[:-1], sym[1:])
        rank[:-1][word[1:] != word[:-1]] = NONE
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            going = best < NONE
            if not going.all():                       # finished words leave the arrays
                alive = np.repeat(going, length)
                done_sym.append(sym[~alive])
                done_word.append(word[~alive])
                sym, word, rank, merged = sym[alive], word[alive], rank[alive], merged[alive]
                length, best = length[going], best[going]
                if not len(sym):
                    break
            of = np.repeat(np.arange(len(length)), length)
            at = np.flatnonzero(rank == best[of])
            at = at[leftmost(at)]
            state = self._merge(sym, word, rank, merged, of, at)
            early = self._earlier(sym, merged, of, at, best, state)
            if early.any():                           # there only the first occurrence
                first = np.r_[True, of[at[1:]] != of[at[:-1]]]
                state = self._merge(sym, word, rank, merged, of, at[first | ~early[of[at]]])
            sym, word, rank, merged = state[:4]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return self._fallback(sym[order], word[order], len(words))

    def _merge(self, sym, word, rank, merged, of, at):
        """Replace the pairs that begin at ``at``, close the gaps and rank the pairs that changed."""
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym = sym.copy()
        sym[at] = merged[at]
        place = at - np.arange(len(at))
        sym, word, rank, merged, of = sym[keep], word[keep], rank[keep], merged[keep], of[keep]
        touched = np.concatenate([place, place[place > 0] - 1])
        new = np.full(len(touched), NONE)
        inner = touched + 1 < len(sym)
        inner[inner] = of[touched[inner]] == of[touched[inner] + 1]
        i = touched[inner]
        new[inner], merged[i] = self.pair(sym[i], sym[i + 1])
        rank[touched] = new
        return sym, word, rank, merged, of, touched, new

    def _earlier(self, sym, merged, of, at, best, state):
        """Words in which a pair made by the merges ranks before the pair that was merged."""
        early = np.zeros(len(best), bool)
        touched_of = state[4][state[5]]
        early[touched_of[state[6] < best[touched_of]]] = True
        i = at[at + 2 < len(sym)]
        i = i[of[i] == of[i + 2]]
        half, _ = self.pair(merged[i], sym[i + 2])    # the right symbol may be about to be merged itself
        early[of[i[half < best[of[i]]]]] = True
        return early

    def _fallback(self, sym, word, n):
        lone = sym >= self.size
        if lone.any():
            wide = np.ones(len(sym), np.int64)
            at = np.flatnonzero(lone)
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[at] - self.size).tolist()]
            wide[at] = [len(x) for x in raw]
            word = np.repeat(word, wide)
            is_byte = np.repeat(lone, wide)
            sym = np.repeat(sym, wide)
            sym[is_byte] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return sym.astype(np.uint32), np.bincount(word, minlength=n)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, without the space put in front, broken bytes as U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if raw[:1] == b" " and len(ids) and ids[0] in self._spaced:
            raw = raw[1:]
        return decode_bytes(raw)

    @property
    def _spaced(self):
        if not hasattr(self, "_spaced_ids"):
            self._spaced_ids = {i for t, i in self.ids.items() if t.startswith(SPACE)}
        return self._spaced_ids


def decode_bytes(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def leftmost(at: np.ndarray) -> np.ndarray:
    """Of runs of adjacent places every second one, from the left: pairs must not overlap."""
    n = np.arange(len(at))
    run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1][:len(at)], n, 0))
    return (n - run) % 2 == 0


def split_words(text: str) -> list[str]:
    """Runs of space symbols, each with the symbols after it; one space symbol is put in front."""
    if not text:
        return []
    s = SPACE + text.replace(" ", SPACE)
    parts = s.split(SPACE)
    if "" not in parts[1:]:
        return [SPACE + p for p in parts[1:]]
    out, lead = [], 0
    for p in parts[1:]:
        lead += 1
        if p:
            out.append(SPACE * lead + p)
            lead = 0
    if lead:
        out.append(SPACE * lead)
    return out


def model(path: str) -> PieceModel:
    return per_worker(("piece", path), lambda: PieceModel(path))


def encoder(path: str) -> ChunkIds:
    return per_worker(("piece ids", path), lambda: ChunkIds(split_words, model(path).encode_words))


def _digest_batches(path: str):
    def run(batches):
        m, enc = model(path), encoder(path)
        number = np.array([str(i) for i in range(m.size)], object)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            count, ids_sha, text_sha = [], [], []
            for i, j in batches_of(texts):
                flat, per = enc.texts(texts[i:j])
                at = 0
                for n in per.tolist():
                    ids = flat[at:at + n]
                    at += n
                    count.append(n)
                    ids_sha.append(hashlib.sha256(",".join(number[ids]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number of ids, hash of the ids and hash of the text decoded from them."""
    rows = documents(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_digest_batches(model_path),
                           "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

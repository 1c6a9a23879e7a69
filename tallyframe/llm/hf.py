"""Ids of the ``tokenizers`` library, chunk by chunk."""

from __future__ import annotations

import re

import numpy as np

from tallyframe.llm.store import per_worker
from tallyframe.llm.wordids import MAX_CHUNKS, ChunkIds

GROUP = 2000
# Letters and digits below U+0250; pre-tokenizers always break between these and other symbols.
WORD = "0-9A-Za-zª²³µ¹º¼-¾À-ÖØ-öø-ɏ"
# Beyond that alphabet, with contractions, or with white space that libraries class differently,
# only the breaks before plain white space are sure; other odd white space leaves none.
# So are letters whose lower case is no letter below U+0250, since lower-casing is done before cutting.
_LEAVING = "".join(c for c in map(chr, range(0x80, 0x250)) if re.fullmatch(f"[{WORD}]", c) and not re.fullmatch(f"[{WORD}]+", c.lower()))
HARD = re.compile("<[|]|['ɐ-\U0010ffff\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0" + _LEAVING + "]")
ODD_SPACE = re.compile(r"[^\S \n\t\r]")
SPACED = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
SPACED_PARTS = re.compile(f"[ \n\t\r]*(?:[{WORD}]+|[^ \n\t\r{WORD}]+)|[ \n\t\r]+")
PARTS = re.compile(f"[{WORD}]+|[^ \n\t\r{WORD}]+")


# Bytes of texts without hard places; any other byte makes the pattern decide.
_LEADS = {c.encode()[0] for c in _LEAVING}
SURE = (bytes(b for b in range(0x80) if not HARD.search(chr(b))) + bytes(range(0x80, 0xC0))
        + bytes(b for b in range(0xC3, 0xC9) if b not in _LEADS))


def is_hard(text: str) -> bool:
    if text.encode("utf-8", "surrogatepass").translate(None, SURE):
        return bool(HARD.search(text))
    return "<|" in text


def byte_level_chunks(text: str) -> list[str]:
    """Runs of word characters or of symbols, each with the white space in front of it."""
    if is_hard(text):
        return [text] if ODD_SPACE.search(text) else SPACED.findall(text)
    return SPACED_PARTS.findall(text)


def word_chunks(text: str) -> list[str]:
    """Runs of word characters or of symbols: the tokenizer drops white space and case."""
    if is_hard(text):
        return [text] if ODD_SPACE.search(text) else text.split()
    return PARTS.findall(text.lower())


def chunk_ids(path: str, spaced: bool, max_chunks: int = MAX_CHUNKS) -> ChunkIds:
    """The encoder of a tokenizer file; made once in each Python worker.

    ``spaced``: white space belongs to the token after it (byte-level), else it is dropped.
    """
    return per_worker(("ids", path, spaced, max_chunks), lambda: _make(path, spaced, max_chunks))


def _make(path: str, spaced: bool, max_chunks: int) -> ChunkIds:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    def joined(words: list[str]):
        """Simple chunks as one text; ids go to the chunk in which their offset lies."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + (not spaced)
        e = tok.encode("".join(words) if spaced else " " + " ".join(words), add_special_tokens=False)
        at = np.array([a for a, _ in e.offsets], np.int64)
        # each chunk has one space in front: chunk k takes places [ends[k-1], ends[k])
        owner = np.searchsorted(np.cumsum(size), at, "right")
        return np.array(e.ids, np.uint32), np.bincount(owner, minlength=len(words))

    def is_simple(chunks: list[str]):
        one_space = np.fromiter((c[0] == " " and len(c) > 1 and c[1] not in " \n\t\r" for c in chunks),
                                bool, len(chunks)) if spaced else np.ones(len(chunks), bool)
        if HARD.search(" ".join(chunks)):
            one_space &= np.fromiter((not HARD.search(c) and len(c) < 1000 for c in chunks), bool, len(chunks))
        return one_space

    def encode(chunks: list[str]):
        simple = is_simple(chunks)
        size = np.zeros(len(chunks), np.int64)
        order, flat = [], []
        easy = np.flatnonzero(simple)
        for i in range(0, len(easy), GROUP):
            g = easy[i:i + GROUP]
            ids, size[g] = joined([chunks[k] for k in g.tolist()])
            flat.append(ids)
        order = np.concatenate([easy, np.flatnonzero(~simple)])
        if not simple.all():
            rest = np.flatnonzero(~simple)
            out = [e.ids for e in tok.encode_batch_fast([chunks[k] for k in rest.tolist()], add_special_tokens=False)]
            size[rest] = [len(x) for x in out]
            flat += [np.array(x, np.uint32) for x in out]
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        first = np.zeros(len(chunks), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    return ChunkIds(byte_level_chunks if spaced else word_chunks, encode, max_chunks)

"""Words of texts as 64-bit hashes, for whole batches of texts at a time.

A word is a run of letters, digits or underscores, in lower case.  Its hash is a polynomial over its mixed code
points, so a batch is hashed by array operations and no word becomes a Python object.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are hashed at a time.
PIECE = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@cache
def _points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it belongs to words, and its value."""
    inside = np.zeros(0x110000, dtype=bool)
    for m in WORD.finditer("".join(map(chr, range(0x110000)))):
        inside[m.start() : m.end()] = True
    return inside, mixed((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * MIX)


@cache
def _powers(bits: int) -> np.ndarray:
    return np.cumprod(np.full(1 << bits, MIX), dtype=np.uint64)


def _hash_piece(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and where they start, in characters."""
    inside, value = _points()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = inside[code]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, sizes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    v = value[code[word]] * _powers(int(sizes.max()).bit_length())[place]
    return mixed(np.add.reduceat(v, first)), starts


def _pieces(text: str):
    """The text, cut at characters outside words."""
    while len(text) > PIECE:
        cut = PIECE
        while cut and WORD.match(text[cut - 1]):
            cut -= 1
        if not cut:  # a word longer than a piece
            m = re.search(r"\W", text[PIECE:])
            cut = PIECE + m.start() if m else len(text)
        yield text[:cut]
        text = text[cut:]
    yield text


def hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and where each text's words end (starting with a 0)."""
    found, counts, held, room = [], [], [], PIECE

    def flush():
        nonlocal held, room
        if held:
            h, starts = _hash_piece("\n".join(held))
            found.append(h)
            counts.append(np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in held])]))))
        held, room = [], PIECE

    for t in texts:
        t = (t or "").lower()
        if len(t) > room:
            flush()
        if len(t) > PIECE:
            parts = [_hash_piece(p)[0] for p in _pieces(t)]
            found += parts
            counts.append([sum(map(len, parts))])
        else:
            held.append(t)
            room -= len(t)
    flush()
    return np.concatenate(found or [np.zeros(0, dtype=np.uint64)]), np.concatenate([[0], *counts]).astype(np.int64).cumsum()


def hashes(text: str | None) -> np.ndarray:
    return hashes_of([text])[0]


def windows(words: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """A hash for each place of a window over words, of the words at the given positions in it."""
    n = len(words) - positions[-1]
    if n <= 0:
        return words[:0]
    out = np.zeros(n, dtype=np.uint64)
    for p in positions:
        out = out * MIX + words[p : p + n]
    return mixed(out)

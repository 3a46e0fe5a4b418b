"""Vectorised word scanning: words, their documents and 64-bit word hashes, from UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All separators are ASCII, so
scanning bytes gives the same words as scanning characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The separators of a word.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes scanned at once; chunks end at a separator.
CHUNK = 4 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_pow: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int, which: str, base: int) -> np.ndarray:
    have = _pow.get(which)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _pow[which] = have
    return have[:n]


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``codes[start:end]`` for every span: a polynomial over table values, finalised."""
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(len(codes), "up", _BASE), out=total[1:])
    down = _powers(len(codes) + 1, "down", _BASE_INV)
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of several texts: ``data[start:end]`` is a word, ``doc`` its text's place, ``hash`` its hash."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def scan(texts: list[bytes | None], lower: bool = True) -> Words:
    """All words of all texts in order; null is an empty text. ``lower`` maps A-Z to a-z first."""
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    found, at = [], 0
    while at < len(data):
        upto = min(at + CHUNK, len(data))
        while upto < len(data) and not _IS_SPACE[data[upto - 1]]:
            rest = np.flatnonzero(_IS_SPACE[data[upto : upto + CHUNK]])
            upto = upto + int(rest[0]) + 1 if len(rest) else min(upto + CHUNK, len(data))
        part = data[at:upto]
        space = _IS_SPACE[part]
        word = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        s, e = word[::2], word[1::2]
        found.append((s + at, e + at, span_hash(_TABLE[part], s, e)))
        at = upto
    if not found:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, z, np.zeros(0, np.uint64))
    start, end, h = (np.concatenate([f[k] for f in found]) for k in range(3))
    return Words(data, np.searchsorted(begins, start, "right") - 1, start, end, h)


class WordMemo:
    """Rows of numbers by word hash, kept per worker for recent words; bounded, and never a change of results."""

    def __init__(self, width: int, most: int = 300_000):
        self.width, self.most = width, most
        self.clear()

    def clear(self) -> None:
        self.known, self.rows = np.zeros(0, np.uint64), np.zeros((0, self.width), np.float32)

    def lookup(self, words: Words, compute) -> tuple[np.ndarray, np.ndarray]:
        """Per word its place in a table of rows, and the table. ``compute(list of bytes)`` makes new rows."""
        unique, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if not len(unique):
            return inverse, np.zeros((0, self.width), np.float32)
        at = np.searchsorted(self.known, unique)
        at[at == len(self.known)] = 0
        hit = self.known[at] == unique if len(self.known) else np.zeros(len(unique), bool)
        table = np.empty((len(unique), self.width), np.float32)
        table[hit] = self.rows[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            table[miss] = compute([words.text(i) for i in first[miss]])
            if len(self.known) + len(miss) > self.most:
                self.clear()
            known = np.concatenate([self.known, unique[miss][: self.most]])
            order = np.argsort(known, kind="stable")
            self.known, self.rows = known[order], np.concatenate([self.rows, table[miss][: self.most]])[order]
        return inverse, table

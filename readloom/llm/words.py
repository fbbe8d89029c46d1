"""Words of many texts at once, as 64-bit hashes with their places."""

from __future__ import annotations

import numpy as np

from readloom.llm.arrow import at_end

_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters, digits and all that is not ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

#: All but blanks.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[9:14] = NOT_BLANK[32] = False


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factor = np.full(size, np.uint64(base & 0xFFFFFFFFFFFFFFFF))
            factor[0] = 1
            _powers[k] = np.multiply.accumulate(factor)
    return _powers[0], _powers[1]


def _forget() -> None:
    _powers[:] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


at_end.append(_forget)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordText:
    """Words of many texts laid end to end; a word never spans two texts.

    start, end: bytes of each word; hash: a polynomial of its bytes;
    first: the number of the first word of each text, and of the end.
    """

    def __init__(self, data: bytes, sizes, is_word: np.ndarray = ALPHANUMERIC):
        raw = LOWER[np.frombuffer(data, dtype=np.uint8)]
        self.raw = raw
        n = len(raw)
        word = np.zeros(n + 2, dtype=bool)
        word[1:-1] = is_word[raw]
        ends_at = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int64)
        marks = np.flatnonzero(word[1:] != word[:-1])
        inner = ends_at[(ends_at > 0) & (ends_at < n)]
        glued = np.unique(inner[word[inner] & word[inner + 1]])
        if len(glued):
            marks = np.sort(np.concatenate([marks, glued, glued]), kind="stable")
        self.start, self.end = marks[0::2], marks[1::2]
        self.first = np.searchsorted(self.start, ends_at, side="left")
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        a = 0
        while a < len(self.start):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + _PIECE, side="right")))
            self.hash[a:b] = self._hashes(a, b)
            a = b

    def _hashes(self, a: int, b: int) -> np.ndarray:
        begin = self.start[a]
        part = self.raw[begin : self.end[b - 1]]
        power, inverse = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        start, end = self.start[a:b] - begin, self.end[a:b] - begin
        return (total[end] - total[start]) * inverse[start]

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def shingles(text: WordText, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, hash), ordered by both.

    A text of fewer than ``size`` words, but one at least, has one shingle of all.
    """
    n = np.diff(text.first)
    hashes = mix(text.hash)
    total = len(hashes)
    out = np.zeros(total, dtype=np.uint64)
    for k in range(min(size, total)):
        out[: total - k] += hashes[k:] * _FACTORS[k]
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(total) - np.repeat(text.first[:-1], n)
    keep = place + size <= np.repeat(n, n)
    doc, out = doc[keep], out[keep]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = []
        for d in short.tolist():
            own = hashes[text.first[d] : text.first[d + 1]]
            own = np.append(own * _FACTORS[: len(own)], np.uint64(len(own)) * _FACTORS[63:])
            whole.append(own.sum(dtype=np.uint64))
        doc, out = np.concatenate([doc, short]), np.concatenate([out, np.array(whole, dtype=np.uint64)])
    out = mix(out)
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return doc[new], out[new]


def shingle_set(text: str | None, size: int) -> set[bytes]:
    """The same set from the bytes themselves, for exact checks."""
    own = (text or "").encode().lower().split()
    if not own:
        return set()
    if len(own) < size:
        return {b" ".join(own)}
    return set(map(b" ".join, zip(*(own[k:] for k in range(size)))))

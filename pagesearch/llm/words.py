"""Words of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return, with A-Z lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SLICE = 1 << 20
_powers: dict[str, np.ndarray] = {}


@dataclass
class Words:
    """``data``: all bytes; word i is data[start[i]:end[i]] and belongs to the
    text d with first[d] <= i < first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(texts: list[str]) -> Words:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts).lower(), np.uint8)
    space = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    offset = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)))
    return Words(data, start, end, np.searchsorted(start, offset))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * _SLICE + 2), base, np.uint64)
        have[0] = 1
        have = _powers[name] = np.cumprod(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span (spans in order, not overlapping).

    A prefix sum of byte * base**position turns every span into two look-ups;
    slices of a megabyte keep the prefix sums small, however long the text is.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(start, base + _SLICE)))
        top = int(end[to - 1])
        p, q = _power("up", _BASE, top - base + 1), _power("down", _INVERSE, top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * p[: top - base], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.start, words.end)


def shingle_hashes(words: Words, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each position, and whether they lie in one text."""
    n = len(of)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = total * _BASE + of[k : n - width + 1 + k]
    doc = words.doc()
    return mix(total), doc[: n - width + 1] == doc[width - 1 :]

"""Words and word windows of many texts at once, as 64-bit hashes in numpy.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG_WORD = 256
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> _S32
    x *= _A
    x ^= x >> _S29
    x *= _B
    x ^= x >> _S32
    return x


class Words:
    """Spans, hashes and per-text bounds of the words of a chunk of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        self.data = _LOWER[data] if lower else data
        n = len(self.data)
        inside = ~_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        end[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)
        if hashes:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        s, length = self.start, self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", buffer=padded, strides=(1,))
        h = mix((eight[s] & _MASK[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _B))
        live, at = np.flatnonzero(length > 8), 8
        while len(live) and at < _LONG_WORD:
            rest = length[live] - at
            h[live] = mix(h[live] ^ (eight[s[live] + at] & _MASK[np.minimum(rest, 8)]), at)
            live, at = live[rest > 8], at + 8
        for i in live:
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(self.data[s[i] + at : self.end[i]].tobytes()))
        return h

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def double(h: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hashes of windows of 2 * length words from those of ``length`` words."""
    return mix(h[:-length] * _A + h[length:], seed) if len(h) > length else h[:0]


def window_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of ``length`` consecutive words, texts' bounds ignored."""
    n = len(words) - length + 1
    if n <= 0:
        return words[:0]
    h = words[:n].copy()
    for j in range(1, length):
        h *= _B
        h += words[j : j + n]
    return mix(h, seed + length)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have < width and len(out):
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out

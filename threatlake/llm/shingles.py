"""Sets of 64-bit word-shingle fingerprints, computed with numpy over whole texts.

Words are runs of bytes other than blank and U+0009-U+000D after lower-casing
A-Z.  Each word is fingerprinted by a polynomial over random byte codes, each
shingle by mixing its words' fingerprints.  Two different shingles share a
fingerprint with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_BLOCK = 1 << 20
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[65:91] = _CODE[97:123]
_BASE = int(_RANDOM.integers(1, 2**62)) * 4 + 1
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, made once per process and grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _steps(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = self._steps(_BASE, n), self._steps(pow(_BASE, -1, 2**64), n)
        return self.up, self.down


_POWERS = _Powers()


def _block_words(data: np.ndarray) -> np.ndarray:
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.upto(len(data) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_CODE[data] * up[: len(data)])])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """One fingerprint per word, in order; long texts go block by block, cut at white space."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= _BLOCK:
        return _block_words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_WHITE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(_WHITE[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        parts.append(_block_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingles; fewer words than ``width`` make one shingle, no words none."""
    words = word_hashes(text or b"")
    n = len(words)
    if not n:
        return words
    size = min(n, width)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        out += words[k : n - size + 1 + k] * _PLACE[k]
    return np.unique(mixed(out + np.uint64(size)))


def set_fingerprint(shingles: np.ndarray) -> int:
    """One signed 64-bit number per set of shingles."""
    spread = mixed(shingles ^ _PLACE[40])
    x = np.array([int(spread.sum(dtype=np.uint64)) ^ (len(shingles) * int(_PLACE[41]) % 2**64)], dtype=np.uint64)
    return int(mixed(x).view(np.int64)[0])

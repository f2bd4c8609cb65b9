"""Words of whole UTF-8 texts as numpy arrays: where they lie and a 64-bit hash of each."""

from __future__ import annotations

import numpy as np

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return. Fixed values.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20)
#: Two families of hashes that have nothing in common but the word.
_BYTES = _rng.integers(0, 1 << 64, 256, np.uint64), _rng.integers(0, 1 << 64, 256, np.uint64)
#: Powers of an odd number modulo 2**64 weigh the bytes of a word by their place.
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BLOCK = 1 << 16
_UPS = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(_BLOCK - 1, base, np.uint64)]) for base in _BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words, and the bytes after their last ones."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    return edge[0::2], edge[1::2]


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text, np.uint8)[starts[0] :]
    ends, starts = ends - starts[0], starts - starts[0]
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
    long = place >= _BLOCK
    value = _BYTES[family][b] * _UPS[family][place % _BLOCK]
    if long.any():
        value[long] = mix(value[long] + (place[long] // _BLOCK).astype(np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each run of size words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed))
    for k in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)

"""Words of texts as arrays: where they are in a buffer of bytes, and 64-bit hashes of them."""

from __future__ import annotations

import numpy as np

_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A-Z lower-cased; bytes of ASCII white space; bytes of words of ASCII letters and digits and of all other characters.
LOW_BYTES = np.arange(256, dtype=np.uint8)
LOW_BYTES[65:91] += 32
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[32, 9, 10, 11, 12, 13]] = True
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, base in ((up, _ODD), (down, _INVERSE)):
        out[0] = 1
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def hash_runs(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of values[first:last] for each pair; values are indices into _BYTE."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_BYTE[values] * up[:-1], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first])

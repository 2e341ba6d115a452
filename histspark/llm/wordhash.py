"""Word hashes and shingle sets of batches of texts, in numpy.

The hash of a word is a polynomial over per-byte random words modulo 2**64, taken from prefix sums of the whole batch,
then finalised; A-Z count as a-z. Words never cross texts.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTES = _EXACT.copy()
_BYTES[65:91] = _BYTES[97:123]
#: ASCII white space separates words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base or of its inverse modulo 2**64."""
    have = _powers[name]
    if len(have) < n:
        step = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        have = np.full(max(n, 2 * len(have)), step, np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have)
    return have[:n]


def word_hashes(flat: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and per text the offset of its first word; without ``fold`` A-Z differ from a-z."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = space[flat]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~gap
    start[1:] &= gap[:-1] | edge[1:-1]
    end = ~gap
    end[:-1] &= gap[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTES if fold else _EXACT)[flat] * _power("up", n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power("down", n)[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; with fewer words the whole sequence is one; without words none."""
    odd = mix64(np.arange(11, 11 + k, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        rolled += hashes[i : len(hashes) - k + 1 + i] * odd[i] if len(rolled) else 0
    rolled = mix64(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix64(np.array([(hashes[a:b] * odd[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

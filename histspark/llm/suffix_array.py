"""Two-stage suffix sorting of selected positions, and their adjacent common prefixes, in numpy.

A suffix that is smaller than its successor is sorted directly on its first ``depth`` bytes. Any other suffix is placed
by scanning the finished buckets of smaller first bytes in order: its successor's place decides its own. A bucket is
complete when its scan begins, so each bucket is scanned once, with one further pass per repeat of its own byte.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray, size: int) -> np.ndarray:
    """The 8 bytes at every position as one big-endian number; ``text`` is followed by zeros."""
    padded = np.concatenate([text, np.zeros(size + 16, np.uint8)])
    out = np.zeros(len(text) + size, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(out)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the last one is not."""
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(-1)))
    index = np.where(step != 0, np.arange(len(step)), len(step))
    nxt = np.minimum.accumulate(index[::-1])[::-1]  # the next place where neighbours differ
    return step[nxt] > 0


def order(text: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Wanted positions in suffix order (to ``depth`` bytes), and whether each shares ``depth`` bytes with the one before."""
    n = len(text)
    small = smaller_than_next(text)
    part = np.zeros(n, bool)
    part[wanted] = True
    edge = wanted[~small[wanted]] + 1  # successors are needed until a directly sorted one
    while len(edge := edge[(edge < n)]) and len(edge := edge[~part[edge]]):
        part[edge] = True
        edge = edge[~small[edge]] + 1
    word = words_at(text, depth)
    steps = [*range(8, depth - 7, 8), depth - 8] if depth > 8 else []
    direct = np.flatnonzero(part & small)
    direct = direct[np.argsort(word[direct], kind="stable")]
    first = word[direct]
    tied = np.zeros(len(direct), bool)
    tied[1:] = first[1:] == first[:-1]
    tied[:-1] |= tied[1:].copy() if len(tied) > 1 else tied[:-1]
    if tied.any():
        at = direct[tied]
        keys = [word[at + s] for s in reversed(steps)] + [word[at]]
        direct[tied] = at[np.lexsort(keys)]
    head = text[direct]
    cut = np.searchsorted(head, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    # the last suffix has no successor: it opens its bucket
    if n and part[n - 1] and not small[n - 1]:
        pending[text[n - 1]].append(np.array([n - 1]))
    done = []
    placed = part & ~small
    for c in range(256):
        waves = []
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        while len(wave):
            waves.append(wave)
            before = wave - 1
            before = before[before >= 0]
            wave = before[placed[before] & (text[before] == c)]
        bucket = np.concatenate([*waves, direct[cut[c] : cut[c + 1]]]) if waves or cut[c] < cut[c + 1] else None
        if bucket is None:
            continue
        done.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[placed[before] & (text[before] > c)]
        if len(before):
            target = text[before]
            by = np.argsort(target, kind="stable")
            before, target = before[by], target[by]
            starts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(before)], strict=True):
                pending[target[a]].append(before[a:b])
    ranked = np.concatenate(done) if done else np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    keep[wanted] = True
    ranked = ranked[keep[ranked]]
    same = np.zeros(len(ranked), bool)
    if len(ranked) > 1:
        a, b = ranked[:-1], ranked[1:]
        equal = word[a] == word[b]
        for s in steps:
            equal &= word[a + s] == word[b + s]
        same[1:] = equal
    return ranked, same

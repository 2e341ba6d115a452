"""Probabilistic suffix tree over bytes: model arrays, and scoring of texts.

A context of ``d`` bytes and the next byte are one integer key (oldest byte highest), so a shorter context is the key
with its high bytes masked away. The model holds, per depth, the retained contexts with the probability mass they leave
to their parent, and the retained (context, next byte) shares.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the longest context.
DEPTH = 6
#: A context or an entry is retained if it covers at least this share of all training bytes (at most 1/share of each
#: depth, whatever the corpus) and, for contexts, if its divergence test passes.
CONTEXT_SHARE, ENTRY_SHARE = 1e-6, 2.5e-7
#: Nats that a context must gain over its parent, per distinct next byte.
GAIN = 1.0
#: Counts added to each byte at the root.
ROOT_PRIOR = 0.5


def mask(size: int) -> int:
    return (1 << 8 * size) - 1


def keys_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every byte of the texts (each ends in a newline) and the offsets of the texts in them."""
    pad = b"\n" * depth
    flat = b"".join([*(pad + t for t in texts), bytes(8)])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    n = max(len(flat) - 8 - depth, 0)
    keys = np.ndarray((n,), ">u8", flat, 0, (1,)).astype(np.uint64)  # eight bytes from each place on, the oldest highest
    keys >>= np.uint64(8 * (7 - depth))
    keep = np.ones(n, bool)
    starts = at[1:-1] + depth * np.arange(1, len(texts))
    for i in range(1, depth + 1):  # keys that end in the padding of the next text
        keep[starts - i] = False
    return keys[keep].view(np.int64), at


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys in which equal ones follow each other, and where its runs of equal keys begin.

    One sort of hashes that carry their places. Keys whose hashes clash may split a run in two, never join two keys.
    """
    low = np.uint64((1 << max(len(keys).bit_length(), 1)) - 1)
    h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h &= ~low
    h |= np.arange(len(keys), dtype=np.uint64)
    h.sort()
    h &= low
    order = h.view(np.int64)
    along = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], along[1:] != along[:-1]])) if len(keys) else np.zeros(0, np.int64)


def backwards(context: np.ndarray) -> np.ndarray:
    """Contexts of up to seven bytes with the newest byte highest: a context's extensions are the numbers that follow it."""
    return (context.astype(np.uint64).byteswap() >> np.uint64(8)).view(np.int64)


class SuffixTree:
    """Sorted arrays per depth: contexts -> mass left to the parent; keys -> own share of the next byte.

    What the look-ups use is made of them once: read backwards, a context is a range of pasts, and the ends of all ranges
    (``bounds``) cut the pasts into pieces of one longest context (``longest``) each. A retained entry has its whole
    probability (``p``), its parents' part included, under its context's number and byte (``pairs``). So a key takes one
    search for its context, and one for its entry at each context from there up to the first that retains it.
    """

    def __init__(self, contexts: list[tuple[np.ndarray, np.ndarray]], entries: list[tuple[np.ndarray, np.ndarray]]):
        self.contexts, self.entries = contexts, entries
        lows, orders = [], []
        for context, _ in contexts:
            low = backwards(context)
            orders.append(np.argsort(low, kind="stable"))
            lows.append(low[orders[-1]])
        spans = [1 << 8 * (7 - d) for d in range(len(contexts))]
        ends = np.concatenate([low + span for low, span in zip(lows, spans, strict=True)])
        self.bounds = np.unique(np.concatenate([*lows, ends[ends < spans[0]]]))
        self.left = np.concatenate([mass[order] for (_, mass), order in zip(contexts, orders, strict=True)])
        self.longest = np.zeros(len(self.bounds), np.int64)
        self.parent = np.zeros(len(self.left), np.int64)
        self.pairs, self.p = np.zeros(0, np.int64), np.zeros(0)
        base = 0  # number of the depth's first context
        for low, span, (key, share) in zip(lows, spans, entries, strict=True):
            if not len(low):
                continue
            self.parent[base : base + len(low)] = self.longest[np.searchsorted(self.bounds, low)]
            at = np.searchsorted(low, self.bounds, "right") - 1
            inside = (at >= 0) & (self.bounds < low[at] + span)
            self.longest[inside] = base + at[inside]
            own = backwards(key >> 8)
            at = np.minimum(np.searchsorted(low, own), len(low) - 1)
            known = low[at] == own
            owner, byte = base + at[known], key[known] & 255
            p = share[known] + (self.left[owner] * self.spread(self.parent[owner], byte) if base else 0.0)
            pairs = owner << 8 | byte
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.p = np.concatenate([self.pairs, pairs[order]]), np.concatenate([self.p, p[order]])
            base += len(low)

    def __getstate__(self) -> dict:
        """Tasks are sent what the look-ups use."""
        return {k: v for k, v in self.__dict__.items() if k not in ("contexts", "entries")}

    def spread(self, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Probability of a byte in a context given by its number: by the entry retained there, or by its parents."""
        p, weight, todo = np.zeros(len(context)), np.ones(len(context)), np.arange(len(context))
        while len(todo):
            pair = context << 8 | byte
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = self.pairs[at] == pair
            p[todo[hit]] = weight[hit] * self.p[at[hit]]
            up = np.flatnonzero(~hit & (context > 0))
            weight, todo, byte = weight[up] * self.left[context[up]], todo[up], byte[up]
            context = self.parent[context[up]]
        return p

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key, from its longest retained context down to the root."""
        order, first = grouped(keys)
        distinct = keys[order[first]]
        past = backwards(distinct >> 8)
        sort = np.argsort(past)  # neighbours are searched in the same places
        context = self.longest[np.searchsorted(self.bounds, past[sort], "right") - 1]
        shares = np.empty(len(distinct))
        shares[sort] = np.log10(np.maximum(self.spread(context, distinct[sort] & 255), 1e-300))
        out = np.empty(len(keys))
        out[order] = np.repeat(shares, np.diff(first, append=len(keys)))
        return out

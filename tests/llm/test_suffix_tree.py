"""The suffix tree's look-ups against a plain walk, and how many searches they take."""

import pickle
from collections import Counter

import numpy as np
import pytest

from histspark.llm import suffix_tree
from histspark.llm.suffix_tree import SuffixTree, grouped, keys_of, mask


def plain(tree, key):
    """Probability of the key's last byte, byte by byte from the longest context down."""
    p, left = 0.0, 1.0
    for d in range(len(tree.contexts) - 1, -1, -1):
        context, mass = (dict(zip(x.tolist(), y.tolist(), strict=True)) for x, y in (tree.contexts[d], tree.entries[d]))
        if (own := (key >> 8) & mask(d)) in context:
            p += left * mass.get(key & mask(d + 1), 0.0)
            left *= context[own]
    return np.log10(max(p, 1e-300))


def made(depth, seed, alphabet):
    """A tree whose contexts are drawn at random: suffixes may be missing, entries may lack their context."""
    rng = np.random.default_rng(seed)
    contexts, entries = [(np.zeros(1, np.int64), np.zeros(1))], [(np.arange(256), rng.random(256))]
    for d in range(1, depth + 1):
        context = np.unique((rng.choice(alphabet, (30, d)) * 256 ** np.arange(d)[::-1]).sum(axis=1))
        key = np.unique(np.concatenate([(rng.choice(context, 60) << 8) | rng.choice(alphabet, 60), rng.integers(0, 256 ** (d + 1), 5)]))
        contexts.append((context, rng.random(len(context))))
        entries.append((key, rng.random(len(key))))
    return SuffixTree(contexts, entries)


@pytest.mark.parametrize(("depth", "alphabet"), [(0, [0]), (1, [0, 255]), (3, [0, 10, 97, 255]), (6, [0, 255]), (6, [32, 97, 98, 200])])
def test_probabilities_are_those_of_a_plain_walk(depth, alphabet):
    tree = made(depth, depth, np.array(alphabet))
    rng = np.random.default_rng(1)
    keys = np.concatenate([(rng.choice(alphabet, (400, depth + 1)) * 256 ** np.arange(depth + 1)[::-1]).sum(axis=1), rng.integers(0, 256 ** (depth + 1), 50), tree.entries[depth][0], np.zeros(3, np.int64)])
    want = [plain(tree, int(k)) for k in keys]
    for t in (tree, pickle.loads(pickle.dumps(tree))):
        assert np.allclose(t.log10(keys), want, rtol=1e-12, atol=1e-12)
        assert t.log10(keys[:0]).tolist() == []


def test_depth_without_contexts():
    tree = made(3, 5, np.array([97, 98]))
    nothing = (np.zeros(0, np.int64), np.zeros(0))
    tree = SuffixTree([*tree.contexts[:2], nothing, tree.contexts[3]], [*tree.entries[:2], nothing, tree.entries[3]])
    keys = np.array([0x61616161, 0x62616261, 0x61626263, 0x0A0A0A0A])
    assert np.allclose(tree.log10(keys), [plain(tree, int(k)) for k in keys], rtol=1e-12)


def test_keys_of():
    for texts in ([], [b"\n"], [b"a \n", b"\n", b"\n", b"\xff\x00bcd efghij \n"]):
        for depth in (0, 1, 3, 6):
            keys, at = keys_of(texts, depth)
            padded = [(b"\n" * depth + t, i) for t in texts for i in range(len(t))]
            assert keys.tolist() == [int.from_bytes(t[i : i + depth + 1], "big") for t, i in padded]
            assert at.tolist() == [0, *np.cumsum([len(t) for t in texts]).tolist()]


def test_grouped():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 56, 5000)[rng.integers(0, 5000, 40_000)]
    order, first = grouped(keys)
    assert sorted(order.tolist()) == list(range(len(keys)))
    runs = np.split(keys[order], first[1:])
    assert all((r == r[0]).all() for r in runs) and len(runs) == len(np.unique(keys))


def test_few_searches_a_key(monkeypatch):
    """A key took two searches at every depth (14); now one for its context and hardly more than one for its entry."""
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("etaoinshr"), rng.integers(1, 8))) for _ in range(60)]
    keys = keys_of([(" ".join(rng.choice(vocab, 4000)) + " \n").encode()])[0]
    contexts, entries = [], []
    for d in range(suffix_tree.DEPTH + 1):
        n = Counter((keys & mask(d + 1)).tolist())
        total, kinds = Counter(), Counter()
        for k, c in n.items():
            total[k >> 8] += c
            kinds[k >> 8] += 1
        kept = sorted(c for c in total if total[c] > 3 or not d)
        contexts.append((np.array(kept), np.array([kinds[c] / (total[c] + kinds[c]) for c in kept])))
        own = sorted(k for k in n if k >> 8 in set(kept))
        entries.append((np.array(own), np.array([n[k] / (total[k >> 8] + kinds[k >> 8]) for k in own])))
    tree, searched, real = SuffixTree(contexts, entries), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: searched.append(np.size(v)) or real(a, v, *x, **y))
    tree.log10(keys)
    assert len(np.unique(keys)) <= sum(searched) <= 3 * len(np.unique(keys))

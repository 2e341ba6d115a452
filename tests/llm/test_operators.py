"""Each operator on small documents with every edge case, against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from histspark.llm import decontamination, exact_dedup, jaccard_join, licenses, lm_scoring, packing, quality, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, uid long, kind int, h long, key string, seg string, _sha string, _k1 long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, cur = [], ""
    for ch in (text or "").translate(LOWER):
        if ch in SPACE:
            out, cur = (out + [cur] if cur else out), ""
        else:
            cur += ch
    return out + [cur] if cur else out


VOCAB = [f"{a}{b}" for a in ("lo", "ri", "ma", "te", "su") for b in ("na", "pe", "qui", "do", "vel", "ta")]


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "k", "s", "x", 9) for i, t in rows], SCHEMA)


def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = sentence(30)
    texts = [None, "", " \n\t ", "a", "One two", "a" * 700, "ab " * 900, "x\x00y  z K", sentence(4000)]
    base = [sentence(rng.randint(3, 90)) for _ in range(40)]
    texts += base
    for t in base[:25]:
        w = t.split(" ")
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(" ".join(v))
        texts.append(sentence(5) + " " + passage + " " + sentence(4))
        texts.append(t.upper())
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [rows[5], rows[5], (None, texts[12]), (None, texts[12]), (None, None), (None, "only here"), (9999, texts[20])]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ROWS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, ROWS).limit(0)


def key(i):
    return -1 if i is None else i


@pytest.mark.parametrize("bucket", [exact_dedup.BUCKET_BYTES, 300])
def test_exact_dedup(docs, bucket):
    got = exact_dedup.grace_dedup(docs, bucket).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        top = max(ids, key=key)
        for n, i in enumerate(sorted(ids, key=key, reverse=True)):
            want[(i, top, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    kept = exact_dedup.deduplicated(docs, bucket)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter((max(ids, key=key), t) for t, ids in groups.items())


def test_buckets_split_until_they_fit(docs):
    reps = docs.select(F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes")).where("bytes > 0").distinct()
    sizes = exact_dedup.plan_buckets(reps, 2000).groupBy("bucket").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 2000 or r["n"] == 1 for r in sizes)


def test_sharding(docs):
    rows = sharding.sharded(docs, 40).collect()
    assert len(rows) == len(ROWS)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_even_weighted_and_confined(spark):
    ids = spark.range(60_000).withColumnRenamed("id", "doc_id")
    place = lambda tree: {r["doc_id"]: r["s"] for r in ids.select("doc_id", sharding.descend(tree, F.col("doc_id")).alias("s")).collect()}
    tree = sharding.planned_tree(40)
    before = place(tree)
    counts = Counter(before.values())
    assert len(counts) == 40 and max(counts.values()) < 1.15 * 1500 and min(counts.values()) > 0.85 * 1500
    after = place(sharding.grown_tree(tree, 40))
    moved = [i for i in before if before[i] != after[i]]
    assert all(after[i] == 40 for i in moved) and 0.8 < len(moved) / (60_000 / 41) < 1.2
    heavier = place(sharding.planned_tree(40, weights={3: 2.0}))
    assert all(heavier[i] == 3 for i in before if before[i] != heavier[i])
    for n in (1, 3, 4, 7, 8, 39, 41, 63):  # one more shard takes rows only into itself, whatever the count
        assert sharding.grown_tree(sharding.planned_tree(n), n) == sharding.planned_tree(n + 1)
        less, more = place(sharding.planned_tree(n)), place(sharding.planned_tree(n + 1))
        assert all(more[i] == n for i in less if less[i] != more[i])
        assert 0.8 < sum(less[i] != more[i] for i in less) / (60_000 / (n + 1)) < 1.2


def test_sharding_against_an_independent_descent(spark):
    """Draws from the hash library, compared level by level."""
    import xxhash

    def draw(key, name, weight):
        seed = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
        return math.log(((xxhash.xxh64_intdigest(name.encode(), seed) & ((1 << 52) - 1)) + 0.5) / (1 << 52)) / weight

    weights = {5: 3.0, 12: 0.5}
    ids = [*range(-50, 400), 1 << 40]
    got = {r["doc_id"]: r["s"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", sharding.descend(sharding.planned_tree(21, weights=weights), F.col("doc_id")).alias("s")).collect()}
    for i in ids:
        at = {s: draw(i, f"r{s // 8}/k{s // 4 % 2}/s{s}", weights.get(s, 1.0)) for s in range(21)}
        region = max({s // 8 for s in at}, key=lambda r: max(d for s, d in at.items() if s // 8 == r))
        rack = max({s // 4 for s in at if s // 8 == region}, key=lambda k: max(d for s, d in at.items() if s // 4 == k))
        assert got[i] == max((s for s in at if s // 4 == rack), key=at.get)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in ROWS)
    pieces = packing.pack(docs, path, window=64, shard_tokens=1500).collect()
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p["sequence_id"]].append(p)
        assert p["length"] > 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == np.concatenate([[0], np.cumsum([p["length"] for p in ps])[:-1]]).tolist() and sum(p["length"] for p in ps) <= 64
    short = [s for s, ps in by_seq.items() if sum(p["length"] for p in ps) < 64]
    assert len(short) <= 4  # one a task
    cuts = Counter()
    for i, ids in want:
        for p in [p for p in pieces if p["doc_id"] == i and p["doc_tokens"] == len(ids)]:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            if zlib.crc32(part.tobytes()) == p["ids_crc32"]:
                cuts[(i, ids)] += p["length"]
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    assert all(cuts[k] >= len(k[1]) for k in want)
    assert packing.pack(empty, path).isEmpty()


def test_packing_puts_neighbours_together():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * t, 1000 * t + 60, (12, 40)) for t in range(5)]
    docs = [(t * 100 + i, topics[t][i].astype("<u2")) for i in range(12) for t in range(5)]
    w = packing.Windows(0, 480)
    packing.pack_shard(docs, w)
    mixed = sum(len({r[0] // 100 for r in w.rows if r[5] == s}) > 1 for s in {r[5] for r in w.rows})
    assert mixed <= 1


def test_packing_order_keeps_near_copies_in_one_shard(spark):
    """Frequent ids decide nothing: near copies stay adjacent in a heavy group of texts of the same common words."""
    from histspark.llm.tokens import cache_for

    rng = random.Random(4)
    made = ["".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(2200)]
    common, rare = made[:200], made[200:]
    rows = []
    for i in range(150):
        w = rng.sample(common, 200) + [rng.choice(rare) for _ in range(15)]
        v = list(w)
        v[205] = rng.choice(rare)
        rows += [(i, " ".join(w)), (1000 + i, " ".join(v))]
    rng.shuffle(rows)
    path = packing.tokenizer_path()
    cache = cache_for(path)
    tokens = packing.tokenize(make(spark, rows), path)
    place = {r["doc_id"]: n for n, r in enumerate(packing.ordered(tokens, cache.dtype, len(cache.packed), 1).collect())}
    assert len(place) == 300
    assert sum(abs(place[i] - place[1000 + i]) < 10 for i in range(150)) >= 100
    pieces = packing.pack(make(spark, rows), path, window=2048, shard_tokens=12000).collect()
    seq = defaultdict(set)
    for p in pieces:
        seq[p["doc_id"]].add(p["sequence_id"])
    assert sum(bool(seq[i] & seq[1000 + i]) for i in range(150)) >= 90


def test_chunks_encode_as_whole_texts():
    from histspark.llm.tokens import ChunkCache

    cache = ChunkCache(packing.tokenizer_path(), limit=50)
    for t in ("<|endoftext|> A<|ENDOFTEXT|>b", "it's I'LL don't 3.14 ...,. (x)", "İx ŉa é é ﬁ", "\x1cab \xa0c　d ǅ Σας ΑΣ", "naïve,über;ñ!!", "", "  \n", "%%% a%%% b***"):
        assert np.frombuffer(cache.ids(t), cache.dtype).tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_jaccard_components(docs, empty):
    check_components(docs, ROWS, 4, 85)
    check_components(docs, ROWS, 5, 80)
    assert jaccard_join.components(empty).isEmpty()


def check_components(docs, rows, k, num):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None and (find(a) not in least or i < least[find(a)]):
            least[find(a)] = i
    want = Counter((i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs, k, num).collect())
    assert got == want
    kept = jaccard_join.representatives(docs, k, num)
    assert kept.columns == docs.columns
    groups = {find(a) for a in range(len(rows)) if sets[a]}
    assert len({r["doc_id"] for r in kept.where("doc_id is not null").collect()}) >= len(groups) - 1
    stay = {r["doc_id"] for r in kept.collect()}
    assert all(i in stay for i in least.values())


def test_asked_pairs_hold_every_link(spark):
    """Whatever the costs: sets at and around the bound are asked for whenever they link, also where segments are empty."""
    rng = np.random.default_rng(5)
    bands = jaccard_join.Bands()
    sets = []
    for _ in range(250):
        n = int(rng.integers(1, 120))
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        if rng.random() < 0.3:
            pool = pool * np.uint64(24)  # few segments hold all tokens
        x = np.unique(pool[:n])
        sets.append(x)
        for _ in range(3):
            cut = int(rng.integers(0, 1 + len(x) // 6))
            y = np.unique(np.concatenate([x[cut:], pool[n : n + int(rng.integers(0, 1 + n // 8))]]))
            if len(y):
                sets.append(y)
    held = []
    for c, t in enumerate(sets):
        values, sigs = jaccard_join.mix64(t), set()
        for k in jaccard_join.own_bands(len(t), 85, 100, bands):
            sigs |= set(jaccard_join.Segments(t, values, k, bands).sigs.tolist())
        held += [(s, c, c, int(rng.integers(0, 50)), True) for s in sigs]
    open_ = spark.createDataFrame(held, "sig long, cls long, label long, others long, minor boolean")
    tokens = spark.createDataFrame([(c, t.view(np.int64).tolist()) for c, t in enumerate(sets)], "cls long, tokens array<long>")
    asked = jaccard_join._asked(jaccard_join._offers(open_, tokens, 85, 100), 85, 100)
    got = {(r["a"], r["b"]) for r in asked.collect()}
    want = set()
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if abs(a - b) < 4 and 100 * (i := len(np.intersect1d(x, y))) >= 85 * (len(x) + len(y) - i):
            want.add((a, b))
            assert jaccard_join.sketch_distance(jaccard_join.sketch(x), jaccard_join.sketch(y)) <= len(x) + len(y) - 2 * i
    assert len(want) > 150 and not want - got
    assert len(got) < 2 * len(want)


def test_jaccard_links(docs, empty):
    """All links between classes of equal sets, and every row's class."""
    found, member = jaccard_join.links(docs)
    cls = {}
    sets = defaultdict(set)
    texts = {i: t for i, t in ROWS}
    for r in member.collect():
        if r["doc_id"] is not None and r["doc_id"] != 9999:
            w = words(texts[r["doc_id"]])
            sets[r["cls"]] = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) >= 4 else frozenset({tuple(w)} if w else ())
            assert (r["cls"] is None) == (not w)
            assert cls.setdefault(sets[r["cls"]], r["cls"]) == r["cls"]
    got = {(r["a"], r["b"]) for r in found.collect() if r["a"] in sets and r["b"] in sets}
    own = sorted(c for c in sets if c is not None)
    assert got == {(a, b) for a, b in itertools.combinations(own, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert jaccard_join.links(empty)[0].isEmpty()


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    owner = {}
    for i, t in ROWS:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                owner[w] = min(owner.get(w, i), i)
    want = Counter()
    for i, t in ROWS:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - 49):
                if owner[b[p : p + 50]] < i:
                    cover[p : p + 50] = True
        spans = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(b) else 0
        want[(i, len(b), int(cover.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest())] += 1
    got = Counter(tuple(r) for r in suffix_dedup.repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
    assert suffix_dedup.repeats(empty).isEmpty()


def test_suffix_order():
    from histspark.llm.suffix_array import order

    rng = np.random.default_rng(1)
    for trial in range(200):
        n = int(rng.integers(1, 150))
        t = rng.integers(0, 1 + trial % 4, n).astype(np.uint8)
        wanted = np.flatnonzero(rng.random(n) < 0.6)
        depth = int(rng.choice([8, 13, 20]))
        if len(wanted):
            r, same = order(t, wanted, depth)
            full = t.tobytes() + bytes(depth)
            keys = [full[i : i + depth] for i in r]
            assert sorted(r.tolist()) == wanted.tolist() and keys == sorted(keys)
            assert same.tolist() == [False, *[a == b for a, b in zip(keys, keys[1:], strict=False)]]


def test_anchors_of_long_texts_follow_content():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 105, 2_300_000).astype(np.uint8)
    found = []
    for shift in (0, 777):
        flat = np.concatenate([np.full(shift, 33, np.uint8), text])
        t, first, count, h = suffix_dedup.anchors(flat, np.array([0, len(flat)]))
        assert count.sum() == len(flat) - 49
        per = np.repeat(h, count)
        found.append(per[shift:])
    # a window's anchor hash depends on its bytes alone
    assert (found[0] == found[1]).all()


def test_lm_scores(docs, empty):
    out = lm_scoring.scored(docs).collect()
    rows = [(i, [*words(t), None]) for i, t in ROWS]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    c = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for i, ws in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    mine = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in mine) > sum(r["base_score"] for r in mine)
    assert lm_scoring.scored(empty).isEmpty()


def test_lm_score_is_the_models_probability(docs, monkeypatch):
    """Byte by byte from the longest context down, and word shares beside, in plain Python."""
    trees = []
    monkeypatch.setattr(lm_scoring, "fit", lambda grams, real=lm_scoring.fit: trees.append(real(grams)) or trees[-1])
    out = lm_scoring.scored(docs).collect()
    contexts = [dict(zip(c.tolist(), left.tolist(), strict=True)) for c, left in trees[0].contexts]
    entries = [dict(zip(k.tolist(), share.tolist(), strict=True)) for k, share in trees[0].entries]

    def p(past, byte, d):
        ctx = int.from_bytes(past[len(past) - d :], "big")
        if ctx not in contexts[d]:
            return p(past, byte, d - 1)
        return entries[d].get(ctx << 8 | byte, 0.0) + (contexts[d][ctx] * p(past, byte, d - 1) if d else 0.0)

    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    c = Counter(w for i, t in ROWS if not held(i) for w in [*words(t), None])
    assert abs(sum(n / sum(c.values()) for n in c.values()) - 1) < 1e-9
    want, depth = Counter(), len(contexts) - 1
    for i, t in ROWS:
        past, score = b"\n" * depth, 0.0
        for w in [*words(t), None]:
            spelt = 0.0
            for b in b"\n" if w is None else w.encode() + b" ":
                spelt += math.log10(p(past, b, depth))
                past = past[1:] + bytes([b])
            score += math.log10(0.5 * c[w] / sum(c.values()) + 0.5 * 10.0 ** max(spelt, -250.0))
        want[i, round(score, 3)] += 1
    assert Counter((r["doc_id"], round(r["score"], 3)) for r in out) == want


def test_suffix_tree_sums_to_one(docs):
    table = lm_scoring.counts(docs.select("text")).where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    tree = lm_scoring.fit(table)
    assert sum(len(c) for c, _ in tree.contexts) > 50
    for context in (0, 0x6162, 0x2061626364, 0x0A0A0A0A0A):
        keys = (np.int64(context) << 8) | np.arange(256)
        assert abs((10.0 ** tree.log10(keys)).sum() - 1) < 1e-9


def labelled(spark, kind):
    rng = random.Random(kind)
    rows, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.4
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 40))]
        if bad:
            w = [x + "%%" for x in w] if kind == "quality" else [*w, rng.choice(["idiot", "scumly", "scumish"])]
        elif kind == "toxic" and rng.random() < 0.3:
            w.append("women")
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    labels += [(None, 1, 1), (3, None, None), (77777, 1, 0)]
    return make(spark, [*rows, (None, None), (900, ""), (901, "x " * 5000), rows[0]]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, truth):
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and truth.get(r["doc_id"]) is not None]
    return sum(a == b for a, b in held) / len(held)


def test_quality(spark, empty):
    d, lab = labelled(spark, "quality")
    out = quality.scored(d, lab).collect()
    assert len(out) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out if r["doc_id"] is not None)
    truth = {r["doc_id"]: r["quality"] for r in lab.collect()}
    assert accuracy(out, truth) > 0.95
    kept = quality.accepted(d, lab)
    assert kept.columns == d.columns and sum(truth.get(r["doc_id"]) == 0 for r in kept.collect()) < 10
    assert quality.scored(empty, lab).isEmpty()
    assert {r["score"] for r in quality.scored(d, lab.limit(0)).collect()} == {0.5}


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(y) > 0).all() and y.tolist() == [0, 0.5, 1.0] and (np.diff(x) > 0).all()


def test_toxicity(spark, empty):
    d, lab = labelled(spark, "toxic")
    out = toxicity.scored(d, lab).collect()
    assert len(out) == d.count() and all(0 <= r["score"] <= 1 for r in out)
    assert accuracy(out, {r["doc_id"]: r["toxic"] for r in lab.collect()}) > 0.95
    assert toxicity.scored(empty, lab).isEmpty()
    assert {r["score"] for r in toxicity.scored(d, lab.limit(0)).collect()} == {0.5}


def test_counterfactual_penalty_frees_identity_terms(spark, monkeypatch):
    """A group is named in toxic texts only: with the penalty, neutral mentions of it are not taken for toxic."""
    # feature 0 is an identity term that occurs in toxic texts only, 1 its swap, 2 the insult
    rows = [([0, 2], [([1], [0])], 1)] * 20 + [([3], [], 0)] * 20
    free, _ = toxicity.fit(rows, 4)
    rng = random.Random(4)
    sentence = lambda: [rng.choice(VOCAB) for _ in range(20)]
    texts = []
    for i in range(300):
        w = sentence()
        texts.append((i, " ".join([*w, "immigrants", *(["scum"] if rng.random() < 0.9 else [])] if i % 2 else w)))
    neutral = [(1000 + i, " ".join([*sentence(), "immigrants"])) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    d = make(spark, texts + neutral)
    wrong = lambda: sum(r["predicted"] for r in toxicity.scored(d, labels).where("doc_id >= 1000").collect())
    with_penalty = wrong()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    assert with_penalty <= 4 and wrong() == 40
    biased, _ = toxicity.fit(rows, 4)
    assert abs(free[0] - free[1]) < 0.3 * abs(biased[0] - biased[1]) and free[2] > 0.5


def test_counterfactual_sentences():
    terms = toxicity.Terms()
    assert terms.counterfactuals(Counter({"women": 2, "x": 1})) == [Counter({"men": 2, "x": 1})]
    a, b = terms.counterfactuals(Counter({"x": 1}))
    (t,), (u,) = a.keys() - {"x"}, b.keys() - {"x"}
    assert terms.swap[t] == u and toxicity.Terms(()).counterfactuals(Counter("x")) == []
    assert toxicity.text_features(Counter({"abcde": 1, "abcdx": 2})) == {"abcde", "abcdx", "abcdx2", "abcd~", "abcd~2", "abcd~3"}


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    w = [f"w{rng.randrange(400)}" for _ in range(5000)]
    items = [(1, " ".join(w[:40])), (2, "Alpha Beta, gamma; delta epsilon zeta eta"), (3, " ".join(w[:40])), (4, None), (5, ""), (6, "two words"), (7, " ".join(w[100:130]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sub = list(w[:40])
    for p in (3, 11, 19, 30):
        sub[p] = "other"
    texts = [(1, "x " * 30 + " ".join(w[:40]) + " y"), (2, " ".join(sub)), (3, " ".join(w[2000:2100])), (4, "so ALPHA beta gamma delta epsilon ZETA eta so"), (5, " ".join(w[:12]) + " " + " ".join(w[3000:3100])), (6, None), (7, ""), (8, "start " + " ".join(w[105:128])), (1, "clean twin of one"), (9, " ".join(w[:40])), (9, " ".join(w[:40])), (None, " ".join(w[100:130]))]
    d = make(spark, texts)
    sent = decontamination.overlaps(d, bench).collect()
    assert sorted(sent, key=str) == sorted(decontamination.overlaps(d, bench, sent_bytes=0).collect(), key=str)
    found = {(r["doc_id"], r["item_id"]) for r in sent}
    assert found == {(1, 1), (1, 3), (2, 1), (2, 3), (4, 2), (8, 7), (9, 1), (9, 3), (None, 7)}
    kept = decontamination.clean(d, bench)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id < 6 or text is null").collect()) == sorted([(3, texts[2][1]), (5, texts[4][1]), (6, None), (1, "clean twin of one")], key=str)
    assert decontamination.overlaps(empty, bench).isEmpty() and decontamination.overlaps(d, bench.limit(0)).isEmpty()


def test_decontamination_seeds_cover_every_allowed_pattern():
    """Some mask, laid somewhere on the stretch, keeps only places that agree; masks of longer stretches ignore places."""
    for share in (decontamination.SHARE, 0.6, 0.3, 1.0):
        for w in range(1, 21 if share == decontamination.SHARE else 11):
            laid = [frozenset(o + s for o in m) for m in decontamination.masks(w, share) for s in range(w - m[-1])]
            for k in range(w):
                if (w - k) / w >= share:
                    for changed in map(frozenset, itertools.combinations(range(w), k)):
                        assert any(changed.isdisjoint(m) for m in laid), (share, w, changed)
    for w in range(10, 21):
        assert all(m[-1] >= len(m) and len(m) >= 4 for m in decontamination.masks(w, decontamination.SHARE))


@pytest.mark.parametrize("sent_bytes", [decontamination.SENT_BYTES, 0])
def test_decontamination_of_short_and_changed_items(spark, sent_bytes):
    """Items of 1 to 17 words, as they are and with every allowed pattern of one or two changed words, or of more."""
    rng = random.Random(8)
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 17)]
    texts, want = [], set()
    for n, text in items:
        for k in range(3 + (n > 14)):
            patterns = list(itertools.combinations(range(n), k))
            for changed in rng.sample(patterns, min(70, len(patterns))):
                w = [f"x{len(texts)}" if j in changed else v for j, v in enumerate(text.split())]
                if (n - k) / n >= decontamination.SHARE:
                    want.add((len(texts), n))
                texts.append((len(texts), " ".join(["before", *w, "after"])))
    got = decontamination.overlaps(make(spark, texts), spark.createDataFrame(items, "item_id long, text string"), sent_bytes=sent_bytes).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("sent_bytes", [decontamination.SENT_BYTES, 0])
def test_decontamination_of_long_texts_of_very_many_hits(spark, sent_bytes):
    """Nearly every word of 20,000 starts a hit; the hits are not held with all words of their text (16 GB)."""
    item = [f"i{j}" for j in range(40)]
    texts = [(1, " ".join(["before", *item * 500])), (2, " ".join(item[25:] + ["x"] + item * 2)), (3, " ".join(["y", *item[:30]])), (4, " ".join(item[24:]))]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = decontamination.overlaps(make(spark, texts).coalesce(1), bench, sent_bytes=sent_bytes)
    assert sorted((r["doc_id"], r["first_word"], r["n_words"], r["agree"]) for r in got.collect()) == [(1, 1, 40, 1.0), (2, 16, 40, 1.0), (3, 1, 40, 1.0), (4, 0, 40, 0.8)]


def test_licenses(spark, docs, empty):
    texts = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "apache  LICENSE and MIT-license, cc_by CC BY cc by"), (3, None), (4, ""), (5, "GNU general public licenses gnu General Public License"),
        (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files"), (7, "é apacheé license ßmit license"), (8, "mit license " * 400), (1, "no"), (None, "mit license"), (8, "mit license " * 400), (9, "mit Kicense mİt license"),
    ]
    phrases = {tuple(p.split()): lab for p, lab in licenses.PHRASES}
    out = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(make(spark, texts)).collect()}
    for i, t in texts:
        ws, cur = [], ""
        for ch in (t or "").translate(LOWER) + " ":
            if ch.isascii() and not (ch.isdigit() or "a" <= ch <= "z"):
                ws, cur = (ws + [cur] if cur else ws), ""
            else:
                cur += ch
        at = sorted((p, lab) for ph, lab in phrases.items() for p in range(len(ws)) if tuple(ws[p : p + len(ph)]) == ph)
        r = out[i, len(ws)]
        assert r["n_base"] == len(at) and r["first_word"] == (at[0][0] if at else None) and r["last_word"] == (at[-1][0] if at else None), (i, t, r, at)
        assert r["base_labels"] == ",".join(sorted({lab for _, lab in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    for text, label in licenses.TEXTS:
        w = licenses.template_words(text).split()
        changed = [x for j, x in enumerate(w) if j % 40 != 7 or len(w) < 80]  # words dropped: the rest moves to other diagonals
        near = licenses.scan(make(spark, [(1, "Notice " + text), (2, "intro " + " ".join(changed)), (3, " ".join(w[: len(w) // 2]))])).collect()
        got = {r["doc_id"]: set(r["labels"].split(",")) for r in near}
        assert label in got[1] and label in got[2] and min(r["score"] for r in near if r["doc_id"] < 3) >= 0.8
    assert next(r["labels"] for (i, _), r in out.items() if i == 6) == "mit" and licenses.scan(empty).isEmpty()
    assert licenses.scan(docs).count() == len(ROWS)

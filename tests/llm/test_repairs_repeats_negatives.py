"""Conversation repair, repeated passages and hard negatives on small tables with every edge case, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from histspark.llm import conversation_repair as repair
from histspark.llm import hard_negatives as mining
from histspark.llm import substring_dedup as dedup
from histspark.llm import suffix_dedup
from histspark.session import shared_dir

from .test_operators import ROWS, make

SMALL = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


# conversations


def brute_edits(rows):
    """Least (cost, audit) and the repaired turns, by suffixes: what is cheapest and least from each state on."""
    kinds = [("s" if r[0][:1] == "s" else "u" if r[0][:1] == "u" else "a" if r[0][:1] == "a" else "x", r[2]) for r in rows]

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        found = []
        nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserts < 3:
            c, a, t = best(i, nxt, inserts + 1)
            found.append((c + 3, "I" + a, ((nxt, ""),) + t))
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            kind, fault = kinds[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if kind == nxt or (kind == "s" and state == ""):
                    c, a, t = best(i + 1, kind, 0)
                    found.append((c + more, "K" + a, ((i, None),) + t))
                c, a, t = best(i + 1, nxt, 0)
                found.append((c + more + 3, "R" + a, ((i, nxt),) + t))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, turns = best(0, "", 0)
    full = {"u": "user", "a": "assistant"}
    text = [f"{full[a]}:" if isinstance(a, str) else f"{full[b] if b else rows[a][0]}:{rows[a][1]}" for a, b in turns]
    return cost, audit, "\n".join(text)


def brute_digest(table):
    """op11's rows from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        rows = convs[conv]
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        rows += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, illegal = set(), [], 0
        for i, (_, role, text) in enumerate(rows):
            solid = [c for c in text if c not in WHITE]
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
            illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        n = Counter(m[2] for m in marked)
        cost, audit, text = brute_edits(marked)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


TALK = "turn long, text string, role string, conv_id long, pos long, piece int, steps string, code int, side int"


def talk(spark, rows):
    return spark.createDataFrame([(t, x, r, c, 1, 2, "s", 3, 4) for c, t, r, x in rows], TALK)


def conversations(seed=5):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", None, "USER", "su", "abc"]
    texts = ["Hi.", "No!", "why?", "open", "", None, " \t", "\xa0.", "é", "a. \n", "so.b", "Yes."]
    rows = [(c, None if rng.random() < 0.05 else t * rng.choice((1, 1, 2)), rng.choice(roles), rng.choice(texts)) for c in range(150) for t in range(rng.randint(0, 9))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(9)] + [(901, None, "user", "Hi."), (901, None, "user", "Hi.")]
    rows += [(900, t, ("user", "assistant")[t % 2 if rng.random() < 0.9 else 0], rng.choice(texts[:4]) + str(t // 2) + ".") for t in range(600)]
    rows += [(902, 1, "user", "x" * 300_000), (902, 2, "assistant", "y " * 100_000 + ".")]
    rng.shuffle(rows)
    return rows


def digest_rows(df):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("piece", [repair.PIECE, 600])
def test_conversation_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)  # with small pieces the long conversation is many of them
    rows = conversations()
    table = talk(spark, rows).repartition(3)
    got = digest_rows(repair.digests(repair.damaged(table), table))
    want = brute_digest(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_conversation_of_many_pieces_is_ranged(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 600)
    _, codes = repair.placed(talk(spark, conversations()))
    pieces = codes.where("conv_id = 900").select(F.shiftright("pos", 33).alias("p")).distinct().count()
    assert pieces > 10


def test_every_crossing_is_the_least():
    rng = random.Random(1)
    kinds = {0: "x", 1: "system", 2: "user", 3: "assistant"}
    for _ in range(400):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(0, 12)))
        cost, audit, _ = brute_edits([(kinds[c >> 2], str(i), repair.FAULTS[c & 3]) for i, c in enumerate(codes)])
        cuts = sorted(rng.randint(0, len(codes)) for _ in range(3))
        runs = [r for a, e in zip([0, *cuts], [*cuts, len(codes)], strict=True) if (r := codes[a:e])]
        done, state = [], 0
        for (at, rest), run in zip(repair.crossings([repair.summary(r) for r in runs]), runs, strict=True):
            assert at == state
            for (n, action, role), c in zip(repair.edits(run, at, rest), run, strict=True):
                done.append("I" * n + action)
                for _ in range(n):
                    state = repair.ASSISTANT if state == repair.USER else repair.USER
                state = state if action == "D" else role + 1 if role else c >> 2
        assert "".join(done) + repair.ending(state)[1] == audit
        assert (min(c + e for c, e in zip(repair.forward(codes, repair.unit(0))[0], repair.FINAL, strict=True))) == cost


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes?"), (1, 1, "user", "Yes?"), (1, 5, "assistant", "no end"), (2, 0, "user", " ")]
    got = [(r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in repair.repaired(talk(spark, rows)).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hi."), (1, 2, "K", "user", "Yes?"), (1, 3, "K", "assistant", "no end")]
    none = talk(spark, rows).limit(0)
    assert repair.repaired(none).isEmpty() and repair.digests(repair.damaged(none), none).isEmpty()


# repeated passages


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute_repeats(rows):
    least = {}
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[p : p + 50])
            least[key] = min(i, least.get(key, i))
    out = Counter()
    for i, t in rows:
        w = split(t)
        gone = {q for p in range(len(w) - 49) if i is not None and least[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def passages():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, common = sentence(80), sentence(50)
    texts = [sentence(rng.randint(1, 20)) + " " + shared + "\n" + sentence(3) for _ in range(12)]
    texts += [sentence(4) + "\t" + common.replace(" ", rng.choice([" ", "  ", "\n", "\x0b"])) + " " + sentence(5) for _ in range(40)]
    texts += [texts[0].upper(), common, shared, shared + " " + shared, sentence(49), sentence(50), "w " * 300, "w " * 120, "\xa0".join(["x"] * 60), sentence(3000), "", None]
    texts += [texts[0]] * 30 + [" ".join(texts[3].split(" "))] + [sentence(2500) + " " + shared]
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [False, True])
def test_substring_dedup(spark, monkeypatch, small):
    if small:  # many chunks and blocks, texts hashed in several pieces
        for name, size in (("CHUNK", 3000), ("BLOCK", 2000), ("PIECE", 700)):
            monkeypatch.setattr(dedup, name, size)
    rows = passages() + ROWS
    rows += [rows[3], (None, rows[3][1]), (None, rows[3][1]), (None, "w " * 70), (-5, rows[60][1]), (rows[2][0], rows[5][1])]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup.repeats(make(spark, rows).repartition(5)).collect())
    want = brute_repeats(rows)
    assert got == want and sum(n > 0 for _, _, n, _ in want) > 60
    assert dedup.repeats(make(spark, rows).limit(0)).isEmpty()


def test_sketch_loses_no_repeat():
    rng = np.random.default_rng(2)
    cells = np.unique(rng.integers(0, 1 << 32, 200_000, dtype=np.uint64)).astype("<u4")
    twice = cells[::50]
    every = np.concatenate([cells, twice])
    hit = dedup.estimated_repeated(every, np.zeros(len(every), bool))
    assert hit[np.isin(every, twice)].all() and hit[~np.isin(every, twice)].mean() < 0.002
    assert dedup.estimated_repeated(cells[:9], np.arange(9) == 4).tolist() == [i == 4 for i in range(9)]


# hard negatives


def brute_negatives(rows):
    """op13's rows from (vec_id, label, vector), labels as they are."""
    dim = max((len(v) for _, _, v in rows if v is not None), default=0)
    good = {}
    for i, label, v in sorted((r for r in rows if None not in r and None not in r[2] and np.isfinite(r[2]).all() and (np.abs(np.array(r[2] + [0.0])) < 2.0**19).all()), key=lambda r: (r[0], r[1], [np.floor(256 * x) for x in r[2]])):
        good.setdefault(i, (label, [int(np.floor(256 * np.float64(x))) for x in v] + [0] * (dim - len(v))))
    out = []
    for a, (label, v) in good.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, (m, w) in good.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            found = [(s, n) for s, n, m in scored if m != label and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(a, p, k + 1, n, -ps, -s) for k, (s, n) in enumerate(found)]
    return sorted(out)


def negatives(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


VEC = "vec_id long, label int, embedding array<float>, id long, v int, ask int, cell int, side int"


@pytest.mark.parametrize("cells", [(2048, 200_000), (3, 100)])
def test_hard_negatives(spark, monkeypatch, cells):
    monkeypatch.setattr(mining, "ANCHORS", cells[0])
    monkeypatch.setattr(mining, "ROWS", cells[1])
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((4, 20))
    rows = [(i, int(i % 4), [float(np.float32(x)) for x in (centres[i % 4 if i % 3 else 0] + 0.3 * rng.standard_normal(20)) / 4]) for i in range(1200)]
    same = rows[100][2]
    rows += [(i, i % 2, same) for i in range(1300, 1500)]  # many ties
    rows += [(1500, 1, None), (1600, None, same), (1700, 1, [0.5, None]), (1800, 1, [float("nan")] * 20), (1801, 1, [float("inf")] * 20), (None, 1, same), (1900, 1, []), (2000, 2, [0.25] * 7), (2100, 9, same), (2101, 3, [1e6] * 20), (2200, 2, [-300000.0] * 20), (100, 0, same), (rows[7][0], 3, same)]
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "vec_id long, label int, embedding array<float>, id long, v int, ask int, cell int, side int")
    vectors = mining.vectors_of(table)
    got = negatives(mining.mine(vectors, vectors.where("id % 100 = 0")))
    assert got == brute_negatives(rows) and len(got) > 100
    assert mining.mine(vectors.limit(0), vectors.limit(0)).isEmpty()


def test_intervals_hold_every_score_and_narrow():
    rng = np.random.default_rng(7)
    for dim in (1, 20, 64, 70):
        v = np.floor(256 * rng.standard_normal((500, dim)) / 8).astype(np.int64)
        v[3] = 0
        codes = mining.Codes(v)
        for a in range(0, 40):
            anchor, exact = mining.Anchor(v[a]), v @ v[a]
            widths = []
            for stages in range(1, mining.STAGES + 1):
                low, high = mining.intervals(anchor, codes, stages)
                assert (low <= exact).all() and (exact <= high).all()
                widths.append(float((high - low).mean()))
            top = np.sort(exact)[-5]
            assert set(np.flatnonzero(exact >= top)) <= set(mining.within(anchor, codes, np.arange(500), top, np.inf))
            if dim == 64 and a != 3:
                assert widths[-1] < 0.2 * widths[0] and len(mining.within(anchor, codes, np.arange(500), top, np.inf)) < 60


@pytest.mark.parametrize("module", [dedup, mining])
def test_sql(spark, module):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.execute(module.ORACLE)
    names = [d[0] for d in want.description]
    got = module.query(spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


# repeated passages by slices


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup_by_slices_keeps_no_table_that_nothing_reads(spark, monkeypatch, hot):
    """Slices give what one slice gives; of the segments only slices to come are there, and at the end what the result reads."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before, left = set(shared.iterdir()), []

    def names():
        return sorted({p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before})

    def watched(df, name, *args, f=suffix_dedup.stored):
        out = f(df, name, *args)
        if name == "covered":
            left.append(len([p for p in set(shared.iterdir()) - before if p.name.startswith("segments") for _ in p.glob("part=*")]))
            assert "shared-anchors" not in names() and names().count("window-runs") == 1
        return out

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = Counter(tuple(r) for r in suffix_dedup.repeats(make(spark, ROWS)).collect())
    before = set(shared.iterdir())
    monkeypatch.setattr(suffix_dedup, "stored", watched)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 20_000, raising=False)
    got = Counter(tuple(r) for r in suffix_dedup.repeats(make(spark, ROWS)).collect())
    assert got == want and sum(n for *_, n, _, _ in got if n) > 0
    assert names() == ["contents", "cut", "rows"]
    assert len(left) > 2 and left == sorted(left, reverse=True) and left[0] > left[-1] == 1


def test_suffix_dedup_cuts_ranges_in_any_nesting():
    """Ranges that touch, nest or overlap, some not of a smaller document; neighbours in a batch do not touch."""
    texts, ids = [b"abcdefghij" * 10, b"", b"k" * 30, b"lm" * 20], [7, 8, 5, 3]
    ranges = [[(0, 50, 1), (10, 20, 2), (50, 60, 9), (60, 61, 0), (61, 100, 6)], [], [(0, 30, 4)], [(0, 10, 2), (5, 12, 3), (12, 20, 1)]]
    rows = [[{"s": s, "e": e, "least": v} for s, e, v in own] for own in ranges]
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("least", pa.int64())]))
    batch = pa.record_batch({"doc_id": pa.array(ids), "c1": pa.array(ids), "c2": pa.array(ids), "text": pa.array(texts), "ranges": pa.array(rows, kind)})
    (out,) = suffix_dedup._cut(iter([batch]))
    for text, doc, own, removed, spans, kept in zip(texts, ids, ranges, *(out.column(c).to_pylist() for c in ("removed", "spans", "kept")), strict=True):
        gone = {p for s, e, v in own if v < doc for p in range(s, e)}
        assert (removed, spans) == (len(gone), len({p for p in gone if p - 1 not in gone}))
        assert kept == hashlib.sha256(bytes(c for p, c in enumerate(text) if p not in gone)).hexdigest()

"""As-of reads that prune, change lists that compose, numbers and depth in both forms of the write path."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from histspark.functions import jsonvalue as J
from histspark.functions import jsonx
from histspark.operators import asof, compose, ingest, lifecycle
from histspark.schemas import KEY

from .test_diff import _value

T0 = datetime(2024, 1, 1)


def commands(spark, rows):
    """(entity, kind, state) in order of arrival."""
    data = [("t", "app.x", e, kind, None, None, "a", "s", T0 + timedelta(seconds=i), T0 + timedelta(seconds=i), i, str(i), None, None, state, None) for i, (e, kind, state) in enumerate(rows)]
    return spark.createDataFrame(data, "tenant string, collection string, entity_id string, kind string, op string, expected_version long, author string, source string, ts_source timestamp, ts_received timestamp, seq long, event_id string, request_id string, meta string, state string, changes array<struct<path:string,op:string,old:string,new:string>>")


def history(rng, entity, n):
    out = []
    for _ in range(n):
        dead = rng.random() < 0.12
        out.append((entity, "delete" if dead else "state", None if dead else json.dumps({"r": _value(rng, 3), "n": rng.randint(0, 2)})))
    return out


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    rows = [r for e in range(4) for r in history(rng, str(e), 23)] + history(rng, "hot", 150)
    rng.shuffle(rows)
    return ingest.ingest_states(commands(spark, rows)).where("code is null").drop("state", "base").cache()


def lists(rng, n):
    """A walk over documents as change lists, with the document behind each."""
    doc, out = {}, []
    for _ in range(n):
        new = _value(rng, 3) if rng.random() < 0.1 else {"a": _value(rng, 2), "l": [_value(rng, 1) for _ in range(rng.randrange(4))], **({"b": rng.random() < 0.5} if rng.random() < 0.7 else {})}
        out.append(J.changes_between(doc, new))
        doc = J.loads(J.dumps(new))
    return out, doc


def test_merged_lists_do_the_same():
    rng = random.Random(3)
    for _ in range(400):
        steps, last = lists(rng, rng.randint(1, 9))
        assert J.same(J.apply({}, compose.merged(*steps)), last)
        cut = rng.randint(0, len(steps))
        start = {}
        for s in steps[:cut]:
            start = J.apply(start, s)
        a, b = sorted(rng.randint(cut, len(steps)) for _ in range(2))
        left = compose.merged(compose.merged(*steps[cut:a], *steps[a:b]), *steps[b:])
        right = compose.merged(*steps[cut:a], compose.merged(*steps[a:b], *steps[b:]))
        assert J.same(J.apply(start, left), last) and J.same(J.apply(start, right), last)


def test_merged_lists_are_short():
    change = lambda path, new: {"path": path, "op": "change", "old": "0", "new": new}
    many = [[change("a.b", str(i)), change("items.3.q", str(i)), change("items[k=A].q", str(i))] for i in range(500)]
    got = compose.merged(*many)
    assert {c["path"]: (c["old"], c["new"]) for c in got} == {p: ("0", "499") for p in ("a.b", "items.3.q", "items[k=A].q")} and len(got) == 3
    gone = compose.merged([{"path": "x", "op": "add", "old": None, "new": "1"}], [{"path": "x", "op": "remove", "old": "1", "new": None}])
    assert gone == []
    with pytest.raises(J.ApplyError):
        compose.merged([{"path": "x", "op": "remove", "old": "1", "new": None}], [change("x.y", "1")])


def states(df):
    return {(r["entity_id"], r["version"]): (r["state"], r["deleted"], r["ts"]) for r in df.collect()}


@pytest.mark.parametrize("run", [2, 5, 1000])
def test_parallel_history_is_the_serial_one(events, run):
    want = states(asof.state_history(events))
    assert states(compose.parallel_history(events, run)) == want
    assert states(compose.run_snapshots(events, run)) == {k: v for k, v in want.items() if k[1] % run == 0}


def test_no_run_holds_more_than_its_share(events):
    effects = compose.run_effects(events, 10).where("entity_id = 'hot'")
    assert effects.count() >= 10 and effects.select("version").distinct().count() == effects.count()


def test_state_at_targets_snapshots_and_times(events):
    whole = states(asof.state_history(events))
    snaps = asof.build_snapshots(asof.state_history(events), 4).select(*KEY, "version", "ts", "deleted", "state").cache()
    keys = events.select(*KEY).distinct()
    by_version = keys.withColumn("version", F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 4, 5, 8, 23, 100, 10_000)])))
    for r in asof.state_at(by_version, events, snaps).collect():
        assert (r["state"], r["deleted"], r["ts"]) == whole[r["entity_id"], r["version"]]
        assert r["events_applied"] == r["version"] % 4 and (r["snapshot_version"] or 0) == r["version"] // 4 * 4
    # a log cut behind a snapshot still shows it, with its time
    cut = asof.state_at(by_version.where("version = 8"), events.where("version > 8"), snaps)
    assert {(r["entity_id"], r["ts"]) for r in cut.collect()} == {(e, whole[e, 8][2]) for e in ("0", "1", "2", "3", "hot") if (e, 8) in whole}
    times = keys.withColumn("at", F.lit(T0 + timedelta(seconds=120)))
    latest = {}
    for (e, v), s in whole.items():
        if s[2] <= T0 + timedelta(seconds=120):
            latest[e] = max(v, latest.get(e, 0))
    assert {r["entity_id"]: r["version"] for r in asof.state_at(times, events, snaps).collect()} == latest
    assert asof.state_at(times.limit(0), events, snaps).isEmpty()
    whole_probe = asof.state_at(keys, events).collect()
    assert {r["entity_id"]: r["version"] for r in whole_probe} == {e: max(v for x, v in whole if x == e) for e, _ in whole}


@pytest.mark.parametrize("sent", [True, False])
def test_few_probes_filter_the_log_where_it_is_read(spark, events, tmp_path, monkeypatch, sent):
    events.write.parquet(str(tmp_path / "log"))
    log = spark.read.schema(events.schema).parquet(str(tmp_path / "log"))
    if not sent:
        monkeypatch.setattr(asof, "SENT_BYTES", 0)
    probes = spark.createDataFrame([("t", "app.x", "2", 7), ("t", "app.x", "hot", 60)], "tenant string, collection string, entity_id string, version long")
    got = asof.state_at(probes, log)
    whole = states(asof.state_history(events))
    assert {(r["entity_id"], r["version"]): (r["state"], r["deleted"], r["ts"]) for r in got.collect()} == {k: whole[k] for k in (("2", 7), ("hot", 60))}
    plan = got._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = lambda line: re.match(r"[\s:+|-]*", line).end()
    for i, line in enumerate(plan):
        if "FileScan parquet" in line:
            above, at = [], depth(line)
            for upper in reversed(plan[:i]):
                if depth(upper) < at:
                    at = depth(upper)
                    above.append(upper)
            joins = [x for x in above if "Join" in x]
            assert joins and ("BroadcastHashJoin" in joins[0]) >= sent and "Window" not in "".join(above[: above.index(joins[0])])


NUMBERS = ["1e-7", "0.0000001", "1e22", "10000000000000000000000", "123456.789e3", "123456789", "0", "-0", "-0.0", "-0e5", "1e2", "100", "100.0", "9007199254740993", "9007199254740993.0", "1e21", "0.10", "1.5e300", "12345678.5", "0.00001", "1e-5", "0.000001", "6.55", "1E+3", "0.1e1"]


def test_equal_numbers_are_equal_text(spark):
    rng = random.Random(5)
    numbers = NUMBERS + [repr(rng.uniform(-10, 10) * 10 ** rng.randint(-12, 22)) for _ in range(300)] + [f"{rng.randint(1, 10 ** rng.randint(1, 15))}e{rng.randint(-25, 25)}" for _ in range(300)]
    texts = [f'{{"b":{n},"a":["x {n} \\" -0 1e5\\\\ 2.50",{n}]}}' for n in numbers] + [f'{{"v":{n}}}' for n in numbers]
    texts += ["[" * n + "]" * n for n in (998, 999, 1000, 1500)] + ['{"t":"' + 'a\\n\\"' * 50_000 + '","n":1e2}', '{"a":1}x', "", "1e999", '{"Infinity":"Infinity"}']
    got = {r["i"]: r["c"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", jsonx.canonical_json("t").alias("c")).collect()}
    for i, text in enumerate(texts):
        try:
            want = J.dumps(J.loads(text))
        except ValueError:
            want = None
        assert got[i] == want, text[:80]
    value = lambda n: J.dumps(J.loads(n))
    for group in (("1e-7", "0.0000001"), ("1e22", "10000000000000000000000"), ("123456.789e3", "123456789"), ("0", "-0", "-0.0", "-0e5"), ("1e2", "100", "100.0"), ("0.00001", "1e-5"), ("9007199254740993", "9007199254740993.0")):
        assert len({value(n) for n in group}) == 1
    assert (value("1e-7"), value("1e-6"), value("1e20"), value("1e21"), value("0.10")) == ("1e-7", "0.000001", "100000000000000000000", "1e+21", "0.1")


def test_window_and_fold_agree_on_numbers_and_depth(spark):
    rng = random.Random(9)
    deep = lambda n: '{"a":' * n + "1" + "}" * n
    rows = [("n", "state", f'{{"v":{rng.choice(NUMBERS)}}}') for _ in range(200)]
    rows += [("d", "state", t) for t in (deep(900), deep(999), deep(1000), deep(998), deep(5000), deep(2))]
    cmds = commands(spark, rows)
    names = ["entity_id", "seq", "version", "op", "code"]
    pick = lambda df: sorted(tuple(r) for r in df.select(*names, F.when(F.col("code").isNull(), F.col("changes").cast("string")).alias("changes")).fillna("-").fillna(0).collect())
    window, fold = pick(ingest.ingest_states(cmds)), pick(ingest.ingest(cmds))
    assert window == fold and sum(r[4] == "invalid_payload" for r in window) == 2
    versions = [r for r in window if r[0] == "n"]
    texts = [J.dumps(J.loads(s)) for e, _, s in rows if e == "n"]
    assert len(versions) == sum(a != b for a, b in zip([None, *texts], texts, strict=False))


def test_retention_without_a_value_keeps_everything(spark, events):
    for kind, value in (("days", None), ("versions", None), ("versions", 0), ("days", -1), (None, None)):
        cfg = spark.createDataFrame([("app.x", kind, value)], "name string, retention_type string, retention_value int")
        kept, dropped = lifecycle.apply_retention(events, cfg, T0 + timedelta(days=400))
        assert kept.count() == events.count() and dropped.isEmpty()
    cfg = spark.createDataFrame([("app.x", "versions", 3)], "name string, retention_type string, retention_value int")
    kept, dropped = lifecycle.apply_retention(events, cfg, T0)
    snaps = lifecycle.cut_snapshots(events, dropped)
    whole = states(asof.state_history(events))
    assert {(r["entity_id"], r["version"]): (r["state"], r["deleted"], r["ts"]) for r in snaps.collect()} == {(e, m - 3): whole[e, m - 3] for e, m in {e: max(v for x, v in whole if x == e) for e, _ in whole}.items()}
    latest = asof.state_at(events.select(*KEY).distinct(), kept, snaps)
    assert {(r["entity_id"], r["version"]): (r["state"], r["deleted"], r["ts"]) for r in latest.collect()} == {(e, m): whole[e, m] for e, m in {e: max(v for x, v in whole if x == e) for e, _ in whole}.items()}

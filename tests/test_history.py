from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from histspark.functions import jsonvalue as J
from histspark.operators import asof, chain, delivery, flows, history, ingest, lifecycle, plugins, rules
from histspark.schemas import COMMANDS, EVENTS, KEY
from histspark.streaming import stream

T0 = datetime(2026, 1, 1)


def command(spark, rows):
    """rows: (entity, kind, state or changes, extra dict)"""
    out = []
    for i, (entity, kind, payload, *more) in enumerate(rows):
        r = dict.fromkeys([c.split()[0] for c in COMMANDS.split(", ")])
        r |= {"tenant": "t", "collection": "crm.deals", "entity_id": entity, "kind": kind, "ts_received": T0 + timedelta(seconds=i), "ts_source": T0, "seq": i, "author": "me", "source": "crm"}
        r |= {"state": payload} if kind == "state" else {"changes": payload} if kind == "diff" else {}
        out.append(r | (more[0] if more else {}))
    return spark.createDataFrame(out, COMMANDS)


def test_lifecycle_fold_and_window_agree(spark):
    cmds = command(spark, [
        ("d", "state", '{"title":"x","amount":100}'), ("d", "state", '{"amount":100.0,"title":"x"}'), ("d", "state", '{"amount":250,"title":"x"}'), ("d", "delete", None), ("d", "delete", None),
        ("d", "state", "{}"), ("d", "state", '{"amount":500}'), ("e", "delete", None), ("f", "state", "{}"),
    ])
    fold = {(r["entity_id"], r["version"]): r for r in ingest.ingest(cmds).collect()}
    window = {(r["entity_id"], r["version"]): r for r in ingest.ingest_states(cmds).collect()}
    assert fold.keys() == window.keys() == {("d", 1), ("d", 2), ("d", 3), ("d", 4), ("d", 5), ("e", 1)}
    for k in fold:
        assert fold[k]["op"] == window[k]["op"] and fold[k]["changes"] == window[k]["changes"], k
    assert [fold["d", v]["op"] for v in range(1, 6)] == ["create", "update", "delete", "delete", "create"]
    assert fold["d", 3]["state"] == '{"amount":250,"title":"x"}' and fold["d", 4]["state"] == "{}"


def test_diff_commands_and_rejects(spark):
    change = lambda p, o, v: [{"path": p, "op": o, "old": None, "new": v}]
    cmds = command(spark, [
        ("a", "state", '{"n":1}'), ("a", "diff", change("n", "change", "2")), ("a", "diff", change("zz.q", "change", "2")), ("a", "diff", change("m", "add", "3"), {"expected_version": 7}),
        ("a", "diff", change("m", "add", "3"), {"expected_version": 2}), ("b", "diff", [], {"op": "create", "state": '{"z":1,"y":2}'}),
    ])
    out = ingest.ingest(cmds).orderBy("seq").collect()
    assert [(r["version"], r["code"]) for r in out] == [(1, None), (2, None), (None, "invalid_diff"), (None, "version_conflict"), (3, None), (1, None)]
    assert out[4]["state"] == '{"m":3,"n":2}'
    assert [c["path"] for c in out[5]["changes"]] == ["y", "z"]
    # a stored current row continues the entity
    current = spark.createDataFrame([("t", "crm.deals", "a", 9, T0, False, '{"n":1}')], "tenant string, collection string, entity_id string, version long, ts timestamp, deleted boolean, state string")
    more = ingest.ingest(command(spark, [("a", "state", '{"n":1}'), ("a", "state", '{"n":5}')]), current).collect()
    assert [(r["version"], r["op"]) for r in more] == [(10, "update")]
    assert [(r["version"], r["op"]) for r in ingest.ingest_states(command(spark, [("a", "state", '{"n":1}'), ("a", "state", '{"n":5}')]), current).collect()] == [(10, "update")]


def walk(spark, n=40):
    import random

    rng = random.Random(7)
    rows = []
    for e in range(6):
        for _ in range(n):
            if rng.random() < 0.15:
                rows.append((str(e), "delete", None))
            else:
                rows.append((str(e), "state", J.dumps({k: rng.choice([1, 2, [1, 2], {"x": rng.randint(0, 3)}]) for k in ("amount", "title", "qty") if rng.random() > 0.3})))
    return command(spark, rows)


def test_snapshot_replay_is_full_replay(spark):
    e = ingest.ingest(walk(spark)).where("code is null").drop("state").cache()
    whole = {(r["entity_id"], r["version"]): (r["state"], r["deleted"]) for r in asof.state_history(e).collect()}
    planned = {(r["entity_id"], r["version"]): (r["state"], r["deleted"]) for r in ingest.ingest(walk(spark)).where("code is null").collect()}
    assert whole == planned
    snaps = asof.build_snapshots(asof.state_history(e), 5).select(*KEY, "version", "ts", "deleted", "state").cache()
    parts = {(r["entity_id"], r["version"]): (r["state"], r["deleted"]) for r in asof.state_history(e, snaps, 5).collect()}
    assert parts == whole
    for v in (1, 5, 7, 20, 1000):
        probes = e.select(*KEY).distinct().withColumns({"at": F.lit(None).cast("timestamp"), "version": F.lit(v).cast("long")})
        for r in asof.state_at(probes, e, snaps).collect():
            assert (r["state"], r["deleted"]) == whole[r["entity_id"], r["version"]] and r["events_applied"] < 5


def test_snapshot_boundaries(spark):
    s = spark.range(0, 10).withColumnRenamed("id", "version")
    assert [r["version"] for r in asof.build_snapshots(s, 3).collect()] == [3, 6, 9]
    assert asof.build_snapshots(s, 0).isEmpty() and asof.build_snapshots(s, -1).isEmpty()


def test_chain_finds_each_change(spark):
    e = ingest.ingest(walk(spark, 6)).where("code is null")
    rows = [r.asDict(recursive=True) for r in e.collect()]
    full = spark.createDataFrame([{**dict.fromkeys([c.split()[0] for c in EVENTS.split(", ") if " " in c][:0]), **{k: r.get(k) for k in ("tenant", "collection", "entity_id", "version", "op", "author", "source", "ts_source", "ts_received", "changes")}, "flow": {"id": "f", "caused_by": [], "step": None}} for r in rows],
        "tenant string, collection string, entity_id string, version long, op string, author string, source string, ts_source timestamp, ts_received timestamp, changes array<struct<path:string,op:string,old:string,new:string>>, flow struct<id:string,caused_by:array<struct<activity_id:string,collection:string,entity_id:string,version:bigint,event_id:string>>,step:string>")
    links = chain.build_chain(full).select(*KEY, "version", F.struct("hash", "prev_hash").alias("integrity"))
    good = full.join(links, [*KEY, "version"]).cache()
    assert chain.verify_chain(good).isEmpty()
    for column, value in (("author", F.lit("x")), ("source", F.lit("x")), ("op", F.lit("noop")), ("ts_source", F.lit(T0 + timedelta(milliseconds=5)))):
        bad = chain.verify_chain(good.withColumn(column, F.when(F.col("version") == 2, value).otherwise(F.col(column)))).collect()
        assert bad and all(b["version"] == 2 and b["problem"] == "bad_hash" for b in bad)
    sub_ms = good.withColumn("ts_source", F.col("ts_source") + F.expr("interval 300 microseconds"))
    assert chain.verify_chain(sub_ms).isEmpty()
    gone = chain.verify_chain(good.withColumn("integrity", F.when(F.col("version") != 3, F.col("integrity"))))
    assert {r["problem"] for r in gone.where("version = 3").collect()} == {"restart"}
    assert {r["version"] for r in chain.chain_gaps(good.where("version <> 2")).selectExpr("latest as version").collect()}


def test_rules(spark):
    ev = spark.createDataFrame([("t", "crm.deals", "42", 1, "update", "77", "crm", [("status", "change", '"active"', '"cancelled"'), ("items.0.price", "change", "1", "2"), ("items[sku=A].price", "change", "1", "2")]), ("t", "crm.deals", "x", 1, "create", None, None, [])],
        "tenant string, collection string, entity_id string, version long, op string, author string, source string, changes array<struct<path:string,op:string,old:string,new:string>>")
    ask = lambda c: [r["r"] for r in ev.orderBy(F.col("entity_id")).select(rules.compile_condition(c).alias("r")).collect()]
    f = lambda field, op, value=None: {"field": field, "op": op, "value": value}
    assert ask({"all": []}) == [True, True] and ask({"any": []}) == [False, False]
    assert ask(f("entity_id", "gt", 41)) == [True, False] and ask({"not": f("entity_id", "gt", 41)}) == [False, True]
    assert ask(f("source", "eq", "crm")) == [True, False] and ask(f("source", "ne", "crm")) == [False, True] and ask(f("source", "ne", "")) == [True, False]
    assert ask(f("author_id", "in", [77, "z"])) == [True, False] and ask(f("author_id", "exists")) == [True, False] and ask(f("source", "regex", "^c")) == [True, False]
    assert ask({"match": {"path": "items.*.price"}}) == [True, False] and ask({"match": {"path": "*", "new": "cancelled"}}) == [True, False]
    assert ask({"match": {"path": "status", "new": None}}) == [False, False] and ask({"match": {"path": ""}}) == [False, False]
    for bad, where in (({}, "condition"), ({"all": [{}], "any": []}, "condition"), ({"all": [f("op", "eq", 1), f("op", "huh")]}, "condition.all[1].op"), (f("nope", "eq"), "condition.field"), (f("op", "in", 1), "condition.value"), (f("op", "regex", "("), "condition.value"), ({"match": {"path": "a..b"}}, "condition.match.path")):
        with pytest.raises(rules.RuleError, match=where.replace("[", r"\[").replace("]", r"\]")):
            rules.compile_condition(bad)
    assert rules.validate_rule({"name": "", "condition": {}, "actions": [{"type": "webhook"}], "extra": 1}) and not rules.validate_rule({"name": "n", "condition": {"all": []}, "actions": [{"type": "log"}]})


def test_backoff_and_pages(spark):
    d = [r["d"] for r in spark.range(0, 9).select(delivery.backoff(F.col("id")).alias("d")).collect()]
    assert d[:3] == [0.5, 1.0, 2.0] and d[-1] == 30.0
    e = ingest.ingest(walk(spark, 10)).where("code is null").select(*KEY, "version", "ts_received").cache()
    seen, after = [], None
    while True:
        rows = history.page(e, "ts_received", False, after, 7).collect()
        seen += [r["ts_received"] for r in rows]
        after = history.next_cursor(rows[-1].asDict(), "ts_received", len(rows), 7) if rows else None
        if not after:
            break
    assert seen == sorted(r["ts_received"] for r in e.collect())
    with pytest.raises(ValueError):
        history.page(e, limit=0)


def test_flow_edges_of_each_shape(spark):
    ref = "struct<activity_id:string,collection:string,entity_id:string,version:bigint,event_id:string>"
    nodes = spark.createDataFrame([
        ("t", "f", "activity", "a1", T0, None, None, None, None, "a1", "call", None, []),
        ("t", "f", "event", "c/e/1", T0, "c", "e", 1, "id1", None, None, None, [("a1", None, None, None, None)]),
        ("t", "f", "event", "c/e/2", T0, "c", "e", 2, None, None, None, None, [(None, "c", "e", 1, None), (None, "c", "e", None, "id1"), ("gone", None, None, None, None)]),
    ], f"tenant string, flow_id string, kind string, node_id string, ts timestamp, collection string, entity_id string, version long, event_id string, activity_id string, type string, step string, caused_by array<{ref}>")
    edges = {(r["child"], r["place"]): (r["cause"], r["dangling"]) for r in flows.flow_edges(nodes).collect()}
    assert edges == {("c/e/1", 0): ("a1", False), ("c/e/2", 0): ("c/e/1", False), ("c/e/2", 1): ("c/e/1", False), ("c/e/2", 2): (None, True)}


def test_plugins_and_retention(spark):
    e = ingest.ingest(walk(spark, 5)).where("code is null").drop("code").cache()
    reg = plugins.Registry()
    reg.pre_store("tag", lambda df: df.withColumn("meta", F.lit('{"x":1}')))
    reg.pre_store("bad", lambda df: df.withColumn("author", F.lit("other")), "open")
    reg.pre_store("deny", lambda df: df.withColumn("reject", F.when(F.col("version") == 1, "no")))
    out = reg.run_pre_store(e, {"crm.deals": ["tag", "bad", "deny"]}).collect()
    assert len(out) == e.count() and all(r["meta"] == '{"x":1}' and r["plugin_errors"] == ["bad:signed_column_changed"] for r in out)
    assert {r["reject_code"] for r in out if r["version"] == 1} == {"no"} and {r["reject_code"] for r in out if r["version"] > 1} == {None}
    cfg = spark.createDataFrame([("crm.deals", "versions", 2)], "name string, retention_type string, retention_value int")
    kept, dropped = lifecycle.apply_retention(e, cfg, T0)
    assert kept.groupBy("entity_id").count().where("count > 2").isEmpty() and kept.count() + dropped.count() == e.count()


def test_stream_batches_fold_sorted_rows_and_carry_state(spark, tmp_path, monkeypatch):
    """Three micro-batches, whole current tables every second one: as one batch fold; no entity's rows are gathered."""
    monkeypatch.setattr(stream, "FULL", 2)
    rows = [(f"e{i % 3}", *(("delete", None) if i % 7 == 6 else ("state", '{"n":%d}' % (i // 4)))) for i in range(60)]
    cmds = command(spark, rows).cache()
    write = stream.store_batch(str(tmp_path))
    for i in range(3):
        part = cmds.where(f"seq >= {20 * i} and seq < {20 * i + 20}")
        assert "MapInArrow" in stream.stream_ingest(part, str(tmp_path), i)._jdf.queryExecution().executedPlan().toString()
        write(part, i)
        write(part, i)
    columns = ["entity_id", "version", "op", "seq", "state", "deleted"]
    got = spark.read.parquet(f"{tmp_path}/events").select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, ingest.ingest(cmds).where("code is null").select(*columns).collect()))


def test_malformed_states_lose_nothing_else(spark):
    cmds = command(spark, [("d", "state", '{"n":1}'), ("d", "state", "{bad"), ("d", "state", '{"n":2}'), ("d", "state", None), ("d", "state", '{"n":3}')])
    pick = lambda rows: [(r["seq"], r["version"], r["code"]) for r in sorted(rows, key=lambda r: r["seq"])]
    want = [(0, 1, None), (1, None, "invalid_payload"), (2, 2, None), (3, None, "invalid_payload"), (4, 3, None)]
    assert pick(ingest.ingest(cmds).collect()) == want and pick(ingest.ingest_states(cmds).collect()) == want


def test_many_probes_of_an_entity(spark):
    e = ingest.ingest(walk(spark)).where("code is null").cache()
    whole = {(r["entity_id"], r["version"]): (r["state"], r["deleted"]) for r in e.collect()}
    keys = e.select(*KEY).distinct()
    probes = keys.withColumns({"at": F.lit(None).cast("timestamp"), "version": F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 5, 6, 10, 17)]))})
    snaps = asof.build_snapshots(asof.state_history(e), 5).select(*KEY, "version", "ts", "deleted", "state")
    for held, tail in ((None, lambda v: v), (snaps, lambda v: v % 5)):
        got = asof.state_at(probes, e, held).collect()
        assert len(got) == 5 * keys.count()
        for r in got:
            assert (r["state"], r["deleted"]) == whole[r["entity_id"], r["version"]] and r["events_applied"] == tail(r["version"])
    assert asof.state_at(probes.limit(0), e, snaps).isEmpty() and asof.state_at(probes, e.limit(0), snaps.limit(0)).isEmpty()


def test_literals_and_keys_spell_numbers_alike():
    texts = {0.0: "0", 1: "1", 12.5: "12.5", 123456: "123456", 1e6: "1e+06", 1234567.0: "1.234567e+06", 1e-4: "0.0001", 1e-5: "1e-05", -2.5e-7: "-2.5e-07", 1e21: "1e+21"}
    assert {x: J.number_text(x) for x in texts} == texts and J.key_text(True) == "true" and J.key_text([1]) is None
    assert J.changes_between([{"k": 1e6}], [], {"": "k"})[0]["path"] == "[k=1e+06]"


def test_broken_rules_are_skipped(spark):
    e = ingest.ingest(command(spark, [("d", "state", '{"n":1}')])).where("code is null")
    fine = {"id": "a", "condition": {"field": "op", "op": "ne", "value": {"x": 1}}, "actions": [{"type": "log"}]}
    broken = [{"condition": {"all": []}, "actions": [{"type": "log"}]}, {"id": "b", "condition": {"all": []}, "actions": [{"level": "warn"}]}, {"id": "c", "condition": 3, "actions": None}]
    assert [r["rule_id"] for r in rules.match_rules(e, [*broken, fine]).collect()] == ["a"]

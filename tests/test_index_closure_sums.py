"""Rules by index, lineage by doubling, sketches at rest and running sums in blocks, each against a plain form."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from histspark.operators import catalog, flows, rule_index, rules

T0 = datetime(2024, 1, 1)
EVENT = "tenant string, collection string, entity_id string, version long, op string, author string, source string, changes array<struct<path:string,op:string,old:string,new:string>>"


def _some_events(spark, rng, n):
    pick = lambda *v: rng.choice([*v, None, ""])
    change = lambda: (rng.choice(["a", "a.b", "c"]), rng.choice(["add", "change", "remove"]), rng.choice([None, "1"]), rng.choice([None, "1", '"x"']))
    rows = [("t", pick("c.x", "c.y"), str(i % 9), i, rng.choice(["create", "update", "delete"]), pick("1", "2"), pick("s", "1e2", "7"), rng.choice([None, [], [change() for _ in range(3)]])) for i in range(n)]
    return spark.createDataFrame(rows, EVENT)


def _condition(rng, depth):
    if depth and rng.random() < 0.6:
        kind = rng.choice(["all", "any", "not"])
        if kind == "not":
            return {"not": _condition(rng, depth - 1)}
        return {kind: [_condition(rng, depth - 1) for _ in range(rng.randrange(4))]}
    if rng.random() < 0.3:
        spec = {"path": rng.choice(["a", "*", "a.*", "a.b", "", "c"]), "op": rng.choice([None, "add", "change"]), "old": 1, "new": rng.choice([1, "x", None])}
        return {"match": {k: v for k, v in spec.items() if rng.random() < 0.6}}
    field = rng.choice(["op", "entity_id", "author_id", "source"])
    op = rng.choice(rules.SCALAR_OPS)
    value = [rng.choice([1, 2, "update", "", None, "3"]) for _ in range(rng.randrange(4))] if op == "in" else rng.choice(["^s", "1$"]) if op == "regex" else rng.choice([1, 2, 7.5]) if op in ("gt", "gte", "lt", "lte") else rng.choice([1, 2, "update", "", None, "s"])
    return {"field": field, "op": op, "value": value}


def test_index_equals_one_predicate_per_rule(spark, monkeypatch):
    """Random rule trees over events with nulls and empty texts; both forms of the join."""
    rng = random.Random(5)
    events = _some_events(spark, rng, 120).cache()
    made = [{"id": str(i), "name": f"n{i}", "condition": _condition(rng, 3), "actions": [{"type": "log", "message": "m"}, {"type": "webhook", "url": "u", "max_attempts": 2}][: rng.randrange(3)]} for i in range(150)]
    for r in made[::4]:
        r["collection"] = rng.choice(["c.x", "c.y", "none"])
    made += [{"id": "off", "enabled": False, "condition": {"all": []}, "actions": [{"type": "log"}]}, {"id": "bad", "condition": {"any": 1}, "actions": [{"type": "log"}]}]
    rows = lambda df: sorted(map(str, df.drop("changes").collect()))
    want = rows(rules.match_rules(events, made))
    assert len(want) > 1000 and rows(rule_index.match_rules_indexed(events, made)) == want
    monkeypatch.setattr(rule_index, "SENT_BYTES", -1)
    assert rows(rule_index.match_rules_indexed(events, made)) == want


def test_index_edges(spark):
    events = _some_events(spark, random.Random(1), 10)
    assert rule_index.match_rules_indexed(events, []).columns == rules.match_rules(events, []).columns
    always = [{"id": "a", "condition": {"all": []}, "actions": [{"type": "log"}]}]
    assert rule_index.match_rules_indexed(events, always).count() == 10 and rule_index.match_rules_indexed(events.limit(0), always).isEmpty()
    assert rule_index.match_rules_indexed(events, [{"id": "a", "condition": {"any": []}, "actions": [{"type": "log"}]}]).isEmpty()
    # an entity and an author: one group of keys each; the entity alone where both are needed
    assert rule_index.required(rules.parse_condition({"any": [{"field": "entity_id", "op": "eq", "value": 1}, {"field": "author_id", "op": "eq", "value": 2}]})) == [("entity_id", ("1",)), ("author", ("2",))]
    assert rule_index.required(rules.parse_condition({"all": [{"field": "author_id", "op": "eq", "value": 2}, {"field": "entity_id", "op": "eq", "value": 1}]})) == [("entity_id", ("1",))]
    assert rule_index.required(rules.parse_condition({"not": {"field": "op", "op": "eq", "value": "x"}})) is None


def test_plan_grows_with_shapes_not_rules(spark):
    events = _some_events(spark, random.Random(2), 10)
    made = lambda n: [{"id": str(i), "condition": {"field": "entity_id", "op": "eq", "value": i}, "actions": [{"type": "log"}]} for i in range(n)]
    plan = lambda n: rule_index.match_rules_indexed(events, made(n))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(3000)) < len(plan(1)) + 200


def _closure(pairs):
    out = {}
    up = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)
    for a in up:
        level, seen, n = up[a], {}, 1
        while level:
            seen |= {x: n for x in level}
            level, n = {y for x in level for y in up.get(x, ())} - set(seen), n + 1
        out |= {(a, x): k for x, k in seen.items()}
    return out


def test_closure(spark):
    rng = random.Random(3)
    edge = "tenant string, child string, cause string"
    got = lambda pairs: {(r["node"], r["ancestor"]): r["distance"] for r in flows.flow_closure(spark.createDataFrame([("t", *p) for p in pairs], edge)).collect()}
    graph = [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(60)]  # cycles, self loops, repeats
    assert got([*graph, *graph[:5]]) == _closure(graph)
    chain = [(str(i), str(i - 1)) for i in range(1, 1001)]
    rows = flows.flow_closure(spark.createDataFrame([("t", *p) for p in chain], edge))
    assert rows.count() == 500_500 and rows.where("distance <> int(node) - int(ancestor) or cycle").isEmpty()
    loops = flows.flow_closure(spark.createDataFrame([("t", "a", "b"), ("t", "b", "a"), ("t", "c", "a"), ("u", "b", None)], edge)).where("cycle").collect()
    assert {(r["node"], r["distance"]) for r in loops} == {("a", 2), ("b", 2)}
    assert flows.flow_closure(spark.createDataFrame([], edge)).isEmpty()


def test_sketches_merge(spark):
    rows = spark.range(40_000).select((F.col("id") % 2).alias("q"), F.when(F.col("id") % 100 != 7, F.xxhash64("id") % 10_000).alias("v"), F.timestamp_seconds(F.col("id")).alias("at"))
    kept = catalog.latency_sketches(rows, "v", "at", "q")
    assert kept.count() == 24 and catalog.latency_sketches(rows.limit(0), "v", "at", "q").isEmpty()
    at = lambda s: datetime(1970, 1, 1) + timedelta(hours=s)
    some = {r["q"]: r for r in catalog.sketched_percentiles(kept, "q", since=at(2), until=at(8), ranks=(0.1, 0.5, 0.999)).collect()}
    for q, r in some.items():
        values = sorted(x["v"] for x in rows.where(f"q = {q} and v is not null and at >= '1970-01-01 02:00:00' and at < '1970-01-01 08:00:00'").collect())
        assert (r["n"], r["low"], r["high"]) == (len(values), values[0], values[-1])
        for name, rank in (("p10", 0.1), ("p50", 0.5), ("p99_9", 0.999)):
            assert abs(sum(v <= r[name] for v in values) / len(values) - rank) < 0.01


def test_prefix_sums(spark):
    """One key with most rows, a null key, null values; many blocks."""
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), i, rng.choice([None, 1, -2, 5])) for i in range(3000)]
    rows = spark.createDataFrame(data, "k string, at int, id int, v int")
    sums, want = {}, {}
    for k, _, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        sums[k] = sums.get(k, 0) + (v or 0)
        want[i] = sums[k]
    for block in (100, 10_000):
        got = catalog.prefix_sums(rows, ["k"], ["at", "id"], "v", block=block)
        assert {r["id"]: r["total"] for r in got.collect()} == want and got.columns == [*rows.columns, "total"]
    assert catalog.prefix_sums(rows.limit(0), ["k"], ["at", "id"], "v").isEmpty()

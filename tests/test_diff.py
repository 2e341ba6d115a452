import json
import random

import pytest
from pyspark.sql import functions as F

from histspark.functions import jsonvalue as J
from histspark.functions import jsonx
from histspark.operators.apply import apply_flat, json_apply
from histspark.operators.diff import json_diff, table_diff

CASES = [
    ({"a": 1}, {"a": 1}, None, []),
    ({"a": {"b": 1}}, {"a": {"b": 2}}, None, [("a.b", "change", "1", "2")]),
    ({"x": 1}, {"y": 2}, None, [("x", "remove", "1", None), ("y", "add", None, "2")]),
    ({}, {"a": None}, None, [("a", "add", None, "null")]),
    ({"a": None}, {}, None, [("a", "remove", "null", None)]),
    ({"a": [1]}, {"a": {"b": 1}}, None, [("a", "change", "[1]", '{"b":1}')]),
    ({"t": ["a", "b"]}, {"t": ["a", "c"]}, None, [("t.1", "change", '"b"', '"c"')]),
    ({"t": ["a"]}, {"t": ["a", "b", "c"]}, None, [("t.1", "add", None, '"b"'), ("t.2", "add", None, '"c"')]),
    ({"t": ["a", "b", "c"]}, {"t": ["a"]}, None, [("t.2", "remove", '"c"', None), ("t.1", "remove", '"b"', None)]),
    (1, 2, None, [("", "change", "1", "2")]),
    ({"i": [{"k": "A", "q": 1}, {"k": "B", "q": 1}]}, {"i": [{"k": "C", "q": 3}, {"k": "A", "q": 5}]}, {"i": "k"}, [("i[k=A].q", "change", "1", "5"), ("i[k=B]", "remove", '{"k":"B","q":1}', None), ("i[k=C]", "add", None, '{"k":"C","q":3}')]),
    ({"i": [{"k": "A"}, {"k": "A"}]}, {"i": [{"k": "A"}, {"k": "B"}]}, {"i": "k"}, [("i.1.k", "change", '"A"', '"B"')]),
    ({"i": [{"k": 1, "v": 1}, {"k": 2, "v": 1}]}, {"i": [{"k": 2, "v": 1}, {"k": 1, "v": 1}]}, {"i": "k"}, []),
]


@pytest.mark.parametrize("keys", [None, {"i": "k"}])
def test_cases(spark, keys):
    rows = [(n, json.dumps(a), json.dumps(b)) for n, (a, b, k, _) in enumerate(CASES) if k == keys]
    out = json_diff(spark.createDataFrame(rows, "n int, a string, b string"), "a", "b", keys).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [tuple(c) for c in r["changes"]] == CASES[r["n"]][3], CASES[r["n"]]
        py = J.changes_between(J.loads(r["a"]), J.loads(r["b"]), keys)
        assert [(c["path"], c["op"], c["old"], c["new"]) for c in py] == CASES[r["n"]][3]


def _value(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind < 5:
        return [None, rng.random() < 0.5, rng.randint(-3, 3), rng.choice("xyz"), 1.5][kind]
    if kind == 5:
        return [_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: _value(rng, depth - 1) for k in "abc" if rng.random() < 0.6}


def test_random_round_trip(spark):
    rng = random.Random(1)
    rows = [(json.dumps({"r": _value(rng, 3)}), json.dumps({"r": _value(rng, 3)})) for _ in range(300)]
    out = json_apply(json_diff(spark.createDataFrame(rows, "a string, b string"), "a", "b"), "a", "changes")
    for r in out.collect():
        assert r["apply_error"] is None and J.same(J.loads(r["applied"]), J.loads(r["b"]))
        py = J.changes_between(J.loads(r["a"]), J.loads(r["b"]))
        assert [(c["path"], c["op"], c["old"], c["new"]) for c in py] == [tuple(c) for c in r["changes"]]


def test_deep_and_malformed(spark):
    deep = lambda n, x: '{"a":' * n + str(x) + "}" * n
    df = spark.createDataFrame([(deep(40, 1), deep(40, 2)), (deep(300, 1), deep(300, 1))], "a string, b string")
    got = [[tuple(c) for c in r["changes"]] for r in json_diff(df, "a", "b").collect()]
    assert got == [[(".".join("a" * 40), "change", "1", "2")], []]
    bad = spark.createDataFrame([("{", "{"), (None, None), (None, "{}"), ("{", "{}"), (deep(100_000, 1), "1")], "a string, b string")
    assert [[tuple(c) for c in r["changes"]] for r in json_diff(bad, "a", "b").collect()] == [[], [], *[[("", "change", None, "{}")]] * 2, [("", "change", None, "1")]]


def test_array_keys_of_each_row(spark):
    rows = [('{"i":[{"k":1},{"k":2}]}', '{"i":[{"k":2}]}', {"i": "k"}), ('{"i":[{"k":1},{"k":2}]}', '{"i":[{"k":2}]}', None)]
    out = json_diff(spark.createDataFrame(rows, "a string, b string, m map<string,string>"), "a", "b", F.col("m")).collect()
    assert [[c["path"] for c in r["changes"]] for r in out] == [["i[k=1]"], ["i.0.k", "i.1"]]


def test_apply_errors(spark):
    rows = [("{}", [("a.b", "change", None, "1")], "path_not_found"), ('{"a":1}', [("b", "remove", None, None)], "path_not_found"), ('{"a":1}', [("a.b", "add", None, "1")], "type_mismatch"), ("{}", [("a", "move", None, None)], "unknown_op"), ("{bad", [], "malformed"), ("{}", [("a", "add", None, "{")], "malformed"), ('{"a":[1]}', [("a.0", "add", None, "0")], None)]
    df = spark.createDataFrame(rows, "state string, changes array<struct<path:string,op:string,old:string,new:string>>, want string")
    out = json_apply(df).collect()
    assert all(r["apply_error"] == r["want"] for r in out)
    assert out[-1]["applied"] == '{"a":[0,1]}'


def test_apply_flat(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, [("a", "remove", "1", None), ("c", "add", None, "3")])], "m map<string,string>, changes array<struct<path:string,op:string,old:string,new:string>>")
    assert df.select(apply_flat(F.col("m"), F.col("changes")).alias("m")).first()["m"] == {"b": "2", "c": "3"}


def test_table_diff(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "z", 5), (3, "w", None)], "k int, s string, n int")
    got = {tuple(r) for r in table_diff(a, b, ["k"], ["s", "n"]).collect()}
    assert got == {(1, "s", "change", "x", "z"), (1, "n", "add", None, "5"), (2, "s", "remove", "y", None), (2, "n", "remove", "1", None), (3, "s", "add", None, "w")}


def test_paths_globs_and_text(spark):
    row = spark.createDataFrame([("items[sku=A.1].price", "a/b~c.d")], "p string, q string")
    seg = row.select(jsonx.parse_path("p").alias("s"), jsonx.json_pointer(F.col("q")).alias("j"), jsonx.json_pointer(F.col("p")).alias("n")).first()
    assert [s["kind"] for s in seg["s"]] == ["key", "keyed", "key"] and seg["s"][1]["key_val"] == "A.1"
    assert seg["j"] == "/a~1b~0c/d" and seg["n"] is None
    assert jsonx.glob_regex("items.*.price") == r"^items\.[^.]*\.price$" and jsonx.glob_regex("") == "^$"
    with pytest.raises(ValueError):
        jsonx.glob_regex("a..b")
    texts = spark.createDataFrame([('{"b":250.0,"a":"<&>"}',), ("1e2",), ("{",), (None,), ('{"a":1}x',), ("1,2",), ("",)], "t string").select(jsonx.canonical_json("t").alias("c")).collect()
    assert [r["c"] for r in texts] == ['{"a":"<&>","b":250}', "100", None, None, None, None, None]


def test_hmac(spark):
    import hashlib
    import hmac

    for secret in ("k", "s" * 100):
        got = spark.createDataFrame([("body é",)], "b string").select(jsonx.hmac_sha256(F.col("b"), secret).alias("s")).first()["s"]
        assert got == "sha256=" + hmac.new(secret.encode(), "body é".encode(), hashlib.sha256).hexdigest()

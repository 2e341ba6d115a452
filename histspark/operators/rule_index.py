"""Many rules at once: an inverted index of what each rule requires brings events and rules together.

A rule that needs ``author = 3`` can fire only for events of that author. Such required equalities, on op, entity, author,
source, collection or an exact changed path, are the keys of the index. Events join it on (field, value), and only the rules
that an event meets are evaluated for it. What several rules of a key require alike is tested once for all of them. Rules of
one shape (equal but for their literals) share one predicate whose literals are columns of the rule's row, so the plan grows
with the shapes, not with the rules.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histspark.operators.rules import _ACTION, _action_row, _match, _usable, condition_column, number_of

#: Key fields, those with the most distinct values first: a rule is indexed by the first that it requires.
KEY_FIELDS = ("entity_id", "path", "author", "source", "collection", "op")
#: An index of at most this many bytes of text is sent to the tasks; a larger one is joined by shuffle.
SENT_BYTES = 64 << 20
#: Rules of one row of the index at most.
ROW_RULES = 1_000
_LITERALS = "shape int, texts array<string>, numbers array<double>, lists array<array<string>>"


def required(tree: tuple) -> list[tuple[str, tuple]] | None:
    """Groups (field, values) of which one holds wherever the condition does; None where nothing is required, no group
    where it never holds. In a group one event meets one value at most."""
    kind = tree[0]
    if kind == "all":
        covers = [c for c in map(required, tree[1]) if c is not None]
        return min(covers, key=_cost) if covers else None
    if kind == "any":
        groups: dict[Any, tuple] = {}
        for child in tree[1]:
            cover = required(child)
            if cover is None:
                return None
            for field, values in cover:
                # an event has many paths, so each is a group of its own
                at = (field, values) if field == "path" else field
                groups[at] = (field, tuple(dict.fromkeys(groups.get(at, (field, ()))[1] + values)))
        return list(groups.values())
    if kind in ("eq", "in"):
        values = (tree[2],) if kind == "eq" else tree[2]
        held = tuple(v for v in dict.fromkeys(values) if v != "")
        return [(tree[1], held)] if held else []
    if kind == "match" and tree[1] is not None:
        return [("path", (tree[1],))]
    return None


def _cost(groups: list[tuple[str, tuple]]) -> tuple:
    return (max((KEY_FIELDS.index(f) for f, _ in groups), default=-1), sum(len(v) for _, v in groups))


def _holds(group: tuple[str, tuple]) -> tuple:
    """The condition that an event meets a group."""
    field, values = group
    return ("match", values[0], "", None, ()) if field == "path" else ("in", field, values)


def _split(tree: tuple, texts: list, numbers: list, lists: list) -> tuple:
    """The shape of a condition: the tree with its literals' places; the literals are appended to their lists."""

    def put(value: Any) -> tuple:
        kind, held = ("lists", lists) if isinstance(value, tuple) else ("numbers", numbers) if isinstance(value, float) else ("texts", texts)
        held.append(value)
        return kind, len(held) - 1

    kind = tree[0]
    if kind in ("all", "any"):
        return kind, tuple(_split(t, texts, numbers, lists) for t in tree[1])
    if kind == "not":
        return kind, _split(tree[1], texts, numbers, lists)
    if kind == "match":
        _, whole, pattern, op, sides = tree
        path = (put(whole), None) if whole is not None else (None, put(pattern)) if pattern is not None else (None, None)
        return kind, *path, op, tuple((side, put(text)) for side, text in sides)
    return kind, tree[1], put(tree[2]) if tree[2] not in (None, ()) else tree[2]


_TRUE, _FALSE = ("all", ()), ("any", ())


def _given(tree: tuple, field: str, value: str, failed: list[tuple]) -> tuple:
    """The condition for events that meet a key and none of the groups in ``failed``: what these settle is left out."""
    kind = tree[0]
    if kind in ("all", "any"):
        same, other = (_TRUE, _FALSE) if kind == "all" else (_FALSE, _TRUE)
        parts = [t for t in (_given(t, field, value, failed) for t in tree[1]) if t != same]
        return other if other in parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))
    if kind == "not":
        inner = _given(tree[1], field, value, failed)
        return {_TRUE: _FALSE, _FALSE: _TRUE}.get(inner, ("not", inner))
    if kind in ("eq", "in"):
        held = {v for v in (tree[2] if kind == "in" else (tree[2],)) if v != ""}
        if tree[1] == field:
            return _TRUE if value in held else _FALSE
        return _FALSE if any(f == tree[1] and held <= set(values) for f, values in failed) else tree
    if kind == "match" and tree[1] is not None:
        if ("path", (tree[1],)) in failed:
            return _FALSE
        return _TRUE if field == "path" and tree[1] == value and tree[3] is None and not tree[4] else tree
    return tree


def _parts(tree: tuple) -> tuple:
    """What has to hold together, each once."""
    return tuple(dict.fromkeys(p for t in tree[1] for p in _parts(t))) if tree[0] == "all" else (tree,)


def _placed(at: str):
    """Columns of literals' places in the struct ``at``."""
    return lambda value: F.get(F.col(f"{at}.{value[0]}"), F.lit(value[1]))


def _number(column: str) -> Column:
    return F.col(f"_n_{column}")


def _changed(tree: tuple, bind) -> Column:
    """A match of a whole path, and of an op at most, is looked up among the event's changed paths."""
    _, whole, pattern, op, sides = tree
    if whole is None or pattern is not None or sides:
        return _match(tree, bind)
    return F.coalesce(F.array_contains("_changed", F.concat(F.lit(f"{op or ''}:"), bind(whole))), F.lit(False))


def _compared(tree: tuple) -> set[str]:
    """Fields that are compared as numbers."""
    if tree[0] in ("all", "any"):
        return {f for t in tree[1] for f in _compared(t)}
    return _compared(tree[1]) if tree[0] == "not" else {tree[1]} if tree[0] in ("gt", "gte", "lt", "lte") else set()


def _choose(shape: Column, tests: list[Column], low: int, high: int) -> Column:
    """The test of the row's shape, found by halving."""
    if high - low == 1:
        return tests[low]
    mid = (low + high) // 2
    return F.when(shape < mid, _choose(shape, tests, low, mid)).otherwise(_choose(shape, tests, mid, high))


def _test(at: str, shapes: dict[tuple, int]) -> Column:
    tests = [condition_column(shape, _placed(at), _number, _changed) for shape in shapes]
    return _choose(F.col(f"{at}.shape"), tests, 0, len(tests))


def _index(rules: list[dict]) -> tuple[list[tuple], dict[tuple, int], dict[tuple, int], set[str]]:
    """(rows of the index, shapes of common tests, shapes of own tests, fields compared as numbers). A row has field, value,
    the test that its rules have in common, and each action with the rest of its rule's test."""
    keyed: dict[tuple, list] = defaultdict(list)
    numbers: set[str] = set()
    for rule, tree, actions in _usable(rules):
        if not actions:
            continue
        if rule.get("collection"):
            tree = ("all", (tree, ("eq", "collection", str(rule["collection"]))))
        numbers |= _compared(tree)
        groups = required(tree)
        rows = [_action_row(rule, i, a) for i, a in enumerate(actions)]
        for i, group in enumerate([("", ("",))] if groups is None else groups):
            failed = groups[:i] if i else []
            for value in group[1]:
                parts = _parts(("all", (_given(tree, group[0], value, failed), *(("not", _holds(g)) for g in failed))))
                if _FALSE not in parts:
                    keyed[group[0], value].append((parts, rows))
    commons: dict[tuple, int] = {}
    owns: dict[tuple, int] = {}

    def literals(parts: list, shapes: dict[tuple, int]) -> tuple:
        texts, floats, lists = [], [], []
        return shapes.setdefault(_split(("all", tuple(parts)), texts, floats, lists), len(shapes)), texts, floats, [list(v) for v in lists]

    out = []
    for (field, value), units in keyed.items():
        often = Counter(p for parts, _ in units for p in parts)
        alike: dict[tuple, list] = defaultdict(list)
        for parts, rows in units:
            common = tuple(p for p in parts if often[p] > 1)
            own = literals([p for p in parts if often[p] == 1], owns)
            alike[tuple(sorted(common, key=repr))] += [(*own, row) for row in rows]
        for common, entries in alike.items():
            held = literals(list(common), commons)
            out += [(field, value, held, entries[at : at + ROW_RULES]) for at in range(0, len(entries), ROW_RULES)]
    return out, commons, owns, numbers


def match_rules_indexed(events: DataFrame, rules: list[dict]) -> DataFrame:
    """The rows of ``match_rules``, for any number of rules.

    Events are read once. Rules without a required equality meet every event; the others only events with one of their
    keys. What a key implies is not tested again, and what rules of a key have in common is tested before they are looked
    at one by one. A rule with several groups of keys is evaluated once per group and fires for the first that an event
    meets, so no row comes twice and nothing has to be made distinct.
    """
    rows, commons, owns, numbers = _index(rules)
    if not rows:
        return events.withColumn("_m", F.lit(None).cast(_ACTION)).where(F.lit(False)).select(*events.columns, "_m.*")
    fields = {r[0] for r in rows}
    index = events.sparkSession.createDataFrame(rows, f"_field string, _value string, _common struct<{_LITERALS}>, _rules array<struct<{_LITERALS}, action {_ACTION}>>")
    own = [F.array(F.struct(F.lit(f).alias("f"), F.coalesce(F.col(f), F.lit("")).alias("v"))) for f in KEY_FIELDS if f in fields and f != "path"]
    if "path" in fields:
        paths = F.array_distinct(F.transform("changes", lambda c: c["path"]))
        own.append(F.coalesce(F.transform(paths, lambda p: F.struct(F.lit("path").alias("f"), p.alias("v"))), F.array().cast("array<struct<f:string,v:string>>")))
    if "" in fields:
        own.append(F.array(F.struct(F.lit("").alias("f"), F.lit("").alias("v"))))
    # what tests read is made once an event, not once a rule
    made = [number_of(f).alias(f"_n_{f}") for f in sorted(numbers)]
    if any("'match'" in repr(shape) for shape in (*commons, *owns)):
        made.append(F.flatten(F.transform("changes", lambda c: F.array(F.concat(F.lit(":"), c["path"]), F.concat(c["op"], F.lit(":"), c["path"])))).alias("_changed"))
    asked = events.select(*events.columns, *made, F.explode(F.concat(*own)).alias("_key")).withColumns({"_field": F.col("_key.f"), "_value": F.col("_key.v")})
    met = asked.join(F.broadcast(index) if sum(len(json.dumps(r)) for r in rows) <= SENT_BYTES else index, ["_field", "_value"]).where(_test("_common", commons))
    fired = met.select(*asked.columns, F.explode("_rules").alias("_rule")).where(_test("_rule", owns))
    return fired.select(*events.columns, "_rule.action.*")

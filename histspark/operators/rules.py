"""Rule trees compiled to Columns: one scan evaluates all rules of a collection."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histspark.functions.jsonx import glob_regex
from histspark.functions.jsonvalue import dumps, key_text

FIELDS = {"op": "op", "entity_id": "entity_id", "author_id": "author", "source": "source"}
SCALAR_OPS = ("eq", "ne", "in", "gt", "gte", "lt", "lte", "regex", "exists")
NODE_KINDS = ("all", "any", "not", "match", "field")
#: Rules evaluated by one select.
CHUNK = 50
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Pattern syntax that only one of the two common regex dialects has.
_FOREIGN = re.compile(r"\(\?(?!:|[imsU-]+[:)]|P<)|\\[1-9]|\\z|\(\?P<|[*+?}]\+")


class RuleError(ValueError):
    """A located error, e.g. ``condition.all[1].op: unknown op``."""


def _literal_text(value: Any) -> str:
    """Text of a rule's literal; anything but a scalar is the empty text and matches no field."""
    return key_text(value) or ""


def parse_condition(node: Any, at: str = "condition") -> tuple:
    """A checked condition as nested tuples: ("all" | "any", parts), ("not", part), ("match", parts of the pattern), or
    (op, field, literal) with the literal as text, number or list of texts."""
    if not isinstance(node, dict):
        raise RuleError(f"{at}: not an object")
    kinds = [k for k in NODE_KINDS if k in node]
    if len(kinds) != 1:
        raise RuleError(f"{at}: exactly one of {', '.join(NODE_KINDS)} is needed")
    kind = kinds[0]
    if kind in ("all", "any"):
        if not isinstance(node[kind], list):
            raise RuleError(f"{at}.{kind}: not a list")
        return kind, tuple(parse_condition(child, f"{at}.{kind}[{i}]") for i, child in enumerate(node[kind]))
    if kind == "not":
        return "not", parse_condition(node["not"], f"{at}.not")
    if kind == "match":
        return _parse_match(node["match"], f"{at}.match")
    return _parse_scalar(node, at)


def _parse_scalar(node: dict, at: str) -> tuple:
    field, op = node.get("field"), node.get("op")
    if field not in FIELDS:
        raise RuleError(f"{at}.field: unknown field {field!r}")
    if op not in SCALAR_OPS:
        raise RuleError(f"{at}.op: unknown op {op!r}")
    value, column = node.get("value"), FIELDS[field]
    if op == "exists":
        return op, column, None
    if op in ("eq", "ne"):
        return op, column, _literal_text(value)
    if op == "in":
        if not isinstance(value, list):
            raise RuleError(f"{at}.value: a list is needed")
        return op, column, tuple(_literal_text(v) for v in value)
    if op == "regex":
        try:
            re.compile(value)
        except (re.error, TypeError) as e:
            raise RuleError(f"{at}.value: bad pattern") from e
        if _FOREIGN.search(value):
            raise RuleError(f"{at}.value: unsupported pattern syntax")
        return op, column, value
    try:
        return op, column, float(value)
    except (TypeError, ValueError) as e:
        raise RuleError(f"{at}.value: a number is needed") from e


def _parse_match(spec: Any, at: str) -> tuple:
    if not isinstance(spec, dict) or set(spec) - {"path", "op", "old", "new"}:
        raise RuleError(f"{at}: unknown keys")
    if spec.get("op") not in (None, "add", "change", "remove"):
        raise RuleError(f"{at}.op: unknown op {spec['op']!r}")
    path = spec.get("path")
    try:
        pattern = glob_regex(path) if path is not None else None
    except ValueError as e:
        raise RuleError(f"{at}.path: {e}") from e
    whole = path if path is not None and "*" not in path.split(".") else None
    return "match", whole, pattern, spec.get("op"), tuple((side, dumps(spec[side])) for side in ("old", "new") if side in spec)


def _bare(value: Any) -> Any:
    """A literal as it stands in a plain predicate: a list stays a list, all else becomes a column."""
    return list(value) if isinstance(value, tuple) else F.lit(value)


def number_of(column: str) -> Column:
    """The number that a field's text is, NULL for any other text."""
    c = F.coalesce(F.col(column), F.lit(""))
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def condition_column(tree: tuple, bind: Callable[[Any], Any] = _bare, number: Callable[[str], Column] = number_of, match: Callable[..., Column] | None = None) -> Column:
    """The predicate of a parsed condition, never NULL, so ``not`` stays two-valued. Empty ``all`` is true, empty ``any``
    false. ``bind`` gives the column of a literal (lists: a list, or an array column), ``number`` that of a field's number,
    ``match`` that of a match on changes."""
    kind = tree[0]
    if kind in ("all", "any"):
        out = F.lit(kind == "all")
        for child in tree[1]:
            part = condition_column(child, bind, number, match)
            out = out & part if kind == "all" else out | part
        return out
    if kind == "not":
        return ~condition_column(tree[1], bind, number, match)
    if kind == "match":
        return (match or _match)(tree, bind)
    op, column, value = tree
    c = F.coalesce(F.col(column), F.lit(""))
    if op == "exists":
        return c != ""
    if op == "eq":
        return (c == bind(value)) & (c != "")
    if op == "ne":
        return c != bind(value)
    if op == "in":
        if not value:
            return F.lit(False)
        values = bind(value)
        return (c.isin(values) if isinstance(values, list) else F.array_contains(values, c)) & (c != "")
    if op == "regex":
        return F.rlike(c, bind(value)) & (c != "")
    limit = bind(value)
    n = number(column)
    test = {"gt": n > limit, "gte": n >= limit, "lt": n < limit, "lte": n <= limit}[op]
    return F.coalesce(test, F.lit(False))


def _match(tree: tuple, bind: Callable[[Any], Any]) -> Column:
    _, whole, pattern, op, sides = tree
    at = pattern if whole is None else whole
    path = bind(at) if at is not None else None
    texts = [(side, bind(text)) for side, text in sides]

    def hit(c: Column) -> Column:
        out = F.lit(True)
        if path is not None:
            out = out & (c["path"] == path if whole is not None else F.rlike(c["path"], path))
        if op:
            out = out & (c["op"] == op)
        for side, text in texts:
            out = out & c[side].eqNullSafe(text)
        return F.coalesce(out, F.lit(False))

    return F.coalesce(F.exists("changes", hit), F.lit(False))


def compile_condition(node: Any, at: str = "condition") -> Column:
    """A predicate that is never NULL, so ``not`` stays two-valued. Empty ``all`` is true, empty ``any`` false."""
    return condition_column(parse_condition(node, at))


def validate_rule(rule: dict) -> list[str]:
    """Problems of one rule; empty when it may be saved."""
    out = []
    unknown = set(rule) - {"id", "name", "collection", "enabled", "condition", "actions"}
    if unknown:
        out.append(f"unknown keys {sorted(unknown)}")
    if not rule.get("name"):
        out.append("name: required")
    try:
        compile_condition(rule.get("condition"))
    except RuleError as e:
        out.append(str(e))
    if not rule.get("actions"):
        out.append("actions: at least one")
    for i, a in enumerate(rule.get("actions") or []):
        if a.get("type") not in ("webhook", "log"):
            out.append(f"actions[{i}].type: unknown type")
        if a.get("type") == "webhook" and not a.get("url"):
            out.append(f"actions[{i}].url: required")
        out += [f"actions[{i}].{k}: negative" for k in ("timeout_ms", "max_attempts") if (a.get(k) or 0) < 0]
    return out


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """(collection, name, n) of names used more than once."""
    return rules.groupBy("collection", "name").agg(F.count("*").alias("n")).where("n > 1")


_ACTION_FIELDS = tuple((n, "int" if n in ("action", "max_attempts", "timeout_ms") else "string") for n in "rule_id rule_name action type url secret_ref level message max_attempts timeout_ms".split())
_ACTION = "struct<" + ",".join(f"{n}:{t}" for n, t in _ACTION_FIELDS) + ">"


def _usable(rules: list[dict]) -> list[tuple[dict, tuple, list[dict]]]:
    """(rule, parsed condition, actions) of the rules that can fire: enabled, well formed, with an id and actions' types."""
    out = []
    for rule in rules:
        if not rule.get("enabled", True):
            continue
        try:
            tree, actions = parse_condition(rule["condition"]), rule.get("actions") or []
            rule["id"], [a["type"] for a in actions]
        except (RuleError, KeyError, TypeError):
            continue
        out.append((rule, tree, actions))
    return out


def _action_row(rule: dict, i: int, a: dict) -> tuple:
    """The fields of ``_ACTION``."""
    text = lambda v: None if v is None else str(v)
    whole = lambda v: None if v is None else int(v)
    return (text(rule["id"]), text(rule.get("name")), i, text(a["type"]), text(a.get("url")), text(a.get("secret_ref")), _level(a.get("level")), text(a.get("message")), whole(a.get("max_attempts")), whole(a.get("timeout_ms")))


def match_rules(events: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per (event, rule, action) that fires. Disabled rules and rules that do not compile, or
    lack an id or an action's type, are skipped. One scan:
    the rules, in chunks, become array columns that are exploded. For more than some hundred rules ``match_rules_indexed``
    gives the same rows."""
    chunks: list[Column] = []
    firing: list[Column] = []
    for rule, tree, actions in _usable(rules):
        test = condition_column(tree)
        if rule.get("collection"):
            test = test & (F.col("collection") == rule["collection"])
        for i, a in enumerate(actions):
            row = F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(_action_row(rule, i, a), _ACTION_FIELDS, strict=True)])
            firing.append(F.when(test, row))
            if len(firing) == CHUNK:
                chunks.append(F.array_compact(F.array(*firing)))
                firing = []
    if firing:
        chunks.append(F.array_compact(F.array(*firing)))
    if not chunks:
        return events.withColumn("m", F.lit(None).cast(_ACTION)).where(F.lit(False)).select(*events.columns, "m.*")
    fired = F.concat(*chunks) if len(chunks) > 1 else chunks[0]
    return events.select(*events.columns, F.explode(fired).alias("m")).select(*events.columns, "m.*")


def _level(level: str | None) -> str:
    return {"debug": "debug", "warn": "warn", "warning": "warn", "error": "error"}.get((level or "").lower(), "info")


def log_alerts(matches: DataFrame) -> DataFrame:
    """Alert rows of log actions."""
    return matches.where("type = 'log'").select("tenant", "collection", "entity_id", "version", "rule_id", "rule_name", "level", "message")

"""Structural diff of JSON documents and typed tables."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histspark.functions import jsonvalue as J
from histspark.operators.fold import values
from histspark.schemas import CHANGES
from histspark.session import with_package

def _document(text: str | None) -> tuple[bool, object]:
    """(present, value); malformed text is absent."""
    try:
        return text is not None, J.loads(text)
    except ValueError:
        return False, None


def _changes(before: tuple[bool, object], after: tuple[bool, object], keys: dict | None) -> list[dict]:
    (has_a, a), (has_b, b) = before, after
    if has_a and has_b:
        return J.changes_between(a, b, keys)
    return [{"path": "", "op": "change", "old": J.dumps(a) if has_a else None, "new": J.dumps(b) if has_b else None}] if has_a or has_b else []


def _lists(befores: list, afters: list, keys: Iterable[dict | None]) -> pa.Array:
    """Change lists of a batch, built by column. In the order of a history a row starts from the document the row before
    ended in, so that one is not parsed again."""
    starts, columns = [0], {c: [] for c in ("path", "op", "old", "new")}
    paths, ops, olds, news = columns.values()
    held: tuple = (None, (False, None))
    for before, after, key in zip(befores, afters, keys):  # noqa: B905  (keys may be endless)
        if before != after:
            start = held[1] if before == held[0] else _document(before)
            held = (after, _document(after))
            for c in _changes(start, held[1], key):
                paths.append(c["path"])
                ops.append(c["op"])
                olds.append(c["old"])
                news.append(c["new"])
        starts.append(len(paths))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in columns.values()], list(columns)))


def json_diff(df: DataFrame, before: str, after: str, array_keys: dict[str, str] | Column | None = None) -> DataFrame:
    """Add ``changes``: what turns ``before`` into ``after``, in depth-first order.

    Both are JSON text; NULL counts as absent and malformed text as NULL. A new key is one add of its subtree, a dropped
    key one remove, a scalar or type change one change; equal documents have no changes. Arrays compare by position, or
    by ``array_keys[path]`` where every element has a distinct scalar key; ``array_keys`` may be a map column. The
    operator is narrow: each document is parsed once, in Arrow batches of the two columns only, and a plan that does not
    use ``changes`` does not compute them.
    """
    with_package(df.sparkSession)
    if isinstance(array_keys, Column):

        @F.arrow_udf(CHANGES)
        def by_row(a: pa.Array, b: pa.Array, keys: pa.Array) -> pa.Array:
            return _lists(values(a), values(b), (dict(k) if k else None for k in keys.to_pylist()))

        return df.withColumn("changes", by_row(before, after, array_keys))

    @F.arrow_udf(CHANGES)
    def diff(a: pa.Array, b: pa.Array) -> pa.Array:
        return _lists(values(a), values(b), repeat(array_keys))

    return df.withColumn("changes", diff(before, after))


def table_diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per changed column of a keyed table: key, path, op, old, new as text. A row on one side only gives adds or
    removes of its non-null columns; one shuffle on the key."""
    o = old.select(*key, F.struct(*columns).alias("_o"))
    n = new.select(*key, F.struct(*columns).alias("_n"))
    parts = []
    for c in columns:
        a, b = F.col(f"_o.{c}").cast("string"), F.col(f"_n.{c}").cast("string")
        op = F.when(F.col(f"_o.{c}").isNull(), "add").when(F.col(f"_n.{c}").isNull(), "remove").otherwise("change")
        parts.append(F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), F.struct(F.lit(c).alias("path"), op.alias("op"), a.alias("old"), b.alias("new"))))
    return o.join(n, key, "full_outer").select(*key, F.explode(F.array_compact(F.array(*parts))).alias("c")).select(*key, "c.*")

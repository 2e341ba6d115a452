"""Applying change lists to documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histspark.functions import jsonvalue as J
from histspark.operators.fold import values
from histspark.session import with_package


def _applied(state: str | None, changes: list | None) -> dict:
    try:
        return {"applied": J.dumps(J.apply(J.loads(state) if state is not None else {}, changes, fresh=False)), "code": None}
    except J.ApplyError as e:
        return {"applied": None, "code": e.code}
    except (ValueError, TypeError):
        return {"applied": None, "code": "malformed"}


def json_apply(df: DataFrame, state: str = "state", changes: str = "changes") -> DataFrame:
    """Add ``applied`` (canonical text) and ``apply_error`` (path_not_found, type_mismatch, unknown_op; malformed where the
    state or a value is not JSON); narrow, in Arrow batches. NULL state counts as the empty object, NULL changes as none."""
    with_package(df.sparkSession)

    @F.arrow_udf("applied string, code string")
    def run(states: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([_applied(s, c) for s, c in zip(values(states), values(lists), strict=True)], pa.struct([("applied", pa.string()), ("code", pa.string())]))

    return df.withColumn("_applied", run(state, changes)).withColumns({"applied": F.col("_applied.applied"), "apply_error": F.col("_applied.code")}).drop("_applied")


def apply_flat(state: Column, changes: Column) -> Column:
    """The map<string,string> state after changes of top-level scalar keys; native."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def one(acc: Column, c: Column) -> Column:
        rest = F.map_filter(acc, lambda k, _: k != c["path"])
        return F.when(c["op"] == "remove", rest).otherwise(F.map_concat(rest, F.create_map(c["path"], c["new"])))

    return F.aggregate(changes, F.coalesce(state, empty), one)

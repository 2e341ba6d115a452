"""Columns of the fold: what is turned to Python, and how."""

from __future__ import annotations

import pyarrow as pa

from histspark.functions import jsonvalue as J
from histspark.operators import fold


def test_fold_takes_columns_over(spark):
    """Columns that a step does not read never become Python values, and come out as they went in."""
    df = spark.createDataFrame([(k, i, f"x{k}{i}" if i % 3 else None) for k in "ab" for i in range(9000)], "k string, i long, note string")

    def step(seen, row):
        assert "note" not in row
        seen.append(row["i"])
        return [{"n": len(seen)}] * (row["i"] % 3)

    out = fold.sorted_fold(df, ["k"], ["i"], list, step, "n long, note string, k string", taken=("k", "note"), unread=("note",))
    want = sorted((i + 1, f"x{k}{i}", k) for k in "ab" for i in range(9000) for _ in range(i % 3))
    assert sorted(map(tuple, out.collect())) == want


def test_values_of_columns():
    kind = pa.list_(pa.struct([("path", pa.string()), ("n", pa.int64())]))
    rows = [[{"path": "a", "n": 1}, {"path": None, "n": None}], None, [], [None, {"path": "b", "n": 2}]]
    assert fold.values(pa.array(rows, kind)) == rows and fold.values(pa.array(rows, kind).slice(1, 3)) == rows[1:]
    assert fold.values(pa.array(["x", None, ""])) == ["x", None, ""] and fold.values(pa.array([1, None])) == [1, None]
    assert J.dumps(True) == "true" and J.dumps(10**20) == str(10**20) and J.dumps({"e1": 1e-7}) == '{"e1":1e-7}'

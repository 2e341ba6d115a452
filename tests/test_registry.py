"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from histspark.plans import registry

from .conftest import SMALL


def _cells(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _cells(got) == _cells(want)


def test_entry(spark):
    assert registry.entry(spark, SMALL).count() > 0


def test_plans_have_no_nested_loops(spark):
    for name in ("state_at_flat", "resolve_version", "ingest_states", "match_rules", "verify_chain"):
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["stream_ingest", "stream_snapshots", "stream_rules", "stream_dedup"])
def test_streams_read_tables_of_part_files(spark, tmp_path, name):
    rows = spark.read.parquet(f"{SMALL}/events.parquet").limit(300)
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next((tmp_path / "one").glob("part-*.parquet"))
    (tmp_path / "single").mkdir()
    part.rename(tmp_path / "single" / "events.parquet")
    spark.read.parquet(str(tmp_path / "single")).repartition(3).write.parquet(str(tmp_path / "parts" / "events.parquet"))
    single, parts = (registry.QUERIES[name](spark, str(tmp_path / d)).toPandas() for d in ("single", "parts"))
    assert len(parts) > 0 and _cells(parts) == _cells(single)

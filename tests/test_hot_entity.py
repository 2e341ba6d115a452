"""An entity of very many commands in the window form."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from histspark.operators import ingest
from histspark.schemas import CHANGES, KEY


def _commands(spark, rows):
    blank = ", ".join(f"{c} string" for c in ("op", "author", "source", "event_id", "request_id", "meta"))
    full = [("t", "c", e, "delete" if s is None else "state", None, None, None, None, None, None, s, at, at) for e, s, at in rows]
    df = spark.createDataFrame(full, f"tenant string, collection string, entity_id string, kind string, {blank}, state string, seq long, at long")
    return df.withColumns({"ts_received": F.timestamp_seconds("at"), "ts_source": F.timestamp_seconds("at"), "expected_version": F.lit(None).cast("long"), "changes": F.lit(None).cast(CHANGES)})


def test_hot_entity_in_blocks(spark, monkeypatch):
    """An entity of very many commands is cut into blocks: the same events and rejects as in one window and in the fold,
    with no-ops, deletes, empty states and rejects wherever a block begins, with and without stored rows."""
    rng = random.Random(7)
    pick = lambda: rng.choice([None, "{}", "{}", '{"a":1}', '{"a":1}', '{"a":2}', "{", '{"b":[1]}'])
    cmds = _commands(spark, [(rng.choice(["hot", "hot", "hot", "warm", "x", "y"]), pick(), i) for i in range(600)]).cache()
    held = ingest.build_current(ingest.ingest_states(cmds.where("at < 50")).where("code is null"))
    names = ["entity_id", "seq", "code", "version", "op"]
    rows = lambda df, *more: sorted(map(str, df.select(*names, *more).collect()))
    for current, given in ((None, cmds), (held, cmds.where("at >= 50"))):
        want = rows(ingest.ingest_states(given, current), "base", "state", "changes")
        with monkeypatch.context() as m:
            m.setattr(ingest, "HOT", 80)
            assert {r["entity_id"] for r in ingest.hot_entities(given).collect()} >= {"hot"}
            blocked = ingest.ingest_states(given, current)
            assert rows(blocked, "base", "state", "changes") == want
        assert rows(blocked.where("code is null")) == rows(ingest.ingest(given, current).where("code is null"))
    parts = ingest._kept_rows_of_hot(ingest._parsed(cmds), None)
    sizes = parts.where("entity_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and set(KEY) <= set(parts.columns)

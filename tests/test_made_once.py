"""What is read several times is made once."""

from __future__ import annotations

from pyspark.sql import functions as F

from histspark.operators import asof
from histspark.plans import registry
from histspark.schemas import CHANGES


def test_probes_are_made_once(spark):
    """Each probe is made one time, however often the read looks at the probes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(entity):
        seen.add(1)
        return entity

    own = [F.lit("t").alias("tenant"), F.lit("c").alias("collection"), F.col("id").cast("string").alias("entity_id")]
    events = spark.range(6).select(*own, F.lit(1).cast("long").alias("version"), F.lit("2024-01-01").cast("timestamp").alias("ts_received"), F.lit("create").alias("op"), F.expr("""array(named_struct('path', 'a', 'op', 'add', 'old', cast(null as string), 'new', '1'))""").cast(CHANGES).alias("changes"))
    probes = spark.range(5).select(*own, F.lit(1).cast("long").alias("version")).withColumn("entity_id", counted("entity_id"))
    out = asof.state_at(probes, events).collect()
    assert len(out) == 5 and {r["state"] for r in out} == {'{"a":1}'} and seen.value == 5


def test_both_batches_read_what_is_stored(spark, monkeypatch):
    """Neither of the two appended batches makes the events' changes anew."""
    append, plans = registry.tables.append_events, []

    def watched(events, path):
        plans.append(events._jdf.queryExecution().optimizedPlan().toString())
        append(events, path)

    monkeypatch.setattr(registry.tables, "append_events", watched)
    assert registry.QUERIES["read_events"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 2 and not any("EvalPython" in p for p in plans)

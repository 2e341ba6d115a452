"""Rules of one key: what they have in common is tested once."""

from __future__ import annotations

from pyspark.sql import functions as F

from histspark.operators import rule_index, rules
from histspark.schemas import CHANGES


def test_rules_of_a_key_share_their_test(spark):
    """What 300 rules of an author require alike is tested once, what the key implies not at all; the rows are the same."""
    f = lambda name, op, value: {"field": name, "op": op, "value": value}
    made = [{"id": str(i), "condition": {"any": [f("entity_id", "eq", i), {"all": [f("author_id", "eq", 3), f("source", "eq", "s"), f("entity_id", "gte", 5)]}]}, "actions": [{"type": "log"}]} for i in range(300)]
    index, commons, owns, numbers = rule_index._index(made)
    of_author = [r for r in index if r[0] == "author"]
    assert len(of_author) == 1 and len(of_author[0][3]) == 300 and of_author[0][2][1:] == (["s"], [5.0], [])
    assert all(not any(e[1:4]) for r in index if r[0] == "entity_id" for e in r[3]) and numbers == {"entity_id"}
    events = spark.range(40).select(
        F.lit("t").alias("tenant"), F.lit("c").alias("collection"), F.col("id").cast("string").alias("entity_id"), F.lit(1).cast("long").alias("version"), F.lit("update").alias("op"),
        (F.col("id") % 5).cast("string").alias("author"), F.when(F.col("id") % 3 > 0, "s").alias("source"), F.lit(None).cast(CHANGES).alias("changes"))
    rows = lambda df: sorted((r["entity_id"], r["rule_id"]) for r in df.collect())
    assert rows(rule_index.match_rules_indexed(events, made)) == rows(rules.match_rules(events, made))

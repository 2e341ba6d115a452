"""Causal flows: nodes of activities and events, edges, summaries and lineage."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histspark.functions.jsonx import decode_cursor
from histspark.session import shared_dir

_NODE = ["tenant", "flow_id", "kind", "node_id", "ts", "collection", "entity_id", "version", "event_id", "activity_id", "type", "step", "caused_by"]


def valid_flow_refs(refs: Column | str) -> Column:
    """Whether every reference names an activity, or a collection and an entity."""
    c = F.col(refs) if isinstance(refs, str) else refs
    filled = lambda v: F.coalesce(v, F.lit("")) != ""
    return F.coalesce(F.forall(c, lambda r: filled(r["activity_id"]) | (filled(r["collection"]) & filled(r["entity_id"]))), F.lit(True))


def event_node_id(collection: Column, entity: Column, version: Column) -> Column:
    """Text id of an event node; ordered as text."""
    return F.concat_ws("/", collection, entity, version.cast("string"))


def flow_nodes(activities: DataFrame, events: DataFrame) -> DataFrame:
    """Activities and flow events in one shape."""
    a = activities.where("flow_id is not null").select(
        "tenant", "flow_id", F.lit("activity").alias("kind"), F.col("activity_id").alias("node_id"), F.col("ts_received").alias("ts"), "activity_id", "type", "caused_by"
    )
    e = events.where("flow.id is not null").select(
        "tenant", F.col("flow.id").alias("flow_id"), F.lit("event").alias("kind"), event_node_id(F.col("collection"), F.col("entity_id"), F.col("version")).alias("node_id"),
        F.col("ts_received").alias("ts"), "collection", "entity_id", "version", "event_id", F.col("flow.step").alias("step"), F.col("flow.caused_by").alias("caused_by"),
    )
    return a.unionByName(e, allowMissingColumns=True).select(*_NODE)


def node_order(nodes: DataFrame) -> Column:
    """The text that orders nodes of equal time: activities first, by id; then events by collection, entity and version
    (as text)."""
    event = F.concat_ws("|", F.lit("e"), F.col("collection"), F.col("entity_id"), F.col("version").cast("string"))
    return F.when(F.col("kind") == "activity", F.concat(F.lit("a|"), F.col("activity_id"))).otherwise(event)


def assemble_flow(nodes: DataFrame, flow_id: str | None = None) -> DataFrame:
    """Nodes with their place in the flow, by receive time and then ``node_order``; of one flow or of all."""
    rows = nodes if flow_id is None else nodes.where(F.col("flow_id") == flow_id)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("tenant", "flow_id").orderBy("ts", node_order(nodes))))


def flow_page(nodes: DataFrame, flow_id: str, after: str | None = None, limit: int = 100) -> DataFrame:
    """A page of one flow strictly after a cursor (ts, id), where id is a node's ``node_order``; one row more than
    ``limit`` tells that more follow."""
    rows = nodes.where(F.col("flow_id") == flow_id)
    order = node_order(nodes)
    if after:
        at = decode_cursor(after)
        ts = F.lit(datetime.fromisoformat(at["ts"]))
        rows = rows.where((F.col("ts") > ts) | ((F.col("ts") == ts) & (order > at["id"])))
    return rows.orderBy("ts", order).limit(limit + 1)


def _joined(refs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    return refs.join(targets, ["tenant", *keys], "left").select("tenant", "flow_id", "child", "place", "cause")


def flow_edges(nodes: DataFrame) -> DataFrame:
    """child -> cause edges: tenant, flow_id, child, place, cause (node id or NULL), dangling. A reference has one of three
    shapes (activity, entity and version, entity and event id); each shape is joined on its own keys only, so no join
    meets rows without a key. The target may lie in any flow of the tenant."""
    refs = nodes.select("tenant", "flow_id", F.col("node_id").alias("child"), F.posexplode("caused_by").alias("place", "r")).select("tenant", "flow_id", "child", "place", "r.*")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    shape = F.when(filled("activity_id"), "activity").when(filled("entity_id") & F.col("version").isNotNull(), "version").when(filled("entity_id") & filled("event_id"), "event").otherwise("none")
    refs = refs.withColumn("_shape", shape)
    events = nodes.where("kind = 'event'").withColumnRenamed("node_id", "cause")
    by_activity = nodes.where("kind = 'activity'").select("tenant", "activity_id", F.col("node_id").alias("cause")).distinct()
    parts = [
        _joined(refs.where("_shape = 'activity'"), by_activity, ["activity_id"]),
        _joined(refs.where("_shape = 'version'"), events.select("tenant", "collection", "entity_id", "version", "cause"), ["collection", "entity_id", "version"]),
        _joined(refs.where("_shape = 'event'"), events.where("event_id is not null").select("tenant", "collection", "entity_id", "event_id", "cause"), ["collection", "entity_id", "event_id"]),
        refs.where("_shape = 'none'").select("tenant", "flow_id", "child", "place", F.lit(None).cast("string").alias("cause")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.withColumn("dangling", F.col("cause").isNull())


def flow_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per flow: nodes, events, activities, first and last time, roots (no causes), dangling edges."""
    n = nodes.groupBy("tenant", "flow_id").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("kind") == "event").alias("events"), F.count_if(F.col("kind") == "activity").alias("activities"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.coalesce(F.size("caused_by"), F.lit(0)) <= 0).alias("roots"),
    )
    d = edges.groupBy("tenant", "flow_id").agg(F.count_if("dangling").alias("dangling"))
    return n.join(d, ["tenant", "flow_id"], "left").withColumn("dangling", F.coalesce("dangling", F.lit(0)))


def flow_lineage(edges: DataFrame, depth: int = 3) -> DataFrame:
    """(tenant, node, ancestor, distance) within ``depth`` steps; each level is distinct, so cycles end."""
    step = edges.where("cause is not null").select("tenant", F.col("child").alias("node"), F.col("cause").alias("ancestor")).distinct()
    level = step.withColumn("distance", F.lit(1))
    out = level
    for d in range(2, depth + 1):
        up = step.select("tenant", F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        level = level.join(up, ["tenant", "ancestor"]).select("tenant", "node", F.col("further").alias("ancestor")).distinct().withColumn("distance", F.lit(d))
        out = out.unionByName(level)
    return out.groupBy("tenant", "node", "ancestor").agg(F.min("distance").alias("distance"))


def flow_closure(edges: DataFrame) -> DataFrame:
    """(tenant, node, ancestor, distance, cycle): every ancestor of every node, at any depth, with the fewest steps to it;
    ``cycle`` marks a node that is its own ancestor.

    Paths double: after round k all pairs within 2^k steps are known, and the pairs of exactly 2^k steps, met with what lies
    above their ancestors, give those within 2^(k+1). A chain of 1,000 takes ten rounds. Only the newest half of the pairs is
    joined, each round is written to the shared folder, and it ends when no pair is 2^k steps long.

    Where every node has one cause and no cycle has shown, a round cannot give a pair twice or one that is known, so nothing
    is grouped or compared: the known pairs are shuffled once a round. A round that shows a cycle is made again in full.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/closure-{uuid.uuid4().hex}"
    keys = ["tenant", "node", "ancestor"]
    edges.where("cause is not null").select("tenant", F.col("child").alias("node"), F.col("cause").alias("ancestor")).distinct().withColumn("distance", F.lit(1)).write.parquet(f"{folder}/0")
    rounds, reach = [f"{folder}/0"], 1
    first = spark.read.parquet(f"{folder}/0")
    single = first.where("node = ancestor").isEmpty() and first.groupBy("tenant", "node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    while True:
        known = spark.read.parquet(*rounds)
        ends = spark.read.parquet(rounds[-1]).where(F.col("distance") == reach)
        if ends.isEmpty():
            return known.withColumn("cycle", F.col("node") == F.col("ancestor"))
        above = known.select("tenant", F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        met, target = ends.join(above, ["tenant", "ancestor"]), f"{folder}/{len(rounds)}"
        if single:
            met.select("tenant", "node", F.col("further").alias("ancestor"), (F.col("more") + reach).alias("distance")).write.parquet(target)
            single = spark.read.parquet(target).where("node = ancestor").isEmpty()
            target = target if single else f"{target}-again"
        if not single:
            longer = met.groupBy("tenant", "node", F.col("further").alias("ancestor")).agg((F.min("more") + reach).alias("distance"))
            longer.join(known.select(*keys), keys, "left_anti").write.parquet(target)
        rounds.append(target)
        reach *= 2


def flows_of_entity(activities: DataFrame) -> DataFrame:
    """Reverse lookup: (tenant, collection, entity_id, flow_id) pairs that activities refer to."""
    r = activities.select("tenant", "flow_id", F.explode("refs").alias("r"))
    return r.select("tenant", "r.collection", "r.entity_id", "flow_id").where("entity_id is not null").distinct()

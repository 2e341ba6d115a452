"""Collection catalog, configuration, and pipeline statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histspark.functions.jsonx import mask_names
from histspark.session import shared_dir

# Config enums and defaults.
MODES = ("strict", "durable", "fast")
FIRST_OPS = ("create", "update")
ORDERINGS = ("received", "source")
RETENTIONS = ("forever", "days", "versions")
DEFAULTS = {"reliability_mode": "durable", "first_event_op": "create", "ordering_mode": "received", "snapshot_interval": 100, "retention_type": "forever", "max_event_size_bytes": 1 << 20}


def _unset(name: str) -> Column:
    empty = F.col(name) == ("" if isinstance(DEFAULTS[name], str) else 0)
    return F.col(name).isNull() | empty


def effective_config(config: DataFrame) -> DataFrame:
    """Config with unset fields filled (empty text and 0 are unset), and ``defaulted``: the names filled."""
    names = F.array_compact(F.array(*[F.when(_unset(n), F.lit(n)) for n in DEFAULTS]))
    return config.withColumn("defaulted", names).withColumns({n: F.when(_unset(n), F.lit(v)).otherwise(F.col(n)) for n, v in DEFAULTS.items()})


def validate_config(config: DataFrame) -> DataFrame:
    """``invalid_field``: the first field that fails, or NULL."""
    wrong = lambda name, values: (F.coalesce(F.col(name), F.lit("")) != "") & ~F.coalesce(F.col(name).isin(*values), F.lit(True))
    field = (
        F.when(wrong("reliability_mode", MODES), "reliability_mode").when(wrong("first_event_op", FIRST_OPS), "first_event_op").when(wrong("ordering_mode", ORDERINGS), "ordering.mode")
        .when(wrong("retention_type", RETENTIONS), "retention.type").when(F.col("snapshot_interval") < 0, "snapshot_interval").when(F.col("max_event_size_bytes") < 0, "max_event_size_bytes")
    )
    return config.withColumn("invalid_field", field)


def config_audit(old: DataFrame, new: DataFrame, kind: str = "collection", key: str = "name", actor: str | None = None, at=None) -> DataFrame:
    """Audit rows of a change of configs or rules (``kind`` "rule", ``key`` "id"): action (kind.created, .updated,
    .deleted), target, actor, ts, old and new (JSON text of the row; NULL where there is none). A row that stays equal
    makes no audit row."""
    text = lambda df: F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    a, b = old.select(key, text(old).alias("old")), new.select(key, text(new).alias("new"))
    verb = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "updated")
    stamp = F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()
    out = a.join(b, key, "full_outer").select(F.concat(F.lit(kind + "."), verb).alias("action"), F.col(key).alias("target"), F.lit(actor).cast("string").alias("actor"), stamp.alias("ts"), "old", "new")
    return out.where("action is not null")


def collection_names(events: DataFrame, config: DataFrame) -> DataFrame:
    """Names in use or configured; system names (leading underscore) are left out."""
    return events.select(F.col("collection").alias("name")).union(config.select("name")).distinct().where(~F.col("name").startswith("_"))


def collection_stats(events: DataFrame, current: DataFrame, config: DataFrame) -> DataFrame:
    """Per collection: entities (deleted ones included), events, last stored time; zeros where empty."""
    e = events.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("events"), F.max("ts_stored").alias("last_event_at"))
    c = current.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("entities"))
    names = collection_names(events.select("collection").distinct(), config)
    return names.join(e, "name", "left").join(c, "name", "left").select("name", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("events", F.lit(0)).alias("events"), "last_event_at")


def catalog(stats: DataFrame, config: DataFrame) -> DataFrame:
    """Statistics with the effective config of each name."""
    bare = stats.join(config, "name", "left")
    return effective_config(bare)


def dlq_counts(dlq: DataFrame) -> DataFrame:
    """Dead letters per rule, per tenant and in all (rollup; NULL marks a total)."""
    return dlq.rollup("tenant", "rule_id").agg(F.count("*").alias("n"))


def accept_counts(accepted: DataFrame) -> DataFrame:
    """Accepted events by tenant and mode."""
    return accepted.groupBy("tenant", "mode").agg(F.count("*").alias("n"))


def rule_match_counts(matches: DataFrame) -> DataFrame:
    """Firings by tenant and action type."""
    return matches.groupBy("tenant", "type").agg(F.count("*").alias("n"))


#: Upper bounds (seconds) of the duration histogram.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def delivery_stats(attempts: DataFrame, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Attempts by result with a cumulative duration histogram and retries (attempts after the first)."""
    bins = [F.count_if(F.col("seconds") <= b).alias("le_" + f"{b:g}".replace(".", "_")) for b in buckets]
    return attempts.groupBy("result").agg(F.count("*").alias("n"), F.count_if(F.col("attempt") > 0).alias("retries"), *bins)


#: Size parameter of stored quantile sketches.
SKETCH_K = 400


def latency_percentiles(rows: DataFrame, column: str, *keys: str, exact: bool = False) -> DataFrame:
    """p50 and p99 of a column, by a mergeable sketch; the exact form keeps a group's distinct values in one task."""
    f = F.percentile if exact else F.percentile_approx
    return rows.groupBy(*keys).agg(f(column, F.lit(0.5)).alias("p50"), f(column, F.lit(0.99)).alias("p99"))


def latency_sketches(rows: DataFrame, column: str, at: str, *keys: str, window: str = "1 hour", k: int = SKETCH_K) -> DataFrame:
    """Sketches to store: (keys, start, n, low, high, sketch) per window of ``at``, KLL sketches of the column's values.
    Null and NaN values are left out. Merged sketches know quantiles of any range of windows without the rows; a sketch of k = 400 is
    within 1% of rank and takes a few kilobytes whatever it has seen."""
    value = F.col(column).cast("double")
    held = rows.where(value.isNotNull() & ~F.isnan(value)).groupBy(*keys, F.window(at, window).alias("_w"))
    return held.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch")).select(*keys, F.col("_w.start").alias("start"), "n", "low", "high", "sketch")


def sketched_percentiles(sketches: DataFrame, *keys: str, since=None, until=None, ranks: tuple[float, ...] = (0.5, 0.99), k: int = SKETCH_K) -> DataFrame:
    """(keys, n, low, high, p50, p99, ...) from stored sketches alone, of the windows that start in [since, until)."""
    rows = sketches
    if since is not None:
        rows = rows.where(F.col("start") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("start") < F.lit(until))
    merged = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    return merged.select(*keys, "n", "low", "high", *[F.kll_sketch_get_quantile_double("_s", F.lit(r)).alias(f"p{r * 100:g}".replace(".", "_")) for r in ranks])


def lag_report(messages: DataFrame) -> DataFrame:
    """Last lag per queue in seconds from enqueue to store, not below 0; rows without a stamp are left out."""
    lag = F.greatest((F.unix_micros("stored_at") - F.unix_micros("enqueued_at")) / 1e6, F.lit(0.0))
    return messages.where("enqueued_at is not null and stored_at is not null").groupBy("queue").agg(F.max_by(lag, "stored_at").alias("lag_s"))


def backlog(published: DataFrame, acked: DataFrame) -> DataFrame:
    """Messages published and not acknowledged, per queue (0 where all are)."""
    open_ = published.join(acked.select("queue", "id").distinct(), ["queue", "id"], "left_anti").groupBy("queue").agg(F.count("*").alias("depth"))
    return published.select("queue").distinct().join(open_, "queue", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "total", block: int = 500_000) -> DataFrame:
    """Adds the running sum of ``value`` per ``keys`` by ``order`` (unique within a key; null keys are a key, null values
    count 0).

    Rows are sorted into blocks of about ``block`` rows by range of (keys, order) and written to the shared folder with
    their block. Block totals, of which there are few, are summed once; each block then adds what lies before it to its own
    running sum. No task sees more than a block of a key, however many rows it has.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // block))
    path = f"{shared_dir(spark)}/prefix-{uuid.uuid4().hex}"
    value_of = F.coalesce(F.col(value), F.lit(0))
    rows.repartitionByRange(parts, *keys, *order).withColumn("_block", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)
    totals = cut.groupBy(*keys, "_block").agg(F.sum(value_of).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn("_in", F.sum(value_of).over(within)).join(offsets, same).select(*rows.columns, (F.col("_before") + F.col("_in")).alias(name))


def depth_over_time(published: DataFrame, acked: DataFrame, block: int = 500_000) -> DataFrame:
    """(queue, at, id, step, depth): open messages of a queue after each publish (step 1) and acknowledgement (step -1), by
    time, then step (publishes first), then id. Rows have queue, at and id."""
    steps = published.select("queue", "at", "id", F.lit(1).alias("step")).unionByName(acked.select("queue", "at", "id", F.lit(-1).alias("step")))
    return prefix_sums(steps.withColumn("_order", -F.col("step")), ["queue"], ["at", "_order", "id"], "step", "depth", block).drop("_order")


def usage_by_tenant(usage: DataFrame) -> DataFrame:
    return usage.groupBy("tenant", "op").agg(F.sum("n").alias("n"))


def activity_by(events: DataFrame, *columns: str) -> DataFrame:
    """Event counts along history's filterable columns, with all sub-totals (cube; NULL marks a total)."""
    return events.cube(*columns).agg(F.count("*").alias("n"))


def _held(sums: DataFrame, over: Column, slide: str, held: int) -> DataFrame:
    """Adds ``firing``: ``over`` held at this evaluation and at the ``held - 1`` before it, by time; an evaluation without
    data does not hold."""
    step = f"INTERVAL {slide}"
    back = (F.unix_timestamp(F.lit("2000-01-01").cast("timestamp") + F.expr(step)) - F.unix_timestamp(F.lit("2000-01-01").cast("timestamp"))) * (held - 1)
    held_at = sums.withColumn("_over", F.coalesce(over, F.lit(False)))
    w = Window.partitionBy("name").orderBy(F.unix_timestamp("at"))
    # the held - 1 evaluations before are the rows before only where none is missing between
    first = F.lag("at", held - 1).over(w) if held > 1 else F.col("at")
    run = F.min(F.col("_over").cast("int")).over(w.rowsBetween(-(held - 1), Window.currentRow))
    return held_at.withColumn("firing", F.coalesce((run == 1) & (F.unix_timestamp("at") - F.unix_timestamp(first) == back), F.lit(False))).drop("_over")


def alert_rules(metrics: DataFrame, threshold: float, window: str = "5 minutes", slide: str = "1 minute", held: int = 3) -> DataFrame:
    """(name, at, total, firing): the sum over a trailing window exceeds the threshold, at ``held`` evaluations on end."""
    sums = metrics.groupBy("name", F.window("ts", window, slide)).agg(F.sum("value").alias("total")).select("name", F.col("window.end").alias("at"), "total")
    return _held(sums, F.col("total") > threshold, slide, held)


def ratio_alerts(metrics: DataFrame, bad: str, good: str, window: str = "10 minutes", slide: str = "1 minute", held: int = 10) -> DataFrame:
    """(name, at, bad, good, firing): results ``bad`` outnumber results ``good`` in a trailing window (failed against
    delivered), at ``held`` evaluations on end. ``metrics`` has name, result, ts, value."""
    total = lambda r: F.coalesce(F.sum(F.when(F.col("result") == r, F.col("value"))), F.lit(0))
    sums = metrics.groupBy("name", F.window("ts", window, slide)).agg(total(bad).alias("bad"), total(good).alias("good")).select("name", F.col("window.end").alias("at"), "bad", "good")
    return _held(sums, F.col("bad") > F.col("good"), slide, held)


def shown_to(rows: DataFrame, masks: DataFrame, reader: str = "reader") -> DataFrame:
    """``rows`` (with ``collection``) that each reader may see, by a table of masks (reader, pattern): one row for each
    reader and row, with the reader's column. Names are turned to the patterns that show them and joined on equality, once
    for each distinct name, so any number of patterns costs one equi-join."""
    names = rows.select("collection").distinct().select("collection", F.explode(mask_names("collection")).alias("pattern"))
    seen = names.join(masks.select(reader, "pattern").distinct(), "pattern").select("collection", reader).distinct()
    return rows.join(seen, "collection")

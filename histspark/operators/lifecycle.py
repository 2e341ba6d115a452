"""Retention and purge: what stays and goes, and rewrites of stored logs that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histspark.operators.asof import of_asked, state_at
from histspark.schemas import EVENTS, KEY, SNAPSHOTS
from histspark.sources.tables import PARTITIONS, exists, remove, stored, upsert_snapshots


def apply_retention(events: DataFrame, config: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(kept events, dropped events) under each collection's policy: forever; days: received within N days; versions: the
    N newest of each entity. Config rows: name, retention_type, retention_value; a value that is unset (NULL or below 1)
    keeps everything, as does a row without a time. The snapshots of ``cut_snapshots`` have to
    be written before the rewrite; reads above the cut start from them.

    Versions are ranked only where some policy counts them; else no event is shuffled or sorted here."""
    cfg = config.select(F.col("name").alias("collection"), "retention_type", "retention_value")
    counts = not config.where("retention_type = 'versions' and retention_value >= 1").isEmpty()  # settings
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("version").desc())) if counts else F.lit(1)
    rows = events.join(cfg, "collection", "left").withColumn("_newest", newest)
    age_ok = F.col("ts_received") >= F.lit(now) - F.make_interval(days=F.col("retention_value").cast("int"))
    keep = F.when(F.col("retention_type") == "days", age_ok).when(F.col("retention_type") == "versions", F.col("_newest") <= F.col("retention_value")).otherwise(F.lit(True))
    keep = F.coalesce(keep, F.lit(True)) | ~F.coalesce(F.col("retention_value") >= 1, F.lit(False))
    marked = rows.withColumn("_keep", keep).drop("retention_type", "retention_value", "_newest")
    return marked.where("_keep").drop("_keep"), marked.where("not _keep").drop("_keep")


def cut_versions(dropped: DataFrame) -> DataFrame:
    """(key, version): the version whose state must be kept as a snapshot so that reads above it still work."""
    return dropped.groupBy(*KEY).agg(F.max("version").alias("version"))


def cut_snapshots(events: DataFrame, dropped: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Snapshot rows (key, version, ts, deleted, state) at each entity's cut, made from the events before the rewrite."""
    return _snapshots_at(cut_versions(dropped), events, snapshots)


def _snapshots_at(cuts: DataFrame, events: DataFrame, snapshots: DataFrame | None) -> DataFrame:
    probes = cuts.withColumn("at", F.lit(None).cast("timestamp"))
    return state_at(probes, events, snapshots).select(*KEY, "version", "ts", "deleted", "state")


def purge_entities(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of all other entities; works on any table with the entity key."""
    return rows.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def tombstones(events: DataFrame, keys: DataFrame, at) -> DataFrame:
    """Audit rows of purged entities: action, target, at, events removed."""
    gone = events.join(keys.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("events"))
    return gone.select("tenant", F.lit("entity.purged").alias("action"), F.concat_ws("/", "collection", "entity_id").alias("target"), F.lit(at).alias("at"), "events")


def _swap(spark: SparkSession, path: str, staged: str, touched: DataFrame) -> None:
    """Put the staged partitions in place of the stored ones; partitions of which nothing is left are removed."""
    left = spark.read.schema(EVENTS).parquet(staged)
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    gone = touched.join(left.select(*PARTITIONS).distinct(), PARTITIONS, "left_anti")
    for r in gone.collect():  # partitions: settings, not data
        remove(spark, f"{path}/" + "/".join(f"{c}={r[c]}" for c in PARTITIONS))


def _rewritten(spark: SparkSession, path: str, run: str, plan) -> None:
    """Two phases under ``{path}.rewrites/{run}``: what stays of the touched partitions is staged whole, then swapped in. A
    repeat after a failure goes on where it was: an unfinished stage is written again, a finished one is swapped again."""
    home = f"{path}.rewrites/{run}"
    if not exists(spark, f"{home}/events/_SUCCESS"):
        touched, kept = plan()
        touched.write.mode("overwrite").parquet(f"{home}/touched")
        touched = spark.read.schema(touched.schema).parquet(f"{home}/touched")
        kept.join(F.broadcast(touched), PARTITIONS, "left_semi").select(*spark.read.schema(EVENTS).parquet(path).columns).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{home}/events")
    _swap(spark, path, f"{home}/events", spark.read.parquet(f"{home}/touched"))
    remove(spark, home)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def retain_stored(spark: SparkSession, path: str, snapshots: str, config: DataFrame, now, run: str) -> None:
    """Cut a stored log (``append_events``) by its collections' policies. Snapshots at the cuts are stored first, so reads
    above a cut work at any moment; only partitions that lose events are written. ``run`` names the rewrite: a repeat of
    the same run, or another at the same ``now``, changes nothing more."""

    def plan() -> tuple[DataFrame, DataFrame]:
        policies = config.where("retention_type in ('days', 'versions') and retention_value >= 1")
        names = [r["name"] for r in policies.select("name").distinct().collect()]  # settings
        log = spark.read.schema(EVENTS).parquet(path).where(F.col("collection").isin(names))
        kept, dropped = apply_retention(log, policies, now)
        held = _stored(spark, snapshots, SNAPSHOTS)
        cuts = stored(cut_versions(dropped), "cuts")  # the log is ranked once for all that asks for the cuts
        if not cuts.isEmpty():
            upsert_snapshots(held, _snapshots_at(cuts, log, held), snapshots)
        return cuts.select(*PARTITIONS).distinct(), kept

    _rewritten(spark, path, run, plan)


def purge_stored(spark: SparkSession, path: str, keys: DataFrame, audit: str, at, run: str) -> None:
    """Remove entities from a stored log for good. Their tombstones are stored first, once; only partitions that hold any
    are written."""

    def plan() -> tuple[DataFrame, DataFrame]:
        log = spark.read.schema(EVENTS).parquet(path)
        tombstones(log, keys, at).write.mode("overwrite").parquet(f"{audit}/run={run}")
        return of_asked(log, keys.select(*KEY).distinct(), False).select(*PARTITIONS).distinct(), purge_entities(log, keys)

    _rewritten(spark, path, run, plan)

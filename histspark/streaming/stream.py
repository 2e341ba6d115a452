"""Streams: ordered ingest with state, duplicates, tickets, rules and snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histspark.operators.asof import INTERVAL, build_snapshots
from histspark.operators.delivery import delivery_outbox
from histspark.operators.ingest import dedup_event_ids, ingest, known_collections, validate_batch, with_settings
from histspark.operators.plugins import Registry
from histspark.operators.rules import match_rules
from histspark.schemas import KEY
from histspark.sources.ids import ID, add_ids, known_ids
from histspark.sources.tables import append_once, merged_current

#: What the fold reads of a command.
INPUT = ["tenant", "collection", "entity_id", "kind", "op", "expected_version", "author", "source", "ts_source", "ts_received", "seq", "event_id", "request_id", "meta", "state", "changes"]
#: What ``with_settings`` adds of it.
SETTINGS = ["first_event_op", "array_keys"]
_CURRENT = "tenant string, collection string, entity_id string, version long, ts timestamp, deleted boolean, state string"
#: Every so many batches the whole current table is written; the others write the entities they changed.
FULL = 20


def current_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The latest row per entity behind the batches before ``batch_id``: the last whole table and the changes since."""
    since = range(max(0, batch_id // FULL * FULL - 1), batch_id)
    if not since:
        return None
    rows = spark.read.schema(_CURRENT).parquet(*[f"{path}/current/batch={i}" for i in since])
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*KEY, "r.*")


def stream_ingest(batch: DataFrame, path: str, batch_id: int, first_event_op: str = "create", check_versions: bool = True) -> DataFrame:
    """Planned events and rejects of a micro-batch of commands, ordered per entity inside it: the batch fold, which
    streams sorted rows in constant memory, from the current table that the batches before left under ``path``. Settings
    that the commands carry (``with_settings``) go along."""
    return ingest(batch.select(*INPUT, *[c for c in SETTINGS if c in batch.columns]), current_before(batch.sparkSession, path, batch_id), first_event_op, check_versions)


def stream_dedup(commands: DataFrame, watermark: str = "24 hours", at: str = "ts_received") -> DataFrame:
    """Drop event ids seen within the watermark. Rows without an id pass beside the state. Repeats from further back are the
    sink's to find (``store_batch`` with ``ids``)."""
    rows = commands.withWatermark(at, watermark)
    known = rows.where("event_id is not null").dropDuplicatesWithinWatermark(["tenant", "collection", "event_id"])
    return known.unionByName(rows.where("event_id is null"))


#: Progress of a ticket; terminal ones end it.
TICKETS = {"accepted": 0, "processing": 1, "partial": 2, "stored": 3, "failed": 3}
TERMINAL = ("partial", "stored", "failed")


def ticket_status(log: DataFrame, now=None, ttl_hours: int = 24) -> DataFrame:
    """Status of each ticket from a log (ticket_id, status, at): the first terminal status, else the furthest; tickets
    whose last entry is older than the limit are gone."""
    rank = F.create_map(*[F.lit(x) for kv in TICKETS.items() for x in kv])[F.col("status")]
    rows = log.where(rank.isNotNull()).withColumn("_rank", rank)
    out = rows.groupBy("ticket_id").agg(
        F.min_by("status", F.when(F.col("status").isin(*TERMINAL), F.col("at"))).alias("_end"), F.max_by("status", "_rank").alias("_far"), F.max(F.col("status").isin(*TERMINAL)).alias("_done"), F.max("at").alias("updated_at")
    )
    out = out.select("ticket_id", F.when(F.col("_done"), F.col("_end")).otherwise(F.col("_far")).alias("status"), "updated_at")
    return out if now is None else out.where(F.col("updated_at") >= F.lit(now) - F.make_interval(hours=F.lit(ttl_hours)))


def checked(commands: DataFrame, config: DataFrame | None = None, auto_create: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects with ``code``) of a micro-batch: structure and size, and with ``config`` (one row a collection)
    unknown collections and their own size limits; accepted commands carry their collection's settings."""
    good, bad = validate_batch(commands)
    if config is None:
        return good, bad
    good, more = known_collections(good, config, auto_create)
    return with_settings(good, config), bad.unionByName(more)


def store_batch(
    path: str, rules: list[dict] | None = None, interval: int = INTERVAL, post: Callable[[DataFrame], None] | None = None,
    config: DataFrame | None = None, auto_create: bool = False, ids: bool = False, plugins: Registry | None = None, enabled: dict[str, list[str]] | None = None, **fold,
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of commands: the whole write path of a batch.

    Commands are checked (``checked``); with ``ids`` event ids stored by any batch before, or repeated in this one, are
    duplicates; the rest is folded, pre-store steps run, and events, rejects, duplicates, current rows, snapshots (each
    collection's interval, where ``config`` has one) and the outbox are written, each in the batch's own folder, so that a
    replayed batch replaces itself. Rules never fail the write: those that do not compile are skipped.
    """

    def write(commands: DataFrame, batch_id: int) -> None:
        spark = commands.sparkSession
        good, bad = checked(commands, config, auto_create)
        if ids:
            asked = good.where("event_id is not null").select(*ID).distinct()
            good, again = dedup_event_ids(good, known_ids(asked, path, batch_id))
            again.write.mode("overwrite").parquet(f"{path}/duplicates/batch={batch_id}")
        batch = stream_ingest(good, path, batch_id, **fold)
        if plugins is not None:
            batch = plugins.run_pre_store(batch, enabled or {})
            batch = batch.withColumn("code", F.coalesce("code", "reject_code")).drop("reject_code")
        batch = batch.persist()
        try:
            done = batch.where("code is null")
            append_once(done, f"{path}/events", batch_id)
            kinds = ["tenant", "collection", "entity_id", "seq", "event_id", "ts_received", "code"]
            batch.where("code is not null").select(*kinds).unionByName(bad.select(*kinds)).write.mode("overwrite").parquet(f"{path}/rejects/batch={batch_id}")
            latest = done.groupBy(*KEY).agg(F.max_by(F.struct("version", F.col("ts_received").alias("ts"), "deleted", "state"), "version").alias("r")).select(*KEY, "r.*")
            held = current_before(spark, path, batch_id) if batch_id % FULL == FULL - 1 else None
            (merged_current(held, latest) if held is not None else latest).write.mode("overwrite").parquet(f"{path}/current/batch={batch_id}")
            snapshots_of(done, interval, config).write.mode("overwrite").parquet(f"{path}/snapshots/batch={batch_id}")
            if ids:
                add_ids(good, path, batch_id)
            if rules:
                delivery_outbox(match_rules(done, rules)).write.mode("overwrite").parquet(f"{path}/outbox/batch={batch_id}")
            if plugins is not None:
                plugins.run_post_store(done)
            if post:
                post(done)
        finally:
            batch.unpersist()

    return write


def snapshots_of(events: DataFrame, interval: int = INTERVAL, config: DataFrame | None = None) -> DataFrame:
    """Snapshot rows of events with states, every ``interval`` versions or every so many as their collection says."""
    rows = events.select(*KEY, "version", F.col("ts_received").alias("ts"), "deleted", "state")
    if config is None:
        return build_snapshots(rows, interval)
    own = with_settings(rows, config)
    return own.where((F.col("snapshot_interval") > 0) & (F.col("version") % F.greatest("snapshot_interval", F.lit(1)) == 0)).select(*rows.columns)


def run_stream(commands: DataFrame, path: str, checkpoint: str, once: bool = True, every: str | None = None, **sink):
    """Start the ingest query: everything that is there (``once``), or a trigger such as ``"50 milliseconds"``."""
    writer = commands.writeStream.foreachBatch(store_batch(path, **sink)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every or "1 second")).start()


def reorder(events: DataFrame, window: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """(rows in source order inside their window, late rows) of a batch with arrival times: a row later than ``window``
    behind the newest source time that arrived before it is late."""
    w = Window.partitionBy(*KEY).orderBy("ts_received", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("_max", F.max("ts_source").over(w))
    late = F.coalesce(F.col("ts_source") < F.col("_max") - F.expr(f"interval {window}"), F.lit(False))
    marked = seen.withColumn("_late", late)
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("ts_source", "seq"))
    return marked.where("not _late").withColumn("place", place).drop("_max", "_late"), marked.where("_late").drop("_max", "_late")

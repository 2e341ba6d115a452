"""Point-in-time reads: as-of versions, snapshots, and states at versions or instants, for all entities at once."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histspark.functions import jsonvalue as J
from histspark.operators.diff import json_diff
from histspark.operators.fold import sorted_fold
from histspark.schemas import KEY
from histspark.session import with_package
from histspark.sources.tables import stored

INTERVAL = 100


#: Bytes of entity keys that go to every task at most; more are joined by shuffle on the key.
SENT_BYTES = 32 << 20
#: What a row of keys and version bounds takes beside its texts.
_ROW_BYTES = 64
#: Versions of one block: events and spans of versions meet on (entity, block).
BLOCK = 128
_FAR = datetime(9999, 12, 31)
#: What a replay reads of an event.
_LOG = [*KEY, "version", "ts_received", "op", "changes"]


def few(keys: DataFrame) -> bool:
    """Whether distinct entity keys are so few that a row for each may go to every task (measured, one small job)."""
    size = keys.agg(F.sum(sum((F.coalesce(F.octet_length(k), F.lit(0)) for k in KEY), F.lit(_ROW_BYTES)))).first()[0]
    return (size or 0) <= SENT_BYTES


def of_asked(rows: DataFrame, keys: DataFrame, sent: bool) -> DataFrame:
    """The rows of the entities in ``keys`` (distinct). Few keys are sent to the rows, so that nothing else is shuffled;
    else both sides shuffle on the key, as what follows needs anyway."""
    return rows.join(F.broadcast(keys) if sent else keys, KEY, "left_semi")


def resolve_version(probes: DataFrame, events: DataFrame, sent: bool | None = None) -> DataFrame:
    """Add ``target`` to probes (key, optional ``at`` or ``version``): by time the highest version received up to then, by
    version the smaller of it and the latest, with neither the latest; NULL where nothing is found.

    An as-of union: the asked entities' events, as (key, time, version) only, share one window with the probes, which
    pass through it whole; no range join is formed and no other entity's event is shuffled. ``sent`` says whether the
    asked keys are few, if that is known.
    """
    keys = probes.select(*KEY).distinct()
    sent = few(keys) if sent is None else sent
    at, version = (F.col(c) if c in probes.columns else F.lit(None).cast(t) for c, t in (("at", "timestamp"), ("version", "long")))
    p = probes.select(*KEY, F.coalesce(at, F.lit(_FAR)).alias("_at"), F.lit(None).cast("long").alias("_v"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_probe"))
    e = of_asked(events.select(*KEY, F.col("ts_received").alias("_at"), F.col("version").alias("_v")), keys, sent)
    e = e.withColumns({"_side": F.lit(0), "_probe": F.lit(None).cast(p.schema["_probe"].dataType)})
    w = Window.partitionBy(*KEY).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = e.unionByName(p).withColumn("_found", F.max("_v").over(w)).where("_side = 1").select("_probe.*", "_found")
    by_version = F.when(F.col("_found").isNotNull(), F.least(version, F.col("_found")))
    return out.withColumn("target", F.when(at.isNull() & version.isNotNull(), by_version).otherwise(F.col("_found"))).drop("_found")


def nearest_snapshot(targets: DataFrame, snapshots: DataFrame, sent: bool | None = None) -> DataFrame:
    """Add the greatest snapshot at or below ``target``: snapshot_version, snapshot_ts, snapshot_state, snapshot_deleted.
    Versions of the asked entities' snapshots and targets share one window; only the chosen snapshots' states are read."""
    keys = targets.select(*KEY).distinct()
    sent = few(keys) if sent is None else sent
    mine = of_asked(snapshots.select(*KEY, "version", "ts", "state", "deleted"), keys, sent)
    s = mine.select(*KEY, F.col("version").alias("target"), F.col("version").alias("_v"), F.lit(0).alias("_side"))
    asked = targets.select(*KEY, "target").distinct().select(*KEY, "target", F.lit(None).cast("long").alias("_v"), F.lit(1).alias("_side"))
    w = Window.partitionBy(*KEY).orderBy("target", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = s.unionByName(asked).withColumn("snapshot_version", F.max("_v").over(w)).where("_side = 1").select(*KEY, "target", "snapshot_version")
    chosen = mine.select(*KEY, F.col("version").alias("snapshot_version"), F.col("ts").alias("snapshot_ts"), F.col("state").alias("snapshot_state"), F.col("deleted").alias("snapshot_deleted"))
    out = targets.join(best.join(chosen, [*KEY, "snapshot_version"], "left"), [*KEY, "target"], "left")
    return out.select(*targets.columns, "snapshot_version", "snapshot_ts", "snapshot_state", "snapshot_deleted")


def build_snapshots(states: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """Rows (key, version, ts, deleted, state) of every version divisible by the interval; none for interval <= 0."""
    keep = F.lit(False) if interval <= 0 else (F.col("version") > 0) & (F.col("version") % interval == 0)
    return states.where(keep)


_STATE = "tenant string, collection string, entity_id string, version long, ts timestamp, op string, deleted boolean, state string, segment long, applied long"


class _Life:
    """State of a replay: what the next change works on, and what is shown."""

    def __init__(self):
        self.work, self.shown, self.deleted, self.applied, self.ts = {}, None, False, 0, None


def _opened(life: _Life, row: dict) -> None:
    """Start from a snapshot."""
    life.shown, life.deleted, life.ts = J.loads(row["base_state"]), row["base_deleted"], row["ts_received"]
    life.work = {} if life.deleted else life.shown


def _applied(life: _Life, row: dict) -> None:
    """One event; the life's document is its own, so it is changed in place."""
    life.applied, life.ts = life.applied + 1, row["ts_received"]
    if row["op"] == "delete":
        life.shown, life.work, life.deleted = life.work, {}, True
    else:
        life.work = J.apply(life.work, row["changes"], fresh=False)
        life.shown, life.deleted = life.work, False


def _seen(life: _Life, row: dict, op: str | None) -> dict:
    return {**{k: row[k] for k in (*KEY, "version", "segment")}, "op": op, "ts": life.ts, "deleted": life.deleted, "state": J.dumps(life.shown), "applied": life.applied}


def _replay(life: _Life, row: dict) -> list[dict]:
    """The state after every event; a snapshot row opens its segment."""
    if row["side"] == 0:
        _opened(life, row)
        return []
    _applied(life, row)
    return [_seen(life, row, row["op"])]


def _answer(life: _Life, row: dict) -> list[dict]:
    """The state at the targets: snapshot rows (side 0), events (1), targets (2)."""
    if row["side"] == 2:
        return [_seen(life, row, None)]
    (_opened if row["side"] == 0 else _applied)(life, row)
    return []


def state_history(events: DataFrame, snapshots: DataFrame | None = None, interval: int = INTERVAL) -> DataFrame:
    """The state after every version. With snapshots each (entity, segment between snapshots) is folded on its own, so a
    hot entity is replayed in parallel. The value behind a delete is the last one; a recreated entity starts from {}."""
    segment = F.floor((F.col("version") - 1) / F.lit(interval)).cast("long") if snapshots is not None else F.lit(0).cast("long")
    rows = events.select(*KEY, "version", F.lit(1).alias("side"), segment.alias("segment"), "ts_received", "op", "changes", *_none("base_state", "base_deleted"))
    if snapshots is not None:
        rows = rows.unionByName(_openings(snapshots, F.floor(F.col("version") / F.lit(interval)).cast("long"), rows))
    return sorted_fold(rows, [*KEY, "segment"], ["version", "side"], _Life, _replay, _STATE).drop("applied")


def _none(*names: str) -> list:
    types = {"ts_received": "timestamp", "base_state": "string", "base_deleted": "boolean"}
    return [F.lit(None).cast(types[n]).alias(n) for n in names]


def _openings(snapshots: DataFrame, segment, like: DataFrame) -> DataFrame:
    """Snapshot rows as the rows that open a segment of a replay."""
    return snapshots.select(
        *KEY, "version", F.lit(0).alias("side"), segment.alias("segment"), F.col("ts").alias("ts_received"), F.lit(None).cast("string").alias("op"),
        F.lit(None).cast(like.schema["changes"].dataType).alias("changes"), F.col("state").alias("base_state"), F.col("deleted").alias("base_deleted"),
    )


def tails(events: DataFrame, spans: DataFrame, sent: bool) -> DataFrame:
    """The events inside spans (key, base, upto) of versions, ends excluded and included; ``segment`` is the span's base.
    Spans of an entity do not overlap.

    Where the entities are few, one row of bounds for each goes to the log, so that events outside are dropped where they
    are read. What is left meets its span on (key, block of versions), which splits a long history.
    """
    inner = spans.where("upto > base")
    bounds = inner.groupBy(*KEY).agg(F.min("base").alias("_lo"), F.max("upto").alias("_hi"))
    near = events.select(*KEY, "version", "ts_received", "op", "changes").join(F.broadcast(bounds) if sent else bounds, KEY)
    near = near.where("version > _lo and version <= _hi").drop("_lo", "_hi").withColumn("_block", F.floor(F.col("version") / BLOCK))
    blocks = inner.select(*KEY, "base", "upto", F.explode(F.sequence(F.floor(F.col("base") / BLOCK), F.floor(F.col("upto") / BLOCK))).alias("_block"))
    return near.join(blocks, [*KEY, "_block"]).where("version > base and version <= upto").select(*KEY, "version", "ts_received", "op", "changes", F.col("base").alias("segment"))


def state_at(probes: DataFrame, events: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """State of each probe (key, ``at`` or ``version``), any number per entity: version, ts, deleted, state,
    snapshot_version (NULL: from the start) and events_applied. Probes that find nothing give no row.

    Only the asked entities are read, and of them only the events between a target's snapshot and the last target of that
    snapshot; each is replayed once, every (entity, snapshot) on its own. A shown state is made at the targets only. At a
    snapshot's own version the time is the snapshot's.
    """
    asked = [c for c in ("at", "version") if c in probes.columns]
    probes = stored(probes.select(*KEY, *asked), "asked")  # often made from the whole log, and read three times
    sent = few(probes.select(*KEY).distinct())
    # what is asked is written once: all below reads it several times, and the log only for the tails
    found = stored(resolve_version(probes, events, sent).where("target is not null").withColumnsRenamed({"at": "asked_at", "version": "asked_version"}), "probes")
    targets = found.select(*KEY, "target").distinct()
    if snapshots is not None:
        targets = stored(nearest_snapshot(targets, snapshots, sent), "targets")
    else:
        targets = targets.selectExpr("*", "cast(null as long) snapshot_version", "cast(null as timestamp) snapshot_ts", "cast(null as string) snapshot_state", "cast(null as boolean) snapshot_deleted")
    targets = targets.withColumn("base", F.coalesce("snapshot_version", F.lit(0)).cast("long"))
    spans = targets.groupBy(*KEY, "base").agg(F.max("target").alias("upto"), *[F.first(f"snapshot_{c}").alias(c) for c in ("ts", "state", "deleted")])
    rows = tails(events, spans, sent).withColumns({"side": F.lit(1), **dict(zip(("base_state", "base_deleted"), _none("base_state", "base_deleted"), strict=True))})
    opens = _openings(spans.where("base > 0").withColumn("version", F.col("base")), F.col("base"), rows)
    asks = targets.select(*KEY, F.col("target").alias("version"), F.lit(2).alias("side"), F.col("base").alias("segment"), *_none("ts_received"), F.lit(None).cast("string").alias("op"), F.lit(None).cast(rows.schema["changes"].dataType).alias("changes"), *_none("base_state", "base_deleted"))
    answers = sorted_fold(rows.unionByName(opens).unionByName(asks), [*KEY, "segment"], ["version", "side"], _Life, _answer, _STATE)
    out = found.join(answers.withColumnRenamed("version", "target"), [*KEY, "target"])
    return out.select(*KEY, *[f"asked_{c}" for c in asked], F.col("target").alias("version"), "ts", "deleted", "state", F.when(F.col("segment") > 0, F.col("segment")).alias("snapshot_version"), F.col("applied").alias("events_applied"))


def flat_legal(events: DataFrame) -> DataFrame:
    """(key, legal): whether an entity's changes are scalar leaves of objects, so that ``state_at_flat`` holds for it."""
    c = events.select(*KEY, F.explode_outer("changes").alias("c")).select(*KEY, "c.*")
    nested = F.col("path").rlike(r"\[|(^|\.)\d+(\.|$)") | (F.col("path") == "") | F.coalesce(F.col("new"), F.lit("")).rlike(r"^[{\[]") | F.coalesce(F.col("old"), F.lit("")).rlike(r"^[{\[]")
    # the events are read once; an entity without any change is a row without a path
    paths = stored(c.groupBy(*KEY, "path").agg(F.max(F.coalesce(nested, F.lit(False))).alias("_bad")), "paths")
    steps = F.size(F.split("path", r"\."))
    parents = paths.where(F.col("path").contains(".")).select(*KEY, F.explode(F.sequence(F.lit(1), steps - 1)).alias("n"), "path").select(*KEY, F.expr("substring_index(path, '.', n)").alias("path")).distinct()
    above = parents.join(paths.select(*KEY, "path"), [*KEY, "path"], "left_semi").select(*KEY, F.lit(True).alias("_bad"))
    return paths.select(*KEY, "_bad").unionByName(above).groupBy(*KEY).agg((~F.max("_bad")).alias("legal"))


def state_at_flat(events: DataFrame, at=None) -> DataFrame:
    """(key, path, value, version) of every live path at an instant: the last change per path since the last delete,
    removed paths dropped. Two aggregations and no per-entity sequence; legal where ``flat_legal`` says so."""
    seen = events if at is None else events.where(F.col("ts_received") <= F.lit(at))
    death = seen.groupBy(*KEY).agg(F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("version"))), F.lit(0)).alias("_death"))
    alive = seen.join(death, KEY).where(F.col("version") > F.col("_death"))
    c = alive.select(*KEY, "version", F.explode("changes").alias("c"))
    last = c.groupBy(*KEY, F.col("c.path").alias("path")).agg(F.max_by(F.struct("c.op", "c.new", "version"), "version").alias("l"))
    return last.where(F.col("l.op") != "remove").select(*KEY, "path", F.col("l.new").alias("value"), F.col("l.version").alias("version"))


def leaves_at(events: DataFrame, at=None, snapshots: DataFrame | None = None) -> DataFrame:
    """(key, path, value, version) of every live leaf at an instant: relationally for the entities where that is legal, by
    replay for the others. Leaves are scalars and empty objects and arrays, by their full paths, either way; ``version`` is
    the leaf's last change, and for a replayed entity the state's version."""
    events = stored(events.select(*_LOG), "leaf-events")  # read several times below
    legal = stored(flat_legal(events), "legal")
    flat = state_at_flat(events.join(legal.where("legal").select(*KEY), KEY, "left_semi"), at)
    rest = events.join(legal.where("not legal").select(*KEY), KEY, "left_semi")
    probes = rest.select(*KEY).distinct().withColumn("at", F.lit(at).cast("timestamp"))
    seen = state_at(probes, rest, snapshots).where("not deleted")
    return flat.unionByName(leaves(seen.select(*KEY, "version", "state"), "state").select(*KEY, "path", "value", "version"))


def leaves(df: DataFrame, column: str) -> DataFrame:
    """One row for each leaf of a document column: all other columns, ``path`` and ``value`` (JSON text)."""
    with_package(df.sparkSession)

    @F.arrow_udf("array<struct<path:string,value:string>>")
    def flat(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [{"path": p, "value": v} for p, v in J.leaves(J.loads(t))] for t in texts.to_pylist()], pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])))

    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(flat(column)).alias("_leaf")).select(*rest, "_leaf.path", "_leaf.value")


def state_between(events: DataFrame, start, end, snapshots: DataFrame | None = None, array_keys: dict | None = None) -> DataFrame:
    """Net change of each entity between two instants: key, from_version, to_version, changes. An entity that does not
    exist, or is deleted, at an instant has the empty object there; documents may nest. Entities without any event up to
    ``end`` give no row."""
    events = stored(events.select(*_LOG), "between-events")  # read several times below
    keys = events.select(*KEY).distinct()
    probes = keys.withColumns({"at": F.explode(F.array(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))), "version": F.lit(None).cast("long")})
    shown = state_at(probes, events, snapshots).withColumn("_s", F.when(F.col("deleted"), F.lit("{}")).otherwise(F.col("state")))
    ends = shown.groupBy(*KEY).agg(*[F.max(F.when(F.col("asked_at") == F.lit(t).cast("timestamp"), F.col(c))).alias(n) for t, n, c in ((start, "from_version", "version"), (end, "to_version", "version"), (start, "_a", "_s"), (end, "_b", "_s"))])
    ends = ends.where("to_version is not null").withColumns({"_a": F.coalesce("_a", F.lit("{}"))})
    return json_diff(ends, "_a", "_b", array_keys).drop("_a", "_b")

"""Write path: validation, duplicates, versions and planned events from commands of all entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from histspark.functions import jsonvalue as J
from histspark.functions.jsonx import parsed_text, respelled, valid_collection, valid_json
from histspark.operators.diff import json_diff
from histspark.operators.fold import sorted_fold
from histspark.schemas import CHANGES, KEY
from histspark.sources.tables import stored

#: Payload bytes where a collection sets none.
MAX_EVENT_BYTES = 1 << 20


def payload_size(df: DataFrame) -> Column:
    """Bytes of a command's payload."""
    return F.octet_length(F.coalesce(F.col("state"), F.to_json("changes"), F.lit("")))


def size_guard(df: DataFrame, limit: Column | int = MAX_EVENT_BYTES) -> Column:
    """Whether the payload is too large; ``limit`` may be a config column, NULL meaning the default."""
    most = F.coalesce(limit if isinstance(limit, Column) else F.lit(limit), F.lit(MAX_EVENT_BYTES))
    return payload_size(df) > most


def validate_batch(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects with ``code``): structural checks row by row; one bad row never blocks the rest.

    Codes: invalid_collection, invalid_entity_id, invalid_type, invalid_payload, too_large.
    """
    broken = F.col("state").isNotNull() & ~valid_json("state")
    bad_change = F.coalesce(F.exists("changes", lambda c: ~F.coalesce(c["op"].isin("add", "change", "remove"), F.lit(False)) | c["path"].isNull()), F.lit(False))
    code = (
        F.when(~F.coalesce(valid_collection("collection"), F.lit(False)), "invalid_collection")
        .when(F.coalesce(F.col("entity_id"), F.lit("")) == "", "invalid_entity_id")
        .when(~F.coalesce(F.col("kind").isin("state", "diff", "delete"), F.lit(False)), "invalid_type")
        .when((F.col("kind") == "state") & (F.col("state").isNull() | broken), "invalid_payload")
        .when((F.col("kind") == "diff") & (bad_change | (F.col("changes").isNull() & (F.coalesce(F.col("op"), F.lit("")) != "create"))), "invalid_payload")
        .when(size_guard(commands), "too_large")
    )
    marked = commands.withColumn("code", code)
    return marked.where("code is null").drop("code"), marked.where("code is not null")


def known_collections(commands: DataFrame, config: DataFrame, auto_create: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): commands of unconfigured collections are collection_not_found unless auto-created; commands
    over their collection's size limit are too_large. The config is one row per collection."""
    cfg = config.select(F.col("name").alias("_c"), F.col("max_event_size_bytes").alias("_max"))
    joined = commands.join(cfg, F.col("collection") == F.col("_c"), "left")
    code = F.when(F.col("_c").isNull() & F.lit(not auto_create), "collection_not_found").when(size_guard(commands, F.col("_max")), "too_large")
    marked = joined.withColumn("code", code).drop("_c", "_max")
    return marked.where("code is null").drop("code"), marked.where("code is not null")


def dedup_event_ids(commands: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(first deliveries, duplicates): the first (ts_received, seq) of a (tenant, collection, event_id) wins; stored ids
    win over all; rows without id never repeat."""
    key = ["tenant", "collection", "event_id"]
    w = Window.partitionBy(*key).orderBy("ts_received", "seq")
    with_id = commands.where("event_id is not null").withColumn("_n", F.row_number().over(w))
    fresh, again = with_id.where("_n = 1").drop("_n"), with_id.where("_n > 1").drop("_n")
    if stored is not None:
        known = stored.where("event_id is not null").select(*key).distinct()
        again = again.unionByName(fresh.join(known, key, "left_semi"))
        fresh = fresh.join(known, key, "left_anti")
    return fresh.unionByName(commands.where("event_id is null")), again


def assign_versions(rows: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``version`` 1..n per entity in arrival order, continuing from ``base`` (key, version) where given."""
    w = Window.partitionBy(*KEY).orderBy("ts_received", "seq")
    out = rows.withColumn("version", F.row_number().over(w).cast("long"))
    if base is None:
        return out
    tail = base.select(*KEY, F.col("version").alias("_tail"))
    return out.join(tail, KEY, "left").withColumn("version", F.col("version") + F.coalesce("_tail", F.lit(0))).drop("_tail")


def resolve_op(explicit: Column, live: Column, first_event_op: Column | str = "create") -> Column:
    """Explicit op wins; a live entity updates; else the collection's first op."""
    first = first_event_op if isinstance(first_event_op, Column) else F.lit(first_event_op)
    return F.coalesce(explicit, F.when(live, "update"), first)


def with_settings(commands: DataFrame, config: DataFrame) -> DataFrame:
    """Commands with the effective settings of their collection (one row per collection in ``config``): first_event_op,
    array_keys (map), snapshot_interval. Unconfigured collections get the defaults."""
    cfg = config.select(F.col("name").alias("collection"), *[F.col(c).alias(f"_{c}") for c in ("first_event_op", "array_keys", "snapshot_interval")])
    out = commands.join(cfg, "collection", "left")
    return out.withColumns({"first_event_op": F.coalesce("_first_event_op", F.lit("create")), "array_keys": F.col("_array_keys"), "snapshot_interval": F.coalesce("_snapshot_interval", F.lit(100))}).drop(*[c for c in out.columns if c.startswith("_") and c[1:] in ("first_event_op", "array_keys", "snapshot_interval")])


def _parsed(commands: DataFrame) -> DataFrame:
    """Commands with canonical states, and ``code`` invalid_payload where a state command has no well-formed text."""
    rows = commands.withColumn("_parsed", F.when(F.col("kind") == "state", parsed_text("state")))  # a step of its own: parsed once
    rows = rows.withColumn("_text", F.when(F.col("kind") == "state", respelled("_parsed", "state"))).drop("_parsed")
    return rows.withColumns({"code": F.when((F.col("kind") == "state") & F.col("_text").isNull(), "invalid_payload"), "state": F.coalesce("_text", F.when(F.col("kind") == "state", F.col("state")))}).drop("_text")


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    """As many partitions as are set, not fewer large ones: what a task sorts does not grow where these grow with the input;
    dealt by the key alone, later windows and joins on the key need no shuffle of their own."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY, *more)


def _order(*more: str):
    return Window.partitionBy(*KEY, *more, F.col("code").isNull()).orderBy("ts_received", "seq")


def _without_noops(rows: DataFrame, w, first_kind: Column, first_state: Column) -> DataFrame:
    """``drop_noops`` inside a window's partitions; the first row of each follows a command of ``first_kind`` (NULL: none)
    and ``first_state``."""
    kind = F.coalesce(F.lag("kind").over(w), first_kind)
    prior = F.when(kind.isNull(), F.coalesce("_held", F.lit("{}"))).when(kind == "delete", F.lit("{}")).otherwise(F.when(F.lag("kind").over(w).isNull(), first_state).otherwise(F.lag("state").over(w)))
    return rows.withColumn("base", prior).where((F.col("kind") != "state") | F.col("code").isNotNull() | ~F.col("state").eqNullSafe(F.col("base")))


def _on_held(rows: DataFrame, current: DataFrame | None) -> DataFrame:
    if current is None:
        return rows.withColumn("_held", F.lit(None).cast("string"))
    return rows.join(current.select(*KEY, F.when(~F.col("deleted"), F.col("state")).alias("_held")), KEY, "left")


def drop_noops(commands: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """State commands that change nothing go; adds ``base`` (the state an event starts from) and ``code``.

    A state equals its base when it equals the previous command's state, or ``{}`` behind a delete or at the start (or
    the stored current state). A state command without well-formed text keeps its row with ``code`` invalid_payload and
    is no predecessor of any other.
    """
    none = F.lit(None).cast("string")
    return _without_noops(_on_held(_dealt(_parsed(commands)), current), _order(), none, none).drop("_held")


#: Commands of one entity that one task takes; an entity with more is cut into blocks of time.
HOT = 500_000
#: An entity's block.
_BLOCK = [*KEY, "_block"]


def hot_entities(commands: DataFrame) -> DataFrame | None:
    """Keys with more than ``HOT`` commands, a few rows at most (one count of the keys); None where there are none."""
    keys = commands.groupBy(*KEY).count().where(F.col("count") > HOT).select(*KEY).dropna().collect()
    return commands.sparkSession.createDataFrame(keys, ", ".join(f"{k} string" for k in KEY)) if keys else None


def _carried(rows: DataFrame, *last: str) -> DataFrame:
    """For each block of an entity what the blocks before it end in: the last row's columns (``_last``, NULL without one)
    and how many rows they have (``_before``). Rejects and others are counted apart."""
    ends = rows.groupBy(*_BLOCK, F.col("code").isNull().alias("_good")).agg(F.max_by(F.struct(*last), F.struct("ts_received", "seq")).alias("_end"), F.count("*").alias("_n"))
    # a block without rows of its own still passes on what came before it
    every = rows.select(*_BLOCK).distinct().withColumn("_good", F.explode(F.array(F.lit(True), F.lit(False))))
    before = Window.partitionBy(*KEY, "_good").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = every.join(ends, [*_BLOCK, "_good"], "left")
    return ends.select(*_BLOCK, "_good", F.last("_end", True).over(before).alias("_last"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return rows.withColumn("_good", F.col("code").isNull()).join(F.broadcast(carried), [*_BLOCK, "_good"], "left").drop("_good")


def _kept_rows(rows: DataFrame, current: DataFrame | None) -> DataFrame:
    """Parsed commands without no-ops, with ``_prev`` (kind of the kept command before) and ``_number`` (place among them)."""
    none = F.lit(None).cast("string")
    kept = _without_noops(_on_held(_dealt(rows), current), _order(), none, none).drop("_held")
    return kept.withColumns({"_prev": F.lag("kind").over(_order()), "_number": F.row_number().over(_order()).cast("long")})


def _kept_rows_of_hot(rows: DataFrame, current: DataFrame | None) -> DataFrame:
    """``_kept_rows`` for entities of which one has more commands than a task should take: the rows are dealt by ranges of
    (key, time), every block works on its own, and what it has to know of those before is their last row and their count."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a row's block is the same wherever it is read
    rows = stored(rows.repartitionByRange(n, *KEY, "ts_received", "seq").withColumn("_block", F.spark_partition_id()), "hot-commands")
    w = _order("_block")
    kept = _without_noops(_with_carried(_dealt(_on_held(rows, current), "_block"), _carried(rows, "kind", "state")), w, F.col("_last.kind"), F.col("_last.state")).drop("_held", "_last", "_before")
    kept = stored(kept, "hot-kept")
    out = _with_carried(_dealt(kept, "_block"), _carried(kept, "kind"))
    out = out.withColumns({"_prev": F.coalesce(F.lag("kind").over(w), F.col("_last.kind")), "_number": F.row_number().over(w).cast("long") + F.col("_before")})
    return out.drop("_last", "_before", "_block")


def _behind(kept: DataFrame, current: DataFrame | None) -> DataFrame:
    """Rows with ``_alive`` and ``_tail`` of their stored row."""
    return kept if current is None else kept.join(current.select(*KEY, (~F.col("deleted")).alias("_alive"), F.col("version").alias("_tail")), KEY, "left")


def ingest_states(commands: DataFrame, current: DataFrame | None = None, first_event_op: str = "create", array_keys: dict | None = None) -> DataFrame:
    """Events of state and delete commands, without a fold: each depends on the previous command only. Rejects carry
    ``code`` and no version, as in ``ingest``.

    Liveness is judged after no-ops are gone. One shuffle on the entity serves both windows; entities of more than ``HOT``
    commands are cut into blocks of time. Commands may carry their collection's first_event_op and array_keys
    (``with_settings``), which then win over the arguments.
    """
    rows, hot = _parsed(commands), hot_entities(commands)
    if hot is None:
        kept = _behind(_kept_rows(rows, current), current)
    else:
        cold, warm = (rows.join(F.broadcast(hot), KEY, how) for how in ("left_anti", "left_semi"))
        few = None if current is None else F.broadcast(current.join(F.broadcast(hot), KEY, "left_semi"))
        kept = _behind(_kept_rows(cold, current), current).unionByName(_behind(_kept_rows_of_hot(warm, few), few))
    live = F.col("_prev").isNotNull() & (F.col("_prev") != "delete")
    if current is not None:
        live = live | (F.col("_prev").isNull() & F.coalesce("_alive", F.lit(False)))
    first = F.coalesce("first_event_op", F.lit(first_event_op)) if "first_event_op" in commands.columns else F.lit(first_event_op)
    op = F.when(F.col("kind") == "delete", "delete").otherwise(resolve_op(F.col("op"), live, first))
    number = F.col("_number") + (F.coalesce("_tail", F.lit(0)) if current is not None else F.lit(0))
    good = F.col("code").isNull()
    out = kept.withColumns({"op": F.when(good, op).otherwise(F.col("op")), "version": F.when(good, number), "_from": F.when(good, F.col("base"))}).drop("_prev", "_number", "_alive", "_tail")
    out = out.withColumn("_to", F.when(good, F.when(F.col("kind") == "delete", F.col("base")).otherwise(F.col("state")))).drop("changes")
    keys = F.coalesce("array_keys", F.lit(None).cast("map<string,string>")) if "array_keys" in commands.columns else array_keys
    return json_diff(out, "_from", "_to", keys).drop("_from", "_to")


PLANNED = (
    "tenant string, collection string, entity_id string, version long, op string, author string, source string, "
    "ts_source timestamp, ts_received timestamp, event_id string, request_id string, changes " + CHANGES + ", meta string, "
    "state string, deleted boolean, seq long, code string"
)


#: What an event has of its command as it is; of these a fold reads the key only.
TAKEN = (*KEY, "author", "source", "ts_source", "ts_received", "event_id", "request_id", "meta", "seq")
#: What ``plan_step`` reads of a command, its collection's settings and its stored row.
_READ = frozenset((*KEY, "kind", "op", "expected_version", "state", "changes", "first_event_op", "array_keys", "stored_version", "stored_deleted", "stored_state"))


class Entity:
    """What the fold holds of an entity."""

    def __init__(self):
        self.version, self.live, self.value, self.fresh = 0, False, None, True
        self.text: str | None = None  # of ``value``, where it has been written

    def load(self, row: dict) -> None:
        """Start from the stored row, once."""
        if self.fresh:
            self.fresh = False
            if row.get("stored_version") is not None:
                self.version, self.live, self.value = row["stored_version"], not row["stored_deleted"], J.loads(row["stored_state"])


def plan_step(first_event_op: str, check_versions: bool, array_keys: dict | None):
    """Step of the ingest fold: one command to at most one planned event or reject, without what it has of the command
    as it is (``TAKEN``)."""

    def step(entity: Entity, row: dict) -> list[dict]:
        entity.load(row)
        reject = lambda code: [{"code": code, "version": None, "op": row.get("op"), "changes": None, "state": None, "deleted": None}]
        keys = dict(row["array_keys"]) if row.get("array_keys") else array_keys
        if check_versions and row.get("expected_version") is not None and row["expected_version"] != entity.version:
            return reject("version_conflict")
        base, text = (entity.value, entity.text) if entity.live else ({}, "{}")
        if row["kind"] == "delete":
            op, changes, after, live = "delete", [], base, False
        else:
            try:
                if row["kind"] == "state":
                    if row["state"] is None:
                        raise ValueError("no state")
                    after = J.loads(row["state"])
                    changes = J.changes_between(base, after, keys)
                elif row["kind"] == "diff" and not row["changes"] and row.get("op") == "create" and row.get("state") is not None:
                    after = J.loads(row["state"])
                    changes = J.changes_between({}, after, keys)
                else:
                    changes = row["changes"] or []
                    after = J.apply(base if text is None else J.loads(text) if changes else base, changes, fresh=text is None)
            except (J.ApplyError, ValueError):
                return reject("invalid_diff" if row["kind"] == "diff" else "invalid_payload")
            if not changes:
                return []
            op = row.get("op") or ("update" if entity.live else row.get("first_event_op") or first_event_op)
            live, text = True, None
        text = J.dumps(after) if text is None else text
        entity.version += 1
        entity.live, entity.value, entity.text = live, after, text
        return [{"version": entity.version, "op": op, "changes": changes, "state": text, "deleted": not live, "code": None}]

    return step


def ingest(commands: DataFrame, current: DataFrame | None = None, first_event_op: str = "create", check_versions: bool = True, array_keys: dict | None = None) -> DataFrame:
    """Planned events and rejects (``code`` set) of mixed commands: an ordered fold per entity. A rejected command leaves
    the state alone; deleting an unknown entity still makes an event; the value behind a delete is kept. Commands may
    carry their collection's first_event_op and array_keys (``with_settings``), which win over the arguments."""
    rows = commands
    if current is not None:
        held = current.select(*KEY, F.col("version").alias("stored_version"), F.col("deleted").alias("stored_deleted"), F.col("state").alias("stored_state"))
        rows = commands.join(held, KEY, "left")
    # all that is sent is sorted, what the step reads is turned to Python, the rest goes on as it is
    types = {f.name: f.dataType for f in _parse_datatype_string(PLANNED)}
    own = [(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in TAKEN]
    rows = rows.select(*own, *[c for c in rows.columns if c in _READ and c not in TAKEN])
    unread = [c for c in TAKEN if c not in KEY]
    return sorted_fold(rows, KEY, ["ts_received", "seq"], Entity, plan_step(first_event_op, check_versions, array_keys), PLANNED, taken=TAKEN, unread=unread)


def check_expected_version(commands: DataFrame, current: DataFrame) -> DataFrame:
    """``conflict``: whether a command expects another version than the stored one (absent entities have 0)."""
    held = current.select(*KEY, F.col("version").alias("_v"))
    return commands.join(held, KEY, "left").withColumn("conflict", F.col("expected_version").isNotNull() & (F.col("expected_version") != F.coalesce("_v", F.lit(0)))).drop("_v")


def build_current(events: DataFrame) -> DataFrame:
    """Latest row per entity from events with their states."""
    return events.groupBy(*KEY).agg(F.max_by(F.struct("version", F.col("ts_received").alias("ts"), (F.col("op") == "delete").alias("deleted"), "state"), "version").alias("e")).select(*KEY, "e.*")


def batch_receipt(outcome: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: accepted count (duplicates count as accepted), rejects by index, status. ``outcome`` has the batch,
    ``index`` and ``code`` (NULL for accepted)."""
    bad = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("index", "code"))))
    return outcome.groupBy(batch).agg(F.count_if(F.col("code").isNull()).alias("accepted"), bad.alias("rejected"), F.when(F.count_if(F.col("code").isNotNull()) == 0, "accepted").otherwise("partial").alias("status"))


def server_meta(meta: Column, client_ip: Column) -> Column:
    """The meta document with the caller's ip, unless the client set one."""
    fields = F.coalesce(F.try_parse_json(meta).cast("map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    with_ip = F.map_concat(fields, F.create_map(F.lit("ip"), F.to_variant_object(F.array(client_ip)).cast("array<variant>")[0]))
    return F.to_json(F.when(client_ip.isNull() | F.map_contains_key(fields, "ip"), fields).otherwise(with_ip))

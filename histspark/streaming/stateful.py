"""Keyed state in the stream: ingest with chain tips, tickets that expire, reordering released by timers.

Each operator keeps what it needs of a key in the state store, so no micro-batch reads a table of everything that came
before. The rows that one micro-batch brings for one key are sorted in memory; the source's rate cap bounds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import _parse_datatype_string

from histspark.functions import jsonvalue as J
from histspark.operators.chain import PREFIX, canonical_parts, genesis
from histspark.operators.ingest import PLANNED, TAKEN, Entity, plan_step
from histspark.schemas import KEY
from histspark.session import with_package
from histspark.streaming.stream import INPUT, TERMINAL, TICKETS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which these operators need; the option is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


CHAINED = PLANNED + ", hash string, prev_hash string"
_CHANGE = Row("path", "op", "old", "new")
_TICKET = Row("ticket_id", "status", "updated_at", "entries")
_RELEASED = Row("body", "late", "place")


class KeyedIngest(StatefulProcessor):
    """The write path of one entity: its version, liveness, document and last hash."""

    def __init__(self, first_event_op: str = "create", check_versions: bool = True, array_keys: dict | None = None):
        self.settings, self.row = (first_event_op, check_versions, array_keys), Row(*_parse_datatype_string(CHAINED).names)

    def init(self, handle) -> None:
        self.step = plan_step(*self.settings)
        self.held = handle.getValueState("entity", "version long, live boolean, state string, tip string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        self.held.update((r["version"], not r["deleted"], r["state"], r["hash"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        entity, tip = Entity(), None
        entity.fresh = False
        if self.held.exists():
            entity.version, entity.live, state, tip = self.held.get()
            entity.value = J.loads(state)
        for row in sorted((r.asDict(recursive=True) for r in rows), key=lambda r: (r["ts_received"], r["seq"])):
            for out in self.step(entity, row):
                link = {"hash": None, "prev_hash": None}
                if out["code"] is None:
                    prev = tip or row["_start"]
                    tip = "sha256:" + hashlib.sha256((prev + canonical_text(row, out)).encode()).hexdigest()
                    link = {"hash": tip, "prev_hash": prev}
                out = {**{c: row.get(c) for c in TAKEN}, **out, **link, "changes": None if out["changes"] is None else [_CHANGE(*(c[n] for n in _CHANGE)) for c in out["changes"]]}
                yield self.row(*(out[c] for c in self.row))
        if entity.version:
            self.held.update((entity.version, entity.live, J.dumps(entity.value), tip))

    def close(self) -> None:
        pass


def canonical_text(row: dict, event: dict) -> str:
    """The signed text of a planned event, from the parts that its command already fixed."""

    def change(c: dict) -> str:
        sides = [f'"new":{"null" if c["new"] is None else c["new"]}'] if c["op"] != "remove" else []
        sides += [f'"old":{"null" if c["old"] is None else c["old"]}'] if c["op"] != "add" else []
        return "{" + ",".join([*sides, f'"op":{J.quoted(c["op"])}', f'"path":{J.quoted(c["path"])}']) + "}"

    changes = f'"changes":[{",".join(map(change, event["changes"]))}]' if event["changes"] else None
    return "{" + ",".join(x for x in (row["_author"], changes, row["_middle"], f'"op":{J.quoted(event["op"])}', row["_closing"]) if x) + "}"


def keyed_ingest(commands: DataFrame, initial: DataFrame | None = None, first_event_op: str = "create", check_versions: bool = True, array_keys: dict | None = None, prefix: str = PREFIX) -> DataFrame:
    """Planned, chained events and rejects of a stream of commands, as ``ingest`` and ``build_chain`` give them for a
    batch. ``initial`` (key, version, deleted, state, hash) are the entities stored before the stream began. Commands may
    carry their collection's settings (``with_settings``)."""
    with_package(commands.sparkSession)
    own = [c for c in (*INPUT, "first_event_op", "array_keys", "flow") if c in commands.columns]
    author, middle, closing = canonical_parts(commands)
    rows = commands.select(*own, author.alias("_author"), middle.alias("_middle"), closing.alias("_closing"), genesis("collection", prefix).alias("_start")).drop("flow")
    start = None if initial is None else initial.select(*KEY, "version", "deleted", "state", "hash").groupBy(*KEY)
    return rows.groupBy(*KEY).transformWithState(KeyedIngest(first_event_op, check_versions, array_keys), _parse_datatype_string(CHAINED), "append", "none", start)


class Tickets(StatefulProcessor):
    """Progress of one ticket; forgotten when the watermark has passed its last entry."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("ticket", "far string, end string, end_at long, updated_at long, entries long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        far, end, end_at, updated, n = self.held.get() if self.held.exists() else (None, None, None, None, 0)
        for r in rows:
            rank, at = TICKETS.get(r["status"]), r["_at"]
            if rank is None or at is None:
                continue
            n, updated = n + 1, at if updated is None else max(updated, at)
            if far is None or rank > TICKETS[far]:
                far = r["status"]
            if r["status"] in TERMINAL and (end_at is None or at < end_at):
                end, end_at = r["status"], at
        if n:
            self.held.update((far, end, end_at, updated, n))
            self.handle.registerTimer(updated // 1000 + 1)
            yield _TICKET(key[0], end or far, updated, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists() and self.held.get()[3] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_tickets(log: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Status of each ticket of a stream (ticket_id, status, at), one row whenever a micro-batch brings entries for it:
    ticket_id, status, updated_at, entries (so many make up the status; the row with most is the latest). A ticket whose
    last entry is further than ``ttl`` behind the newest of the stream is forgotten; so old entries are not read."""
    with_package(log.sparkSession)
    kind = log.schema["ticket_id"].dataType.simpleString()
    rows = log.withWatermark("at", ttl).select("ticket_id", "status", "at", F.unix_micros("at").alias("_at"))
    out = rows.groupBy("ticket_id").transformWithState(Tickets(), _parse_datatype_string(f"ticket_id {kind}, status string, updated_at long, entries long"), "append", "eventTime")
    return out.withColumn("updated_at", F.timestamp_micros("updated_at"))


class Reorder(StatefulProcessor):
    """Rows of one entity held until no earlier one can come."""

    def __init__(self, window_us: int):
        self.window = window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("held", "source long, seq long, body string")
        self.seen = handle.getValueState("seen", "newest long, released long, place long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest, released, place, until = self.seen.get() if self.seen.exists() else (None, None, 0, None)
        held = list(self.rows.get()) if self.rows.exists() else []
        for r in sorted(rows, key=lambda r: (r["_arrived"], r["seq"])):
            source = r["_source"]
            late = newest is not None and source is not None and source < newest - self.window
            if late or (released is not None and source is not None and source < released):
                yield _RELEASED(r["_body"], True, None)
                continue
            if source is not None:
                newest = source if newest is None else max(newest, source)
            held.append((source, r["seq"], r["_body"]))
            until = max(until or 0, r["_until"])
        held.sort(key=lambda h: (h[0] is not None, h[0] or 0, h[1]))
        final = 0
        while final < len(held) and newest is not None and (held[final][0] is None or held[final][0] < newest - self.window):
            released, place, final = held[final][0], place + 1, final + 1
            yield _RELEASED(held[final - 1][2], False, place)
        held = held[final:]
        if held:
            self.rows.put(held)
            self.handle.registerTimer(until)
        else:
            self.rows.clear()
        self.seen.update((newest, released, place, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        newest, released, place, until = self.seen.get()
        if until is not None and expiredTimerInfo.getExpiryTimeInMs() < until:
            return  # rows came since: a later timer stands
        for source, _, body in sorted(self.rows.get() if self.rows.exists() else [], key=lambda h: (h[0] is not None, h[0] or 0, h[1])):
            released, place = source, place + 1
            yield _RELEASED(body, False, place)
        self.rows.clear()
        self.seen.update((newest, released, place, until))

    def close(self) -> None:
        pass


def stream_reorder(events: DataFrame, window: str = "10 minutes", hold: str = "10 minutes") -> DataFrame:
    """The rows of a stream with ``late`` and ``place`` (source order of an entity's rows): late are those further behind
    the newest source time that came before than ``window``, or behind a row already let go.

    A row is let go when a newer source time puts it out of the window, or by a timer when the watermark of arrivals is
    ``hold`` past the entity's last one.
    """
    spark = with_package(events.sparkSession)
    micros = spark.range(1).select(F.unix_micros(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {window}"))).first()[0]
    columns = events.columns
    rows = events.withWatermark("ts_received", hold).select(
        *KEY, "ts_received", "seq", F.unix_micros("ts_received").alias("_arrived"), F.unix_micros("ts_source").alias("_source"), F.unix_millis("ts_received").alias("_until"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_body")
    )
    out = rows.groupBy(*KEY).transformWithState(Reorder(micros), _parse_datatype_string("body string, late boolean, place long"), "append", "eventTime")
    return out.select(F.from_json("body", events.schema).alias("r"), "late", "place").select("r.*", "late", "place")

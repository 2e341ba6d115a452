"""Per-entity SHA-256 chains: canonical event text, building and verification."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histspark.functions.jsonx import quoted
from histspark.operators.fold import sorted_fold
from histspark.schemas import KEY

PREFIX = "histspark:genesis:v1:"


def _object(*fields: tuple[str, Column]) -> Column:
    """Object text of the fields whose text is not NULL, keys in sorted order."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields, key=lambda f: f[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _list(items: Column, render) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, render), ","), F.lit("]"))


def _text(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", quoted(value))


def event_canonical(events: DataFrame) -> Column:
    """The signed text of an event: op, entity, changes, author, source, source time to the millisecond and flow. Absent
    fields add nothing; version, meta and receive times are not signed."""
    null = F.lit("null")
    change = lambda c: _object(("path", quoted(c["path"])), ("op", quoted(c["op"])), ("old", F.when(c["op"] != "add", F.coalesce(c["old"], null))), ("new", F.when(c["op"] != "remove", F.coalesce(c["new"], null))))
    author, middle, closing = canonical_parts(events)
    changes = F.when(F.size("changes") > 0, F.concat(F.lit('"changes":'), _list(F.col("changes"), change)))
    return F.concat(F.lit("{"), F.concat_ws(",", author, changes, middle, F.concat(F.lit('"op":'), quoted(F.col("op"))), closing), F.lit("}"))


def canonical_parts(rows: DataFrame) -> tuple[Column, Column, Column]:
    """What stands before the changes, between them and the op, and behind the op in the signed text, in key order: all
    that a command fixes before its event is planned (NULL where nothing stands)."""
    ref = lambda r: _object(("activity_id", _text(r["activity_id"])), ("collection", _text(r["collection"])), ("entity_id", _text(r["entity_id"])), ("version", F.when(r["version"] != 0, r["version"].cast("string"))), ("event_id", _text(r["event_id"])))
    stamp = F.regexp_replace(F.regexp_replace(F.date_format(F.date_trunc("millisecond", "ts_source"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), r"0+$", ""), r"\.$", "")
    flow = F.when(F.col("flow").isNotNull(), _object(("id", _text(F.col("flow.id"))), ("step", _text(F.col("flow.step"))), ("caused_by", F.when(F.size("flow.caused_by") > 0, _list(F.col("flow.caused_by"), ref))))) if "flow" in rows.columns else F.lit(None).cast("string")
    field = lambda name, text: F.concat(F.lit(f'"{name}":'), text)
    time = F.when(F.col("ts_source").isNotNull(), F.concat(F.lit('"'), stamp, F.lit('Z"')))
    filled = lambda text: F.when(text != "", text)
    return (
        field("author", _text(F.col("author"))),
        F.concat_ws(",", field("entity_id", quoted(F.col("entity_id"))), field("flow", flow)),
        filled(F.concat_ws(",", field("source", _text(F.col("source"))), field("ts_source", time))),
    )


def genesis(collection: Column | str, prefix: str = PREFIX) -> Column:
    """First previous hash of a collection's chains."""
    c = F.col(collection) if isinstance(collection, str) else collection
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(prefix), c).cast("binary"), 256))


def link(prev: Column, canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(prev, canonical).cast("binary"), 256))


class _Tip:
    def __init__(self):
        self.hash = None


def _extend(tip: _Tip, row: dict) -> list[dict]:
    prev = tip.hash or row["start"]
    tip.hash = "sha256:" + hashlib.sha256((prev + row["canonical"]).encode()).hexdigest()
    return [{**{k: row[k] for k in (*KEY, "version")}, "hash": tip.hash, "prev_hash": prev}]


def build_chain(events: DataFrame, prefix: str = PREFIX, tips: DataFrame | None = None) -> DataFrame:
    """(key, version, hash, prev_hash) of every event: canonical text natively, then one ordered fold per entity.
    ``tips`` (key, hash) continue stored chains."""
    rows = events.select(*KEY, "version", event_canonical(events).alias("canonical"), genesis("collection", prefix).alias("start"))
    if tips is not None:
        rows = rows.join(tips.select(*KEY, F.col("hash").alias("_tip")), KEY, "left").withColumn("start", F.coalesce("_tip", "start")).drop("_tip")
    return sorted_fold(rows, KEY, ["version"], _Tip, _extend, "tenant string, collection string, entity_id string, version long, hash string, prev_hash string")


def verify_chain(events: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Broken links: key, version, problem (bad_prev, bad_hash, restart), and whether it is the entity's first.

    No fold: the stored previous hash is checked against the predecessor and the hash is recomputed from it. Events
    without integrity before a first link are fine; a null link later restarts the chain and is reported.
    """
    w = Window.partitionBy(*KEY).orderBy("version")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_h", F.when(F.col("integrity.hash") != "", F.col("integrity.hash"))).withColumns({"_before": F.lag("_h").over(w), "_any": F.max(F.col("_h").isNotNull()).over(earlier), "_canonical": event_canonical(events)})
    expected = F.coalesce("_before", genesis("collection", prefix))
    problem = (
        F.when(F.col("_h").isNull(), F.when(F.coalesce("_any", F.lit(False)), "restart"))
        .when(~F.col("integrity.prev_hash").eqNullSafe(expected), "bad_prev")
        .when(F.col("_h") != link(F.col("integrity.prev_hash"), F.col("_canonical")), "bad_hash")
    )
    broken = rows.withColumn("problem", problem).where("problem is not null")
    return broken.select(*KEY, "version", "problem", (F.col("version") == F.min("version").over(Window.partitionBy(*KEY))).alias("first"))


def chain_gaps(events: DataFrame) -> DataFrame:
    """Entities with missing or repeated versions: key, events, versions, latest."""
    n = events.groupBy(*KEY).agg(F.count("*").alias("events"), F.count_distinct("version").alias("versions"), F.max("version").alias("latest"))
    return n.where((F.col("events") != F.col("versions")) | (F.col("versions") != F.col("latest")))

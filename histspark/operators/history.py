"""History reads: filters, projections, order, paging, latest rows, validity intervals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histspark.functions.jsonx import decode_cursor, encode_cursor, json_pointer, quoted
from histspark.schemas import KEY

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def history(events: DataFrame, *, collection=None, entity_id=None, op=None, author=None, source=None, start=None, end=None, path=None, max_version=None) -> DataFrame:
    """Events that meet every given condition. The window is on ``ts_received``, both ends included; ``path`` keeps
    events that touch the path or anything below it."""
    out = events
    for name, value in (("collection", collection), ("entity_id", entity_id), ("op", op), ("author", author), ("source", source)):
        if value not in (None, ""):
            out = out.where(F.col(name) == value)
    if start is not None:
        out = out.where(F.col("ts_received") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts_received") <= F.lit(end))
    if path:
        out = out.where(touches("changes", path))
    if max_version is not None:
        out = out.where(F.col("version") <= max_version)
    return out


def touches(changes: str, path: str) -> Column:
    """Whether some change lies at ``path`` or below."""
    return F.exists(changes, lambda c: (c["path"] == path) | c["path"].startswith(path + ".") | c["path"].startswith(path + "["))


def project_native(events: DataFrame) -> DataFrame:
    """Changes with only the sides that exist: add has new, remove has old, change has both."""
    side = lambda c: F.struct(c["path"].alias("path"), c["op"].alias("op"), F.when(c["op"] != "add", c["old"]).alias("old"), F.when(c["op"] != "remove", c["new"]).alias("new"))
    return events.withColumn("changes", F.transform("changes", side))


def project_json_patch(events: DataFrame, strict: bool = False) -> DataFrame:
    """``patch``: RFC 6902 text per event, and ``inexpressible``: whether a keyed path rules a patch out (then NULL).

    ``strict`` raises instead. change becomes replace, old is dropped, a null value is kept, remove has no value.
    """

    def entry(c: Column) -> Column:
        op = F.when(c["op"] == "change", "replace").otherwise(c["op"])
        head = F.concat(F.lit('{"op":"'), op, F.lit('","path":'), quoted(json_pointer(c["path"])))
        return F.concat(head, F.when(c["op"] == "remove", F.lit("}")).otherwise(F.concat(F.lit(',"value":'), F.coalesce(c["new"], F.lit("null")), F.lit("}"))))

    keyed = F.exists("changes", lambda c: c["path"].contains("["))
    text = F.concat(F.lit("["), F.array_join(F.transform("changes", entry), ","), F.lit("]"))
    patch = F.when(keyed, F.raise_error(F.lit("keyed path has no JSON pointer")) if strict else F.lit(None).cast("string")).otherwise(text)
    return events.withColumns({"patch": patch, "inexpressible": keyed})


def ordered(events: DataFrame, order_by: str = "version", descending: bool = True) -> DataFrame:
    """Order by version, ts_source or ts_received; times tie-break on version in the same direction."""
    columns = ["version"] if order_by == "version" else [order_by, "version"]
    return events.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in columns])


def page(events: DataFrame, order_by: str = "version", descending: bool = True, after: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page, strictly after the cursor: a top-k report, not a full sort."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    if after:
        at = decode_cursor(after)
        v = F.col("version") < at["v"] if descending else F.col("version") > at["v"]
        if order_by != "version":
            ts = F.lit(datetime.fromisoformat(at["ts"]))
            t = F.col(order_by)
            v = (t < ts if descending else t > ts) | ((t == ts) & v)
        events = events.where(v)
    return ordered(events, order_by, descending).limit(limit)


def next_cursor(last: dict, order_by: str, n_rows: int, limit: int) -> str | None:
    """Cursor behind a page's last row; only a full page has one."""
    if n_rows < limit:
        return None
    return encode_cursor(v=last["version"], **({} if order_by == "version" else {"ts": last[order_by].isoformat()}))


def last_event(events: DataFrame) -> DataFrame:
    """The highest version of each entity (group aggregation, no sort)."""
    rest = [c for c in events.columns if c not in KEY]
    return events.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("e")).select(*KEY, *[F.col(f"e.{c}").alias(c) for c in rest])


def field_changes(events: DataFrame) -> DataFrame:
    """One row per changed path."""
    keep = [c for c in events.columns if c != "changes"]
    return events.select(*keep, F.posexplode("changes").alias("ord", "c")).select(*keep, "ord", "c.path", F.col("c.op").alias("change_op"), "c.old", "c.new")


def validity(events: DataFrame) -> DataFrame:
    """valid_from and valid_to of every version (a type-2 history); valid_to is NULL for the latest."""
    w = Window.partitionBy(*KEY).orderBy("version")
    return events.withColumns({"valid_from": F.col("ts_received"), "valid_to": F.lead("ts_received").over(w)})


def lives(events: DataFrame) -> DataFrame:
    """``life``: how many deletes lie before an event; a recreated entity starts a new life."""
    w = Window.partitionBy(*KEY).orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("life", F.coalesce(F.sum((F.col("op") == "delete").cast("int")).over(w), F.lit(0)))

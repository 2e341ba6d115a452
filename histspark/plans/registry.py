"""Registered queries: each applies operators to the driver tables; the SQL says the same for another engine."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from histspark.functions import jsonx
from histspark.operators import apply, asof, catalog, chain, compose, delivery, diff, flows, history, ingest, lifecycle, plugins, rule_index, rules
from histspark.plans import driver
from histspark.schemas import EVENTS, INTEGRITY, KEY, SNAPSHOTS
from histspark.session import shared_dir
from histspark.sources import tables
from histspark.streaming import stateful, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AT = datetime(2024, 1, 15)
FROM, TO = datetime(2024, 1, 10), datetime(2024, 1, 20)

#: The command stream as versioned events, in SQL.
EV = """
WITH cmd AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, CAST(user_id % 10 AS VARCHAR) AS author, ts, event_id AS seq, event_type, value,
    json_extract_string(props, '$.k') AS k, event_type = 'error' AS del FROM events),
b AS (SELECT *, lag(del) OVER w AS pdel, lag(k) OVER w AS pk, lag(event_type) OVER w AS ptype, lag(value) OVER w AS pvalue
    FROM cmd WINDOW w AS (PARTITION BY entity_id ORDER BY ts, seq)),
kept AS (SELECT * FROM b WHERE del OR pdel IS NULL OR pdel OR k IS DISTINCT FROM pk OR event_type <> ptype OR value <> pvalue),
ev AS (SELECT *, row_number() OVER w AS version,
    CASE WHEN del THEN 'delete' WHEN coalesce(lag(del) OVER w, TRUE) THEN 'create' ELSE 'update' END AS op
    FROM kept WINDOW w AS (PARTITION BY entity_id ORDER BY ts, seq)),
base AS (SELECT *, coalesce(pdel, TRUE) AS fresh FROM ev),
fc AS (SELECT entity_id, version, seq, ts, author, path, old, new, old_num, new_num,
    CASE WHEN old IS NULL AND old_num IS NULL THEN 'add' ELSE 'change' END AS change_op FROM (
    SELECT entity_id, version, seq, ts, author, 'k' AS path, CASE WHEN NOT fresh THEN '"' || pk || '"' END AS old, '"' || k || '"' AS new, CAST(NULL AS DOUBLE) AS old_num, CAST(NULL AS DOUBLE) AS new_num FROM base WHERE NOT del
    UNION ALL SELECT entity_id, version, seq, ts, author, 'type', CASE WHEN NOT fresh THEN '"' || ptype || '"' END, '"' || event_type || '"', NULL, NULL FROM base WHERE NOT del
    UNION ALL SELECT entity_id, version, seq, ts, author, 'value', NULL, NULL, CASE WHEN NOT fresh THEN pvalue END, value FROM base WHERE NOT del)
    WHERE old IS DISTINCT FROM new OR old_num IS DISTINCT FROM new_num)
"""


#: A change's old or new value as JSON text, from fc.
_OLD = "coalesce(old, regexp_replace(CAST(old_num AS VARCHAR), '\\.0$', ''))"
_NEW = "coalesce(new, regexp_replace(CAST(new_num AS VARCHAR), '\\.0$', ''))"


def register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the state of every entity at an instant, from raw commands."""
    return QUERIES["state_at_flat"](spark, sf_dir)


def num(c):
    return F.when(F.col("path") == "value", c.cast("double"))


def txt(c):
    return F.when(F.col("path") != "value", c)


# ---- ingest ----------------------------------------------------------------------------------------------------------


@register("ingest_states", EV + "SELECT entity_id, version, op, seq, ts AS ts_received FROM ev")
def _(spark, d):
    return driver.events(spark, d).select("entity_id", "version", "op", "seq", "ts_received")


@register("ingest_fold", EV + "SELECT entity_id, version, op, seq, del AS deleted FROM ev")
def _(spark, d):
    return ingest.ingest(driver.commands(spark, d)).where("code is null").select("entity_id", "version", "op", "seq", "deleted")


_BAD = EV.replace("FROM events)", "FROM events WHERE event_type = 'error' OR event_id % 5 <> 0)")


@register("ingest_malformed", _BAD + """SELECT form, entity_id, version, op, seq, CAST(NULL AS VARCHAR) AS code FROM ev, (VALUES ('fold'), ('window')) f(form)
    UNION ALL SELECT form, CAST(user_id AS VARCHAR), 0, '-', event_id, 'invalid_payload' FROM events, (VALUES ('fold'), ('window')) f(form) WHERE event_type <> 'error' AND event_id % 5 = 0""")
def _(spark, d):
    """State text that is cut off is rejected, and nothing else is lost, by the window form and by the fold."""
    bad = (F.col("kind") == "state") & (F.col("seq") % 5 == 0)
    cmds = driver.commands(spark, d).withColumn("state", F.when(bad, F.expr("left(state, length(state) - 1)")).otherwise(F.col("state")))
    names = ["entity_id", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("op", F.lit("-")).alias("op"), "seq", "code"]
    return ingest.ingest(cmds).select(F.lit("fold").alias("form"), *names).union(ingest.ingest_states(cmds).select(F.lit("window").alias("form"), *names))


@register("ingest_settings", EV.replace("'app.users'", "") + """, c AS (SELECT *, CAST(entity_id AS INT) % 2 = 0 AS even FROM ev)
    SELECT form, entity_id, version, CASE WHEN op = 'create' AND even THEN 'update' ELSE op END AS op FROM c, (VALUES ('fold'), ('window')) f(form)""")
def _(spark, d):
    """Two collections; the one of even users starts its entities with updates."""
    cmds = driver.commands(spark, d).withColumn("collection", F.when(F.col("entity_id").cast("int") % 2 == 0, "app.even").otherwise("app.odd"))
    cfg = spark.createDataFrame([("app.even", "update", {"items": "n"}, 10)], "name string, first_event_op string, array_keys map<string,string>, snapshot_interval int")
    cmds = ingest.with_settings(cmds, cfg)
    names = ["entity_id", "version", "op"]
    return ingest.ingest(cmds).select(F.lit("fold").alias("form"), *names).union(ingest.ingest_states(cmds).select(F.lit("window").alias("form"), *names))


_FORMS = EV.replace("json_extract_string(props, '$.k') AS k", "CAST(json_extract_string(props, '$.k') AS INT) // 20 * 20 + 1 AS k, '' AS event_type, 0 AS value").replace("event_id AS seq, event_type, value,", "event_id AS seq,")


@register("ingest_number_forms", _FORMS + "SELECT form, entity_id, version, op, seq, CAST(k AS BIGINT) AS n FROM ev, (VALUES ('fold'), ('window')) f(form) WHERE NOT del")
def _(spark, d):
    """The same number in turn written plain, with a zero fraction and with two exponents: no version without a change, in
    the window form and in the fold, and the states are the same text."""
    k = F.floor(F.get_json_object("state", "$.k").cast("int") / 20) * 20 + 1
    text = k.cast("string")
    forms = F.array(text, F.concat(text, F.lit(".00")), F.concat(text, F.lit("0e-1")), F.concat(F.lit("0."), text, F.lit("E"), F.length(text).cast("string")))
    cmds = driver.commands(spark, d).withColumn("state", F.when(F.col("kind") == "state", F.concat(F.lit('{"n": '), F.get(forms, F.col("seq") % 4), F.lit("}"))))
    names = ["entity_id", "version", "op", "seq", F.regexp_extract("state", r'^\{"n":(\d+)\}$', 1).cast("long").alias("n")]
    out = ingest.ingest(cmds).select(F.lit("fold").alias("form"), *names).union(ingest.ingest_states(cmds).select(F.lit("window").alias("form"), *names))
    return out.where("op <> 'delete'")


@register("ingest_continued", EV + "SELECT form, entity_id, version, op, seq FROM ev, (VALUES ('fold'), ('window')) f(form) WHERE ts >= TIMESTAMP '2024-01-15'")
def _(spark, d):
    """Commands behind an instant on top of the current rows stored until then: versions and operations go on."""
    held = ingest.ingest(driver.commands(spark, d).where(F.col("ts_received") < F.lit(AT))).where("code is null")
    held = ingest.build_current(held)
    later = driver.commands(spark, d).where(F.col("ts_received") >= F.lit(AT))
    names = ["entity_id", "version", "op", "seq"]
    return ingest.ingest(later, held).select(F.lit("fold").alias("form"), *names).union(ingest.ingest_states(later, held).select(F.lit("window").alias("form"), *names))


@register("create_with_state", "SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, 1 AS version, 'create' AS op, 2 AS n_changes, '{\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}' AS state FROM orders")
def _(spark, d):
    """A diff command without changes and with a state creates the entity from it."""
    o = driver.table(spark, d, "orders")
    blank = driver.commands(spark, d).limit(0)
    cmds = o.select(F.lit("t").alias("tenant"), F.lit("crm.orders").alias("collection"), F.col("o_orderkey").cast("string").alias("entity_id"), F.lit("diff").alias("kind"), F.lit("create").alias("op"),
                    F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("state"), F.col("o_orderdate").alias("ts_received"), F.col("o_orderkey").alias("seq"))
    out = ingest.ingest(blank.unionByName(cmds, allowMissingColumns=True))
    return out.select("entity_id", "version", "op", F.size("changes").alias("n_changes"), "state")


@register("ingest_diffs", EV + ", n AS (SELECT entity_id, count(*) AS versions, max(version) AS latest FROM ev GROUP BY ALL) SELECT entity_id, versions, latest, 0 AS rejected FROM n")
def _(spark, d):
    """States turned to diffs, ingested as diffs, give the same versions and no rejects."""
    e = driver.events(spark, d)
    cmds = e.withColumns({"kind": F.when(F.col("op") == "delete", "delete").otherwise("diff"), "op": F.lit(None).cast("string"), "expected_version": F.col("version") - 1})
    out = ingest.ingest(cmds.drop("version"))
    return out.groupBy("entity_id").agg(F.count("version").alias("versions"), F.max("version").alias("latest"), F.count("code").alias("rejected"))


@register("version_conflicts", EV + "SELECT entity_id, count(*) FILTER (version = 2) AS conflicts FROM ev GROUP BY entity_id")
def _(spark, d):
    """Commands of version 2 expect version 7: the fold rejects them (state stays)."""
    e = driver.events(spark, d)
    # commands of states and deletes carry no changes, so none are made for them
    cmds = e.withColumn("expected_version", F.when(F.col("version") == 2, F.lit(7)).cast("long")).drop("version", "changes").withColumn("op", F.lit(None).cast("string"))
    out = ingest.ingest(cmds)
    return out.groupBy("entity_id").agg(F.count_if(F.col("code") == "version_conflict").alias("conflicts"))


@register("expected_version_check", EV + "SELECT entity_id, max(version) % 2 = 0 AS conflict FROM ev GROUP BY entity_id")
def _(spark, d):
    cur = ingest.build_current(driver.events(spark, d))
    ask = cur.select(*KEY, (F.col("version") - 1 + F.col("version") % 2).alias("expected_version"))
    return ingest.check_expected_version(ask, cur).select("entity_id", "conflict")


@register("build_current", EV + "SELECT entity_id, max(version) AS version, arg_max(del, version) AS deleted, max(ts) AS ts FROM ev GROUP BY entity_id")
def _(spark, d):
    return ingest.build_current(driver.events(spark, d)).select("entity_id", "version", "deleted", "ts")


@register("validate_batch", """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'invalid_collection' WHEN o_orderkey % 11 = 0 THEN 'invalid_entity_id' WHEN o_orderkey % 13 = 0 THEN 'invalid_type'
    WHEN o_orderkey % 17 = 0 THEN 'invalid_payload' END AS code, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, d):
    accepted, rejects = ingest.validate_batch(_order_commands(spark, d))
    both = accepted.select(F.lit(None).cast("string").alias("code")).union(rejects.select("code"))
    return both.groupBy("code").agg(F.count("*").alias("n"))


@register("batch_receipt", """WITH c AS (SELECT o_custkey AS batch_id, o_orderkey AS index, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid_collection' WHEN o_orderkey % 11 = 0 THEN 'invalid_entity_id'
    WHEN o_orderkey % 13 = 0 THEN 'invalid_type' WHEN o_orderkey % 17 = 0 THEN 'invalid_payload' END AS code FROM orders)
    SELECT batch_id, count(*) FILTER (code IS NULL) AS accepted, count(code) AS n_rejected, CASE WHEN count(code) = 0 THEN 'accepted' ELSE 'partial' END AS status FROM c GROUP BY batch_id""")
def _(spark, d):
    accepted, rejects = ingest.validate_batch(_order_commands(spark, d))
    both = accepted.select("batch_id", "index", F.lit(None).cast("string").alias("code")).union(rejects.select("batch_id", "index", "code"))
    return ingest.batch_receipt(both).select("batch_id", "accepted", F.size("rejected").cast("long").alias("n_rejected"), "status")


def _order_commands(spark, d):
    o = driver.table(spark, d, "orders")
    k = F.col("o_orderkey")
    state = F.to_json(F.struct("o_orderstatus", "o_totalprice"))
    return o.select(
        F.lit("t").alias("tenant"), F.when(k % 7 == 0, "Bad..Name").otherwise("crm.orders").alias("collection"), F.when(k % 11 == 0, "").otherwise(k.cast("string")).alias("entity_id"),
        F.when(k % 13 == 0, "upsert").otherwise("state").alias("kind"), F.when(k % 17 == 0, F.concat(state, F.lit("x"))).otherwise(state).alias("state"), F.lit(None).cast("string").alias("op"),
        F.lit(None).cast("array<struct<path:string,op:string,old:string,new:string>>").alias("changes"), F.col("o_custkey").alias("batch_id"), k.alias("index"), F.col("o_orderdate").alias("ts_received"), k.alias("seq"), k.cast("string").alias("event_id"),
    )


@register("known_collections", "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'collection_not_found' END AS code, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    cfg = spark.range(1).select(F.lit("crm.orders").alias("name"), F.lit(None).cast("long").alias("max_event_size_bytes"))
    ok, bad = ingest.known_collections(_order_commands(spark, d), cfg)
    return ok.select(F.lit(None).cast("string").alias("code")).union(bad.select("code")).groupBy("code").agg(F.count("*").alias("n"))


@register("size_guard", "SELECT doc_id, octet_length(encode(text)) > 4096 AS too_large FROM documents")
def _(spark, d):
    docs = driver.table(spark, d, "documents").select("doc_id", F.col("text").alias("state"), F.lit(None).cast("array<string>").alias("changes"))
    return docs.select("doc_id", ingest.size_guard(docs, 4096).alias("too_large"))


@register("dedup_event_ids", """WITH e AS (SELECT user_id % 40 AS id, user_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n FROM events)
    SELECT n = 1 AND id >= 5 AS first_delivery, count(*) AS n_rows FROM e GROUP BY ALL""")
def _(spark, d):
    c = driver.commands(spark, d).withColumn("event_id", (F.col("entity_id").cast("long") % 40).cast("string"))
    known = c.where("cast(event_id as int) < 5").select("tenant", "collection", "event_id").distinct()
    first, again = ingest.dedup_event_ids(c, known)
    return first.select(F.lit(True).alias("first_delivery")).union(again.select(F.lit(False))).groupBy("first_delivery").agg(F.count("*").alias("n_rows"))


@register("server_meta", "SELECT user_id % 2 = 0 AS own, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    e = driver.table(spark, d, "events")
    meta = ingest.server_meta(F.when(F.col("user_id") % 2 == 0, F.lit('{"ip":"own"}')).otherwise(F.lit('{"a":1}')), F.lit("10.0.0.1"))
    return e.select((F.get_json_object(meta, "$.ip") == "own").alias("own")).groupBy("own").agg(F.count("*").alias("n"))


@register("merged_current", EV + "SELECT entity_id, max(version) AS version FROM ev GROUP BY entity_id")
def _(spark, d):
    e = driver.events(spark, d)
    return tables.merged_current(ingest.build_current(e.where(F.col("ts_received") < F.lit(AT))), ingest.build_current(e)).select("entity_id", "version")


@register("new_snapshots", EV + "SELECT entity_id, version FROM ev WHERE version % 10 = 0 AND version > 20")
def _(spark, d):
    e = driver.events(spark, d).select(*KEY, "version", F.col("ts_received").alias("ts"), (F.col("op") == "delete").alias("deleted"), "state")
    snaps = asof.build_snapshots(e, 10)
    return tables.new_snapshots(snaps.where("version <= 20"), snaps.unionByName(snaps)).select("entity_id", "version")


@register("activity_ids", "SELECT count(*) AS n, count(DISTINCT (conv_id, turn, role)) AS ids FROM conversations")
def _(spark, d):
    a = driver.activities(spark, d)
    a = tables.with_activity_ids(a.withColumns({"data": F.col("activity_id"), "activity_id": F.lit("")}))
    return a.agg(F.count("*").alias("n"), F.count_distinct("activity_id").alias("ids"))


# ---- history ---------------------------------------------------------------------------------------------------------


@register("history_filter", EV + "SELECT entity_id, version, op FROM ev WHERE author = '3' AND op = 'update' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND version <= 30")
def _(spark, d):
    return history.history(driver.events(spark, d), author="3", op="update", start=FROM, end=TO, max_version=30).select("entity_id", "version", "op")


@register("history_path", EV + "SELECT DISTINCT entity_id, version FROM fc WHERE path = 'type'")
def _(spark, d):
    return history.history(driver.events(spark, d), path="type").select("entity_id", "version")


@register("history_page", EV + "SELECT entity_id, version, ts AS ts_received FROM ev WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND version < 5) ORDER BY ts DESC, version DESC LIMIT 100")
def _(spark, d):
    cursor = jsonx.encode_cursor(v=5, ts=TO.isoformat())
    return history.page(driver.events(spark, d), "ts_received", True, cursor, 100).select("entity_id", "version", "ts_received")


@register("project_native", EV + f"SELECT entity_id, version, path, change_op AS op, {_OLD} AS old, {_NEW} AS new FROM fc")
def _(spark, d):
    c = history.project_native(driver.events(spark, d)).select("entity_id", "version", F.explode("changes").alias("c"))
    return c.select("entity_id", "version", "c.path", "c.op", "c.old", "c.new")


@register("project_json_patch", EV + f""", p AS (SELECT entity_id, version, string_agg('{{"op":"' || CASE WHEN change_op = 'change' THEN 'replace' ELSE change_op END || '","path":"/' || path || '","value":' || {_NEW} || '}}', ',' ORDER BY path) AS body FROM fc GROUP BY ALL)
    SELECT entity_id, version, '[' || coalesce(body, '') || ']' AS patch, FALSE AS inexpressible FROM ev LEFT JOIN p USING (entity_id, version)""")
def _(spark, d):
    return history.project_json_patch(driver.events(spark, d)).select("entity_id", "version", "patch", "inexpressible")


@register("field_changes", EV + "SELECT entity_id, version, path, change_op, old, new, old_num, new_num FROM fc")
def _(spark, d):
    c = history.field_changes(driver.events(spark, d))
    return c.select("entity_id", "version", "path", "change_op", txt(F.col("old")).alias("old"), txt(F.col("new")).alias("new"), num(F.col("old")).alias("old_num"), num(F.col("new")).alias("new_num"))


@register("last_event", EV + "SELECT entity_id, max(version) AS version, arg_max(op, version) AS op, arg_max(seq, version) AS seq FROM ev GROUP BY entity_id")
def _(spark, d):
    return history.last_event(driver.events(spark, d)).select("entity_id", "version", "op", "seq")


@register("validity", EV + "SELECT entity_id, version, ts AS valid_from, lead(ts) OVER (PARTITION BY entity_id ORDER BY version) AS valid_to FROM ev")
def _(spark, d):
    return history.validity(driver.events(spark, d)).select("entity_id", "version", "valid_from", "valid_to")


@register("lives", EV + "SELECT entity_id, version, coalesce(sum(CAST(del AS INT)) OVER (PARTITION BY entity_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM ev")
def _(spark, d):
    return history.lives(driver.events(spark, d)).select("entity_id", "version", "life")


# ---- diff ------------------------------------------------------------------------------------------------------------


@register("change_log", EV + "SELECT entity_id, version, path, change_op AS op, old, new, old_num, new_num FROM fc")
def _(spark, d):
    """Structural diff of every state against its predecessor."""
    c = driver.events(spark, d).select("entity_id", "version", F.explode("changes").alias("c")).select("entity_id", "version", "c.*")
    return c.select("entity_id", "version", "path", "op", txt(F.col("old")).alias("old"), txt(F.col("new")).alias("new"), num(F.col("old")).alias("old_num"), num(F.col("new")).alias("new_num"))


_CUT0, _CUT1, _CUT2 = "1993-01-01", "1997-01-01", "1999-01-01"
_ITEMS = f"""WITH i AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_shipdate) AS s, CAST(max(l_quantity) AS INT) AS q FROM lineitem GROUP BY ALL),
    a AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n) - 1 AS pos FROM i WHERE s <= TIMESTAMP '{_CUT1}'),
    b AS (SELECT o, n, q + n % 2 AS q, row_number() OVER (PARTITION BY o ORDER BY n) - 1 AS pos FROM i WHERE s > TIMESTAMP '{_CUT0}' AND s <= TIMESTAMP '{_CUT2}')"""


def _order_docs(spark, d):
    """Orders as documents: lines shipped until a cut, and lines between two others with every odd line changed."""
    items = driver.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("s"), F.max("l_quantity").cast("int").alias("q"))
    n, time = F.col("l_linenumber"), lambda t: F.lit(t).cast("timestamp")
    sides = {"before": ((F.col("s") <= time(_CUT1)), F.col("q")), "after": ((F.col("s") > time(_CUT0)) & (F.col("s") <= time(_CUT2)), F.col("q") + n % 2)}
    lists = {name: F.array_sort(F.collect_list(F.when(here, F.struct(n.alias("n"), q.alias("q"))))) for name, (here, q) in sides.items()}
    return items.groupBy("l_orderkey").agg(*[F.to_json(F.struct(v.alias("items"))).alias(k) for k, v in lists.items()])


def _item(side: str) -> str:
    return f"""'{{"n":' || {side}.n || ',"q":' || {side}.q || '}}'"""


@register("json_diff_keyed", _ITEMS + f""", j AS (SELECT coalesce(a.o, b.o) AS o, coalesce(a.n, b.n) AS n, a, b FROM a FULL JOIN b ON a.o = b.o AND a.n = b.n)
    SELECT o AS l_orderkey, 'items[n=' || n || ']' || CASE WHEN a.n IS NULL OR b.n IS NULL THEN '' ELSE '.q' END AS path, CASE WHEN a.n IS NULL THEN 'add' WHEN b.n IS NULL THEN 'remove' ELSE 'change' END AS op,
    CASE WHEN b.n IS NULL THEN {_item('a')} WHEN a.n IS NOT NULL THEN CAST(a.q AS VARCHAR) END AS old, CASE WHEN a.n IS NULL THEN {_item('b')} WHEN b.n IS NOT NULL THEN CAST(b.q AS VARCHAR) END AS new
    FROM j WHERE a.n IS NULL OR b.n IS NULL OR a.q <> b.q""")
def _(spark, d):
    out = diff.json_diff(_order_docs(spark, d), "before", "after", {"items": "n"})
    return out.select("l_orderkey", F.explode("changes").alias("c")).select("l_orderkey", "c.*")


@register("json_diff_index", _ITEMS + f""", j AS (SELECT coalesce(a.o, b.o) AS o, coalesce(a.pos, b.pos) AS pos, a, b FROM a FULL JOIN b ON a.o = b.o AND a.pos = b.pos)
    SELECT o AS l_orderkey, 'items.' || pos AS path, CASE WHEN a.n IS NULL THEN 'add' ELSE 'remove' END AS op, CASE WHEN b.n IS NULL THEN {_item('a')} END AS old, CASE WHEN a.n IS NULL THEN {_item('b')} END AS new FROM j WHERE a.n IS NULL OR b.n IS NULL
    UNION ALL SELECT o, 'items.' || pos || '.n', 'change', CAST(a.n AS VARCHAR), CAST(b.n AS VARCHAR) FROM j WHERE a.n <> b.n
    UNION ALL SELECT o, 'items.' || pos || '.q', 'change', CAST(a.q AS VARCHAR), CAST(b.q AS VARCHAR) FROM j WHERE a.q <> b.q""")
def _(spark, d):
    out = diff.json_diff(_order_docs(spark, d), "before", "after")
    return out.select("l_orderkey", F.explode("changes").alias("c")).select("l_orderkey", "c.*")


@register("table_diff", f"""WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS qty, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '{_CUT1}' GROUP BY ALL),
    b AS (SELECT l_orderkey AS k, sum(l_quantity) AS qty, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '{_CUT2}' GROUP BY ALL),
    j AS (SELECT coalesce(a.k, b.k) AS k, a.qty AS aq, b.qty AS bq, a.n_lines AS an, b.n_lines AS bn FROM a FULL JOIN b ON a.k = b.k)
    SELECT k, 'qty' AS path, CASE WHEN aq IS NULL THEN 'add' ELSE 'change' END AS op, aq AS old, bq AS new FROM j WHERE aq IS DISTINCT FROM bq
    UNION ALL SELECT k, 'n_lines', CASE WHEN an IS NULL THEN 'add' ELSE 'change' END, an, bn FROM j WHERE an IS DISTINCT FROM bn""")
def _(spark, d):
    lines = driver.table(spark, d, "lineitem")
    side = lambda cut: lines.where(F.col("l_shipdate") <= F.lit(cut).cast("timestamp")).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n_lines"))
    out = diff.table_diff(side(_CUT1), side(_CUT2), ["k"], ["qty", "n_lines"])
    return out.select("k", "path", "op", F.col("old").cast("double").alias("old"), F.col("new").cast("double").alias("new"))


@register("json_apply", EV + "SELECT entity_id, version, TRUE AS restored FROM ev WHERE NOT del")
def _(spark, d):
    """Applying an event's changes to its base gives its state."""
    e = driver.events(spark, d).where("op <> 'delete'")
    return apply.json_apply(e, "base", "changes").select("entity_id", "version", (F.col("applied") == F.col("state")).alias("restored"))


@register("canonical_json", "SELECT event_id, '{\"a\":' || user_id || ',\"b\":[1,2.5],\"k\":' || json_extract_string(props, '$.k') || '}' AS text FROM events")
def _(spark, d):
    e = driver.table(spark, d, "events")
    raw = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "b":[1.0, 2.50], "a" : '), F.col("user_id").cast("string"), F.lit("}"))
    return e.select("event_id", jsonx.canonical_json(raw).alias("text"))


@register("parse_path", "SELECT l_orderkey, l_linenumber, 5 AS segments, 'n' AS key_field, CAST(l_linenumber AS VARCHAR) AS key_val, l_linenumber AS idx FROM lineitem")
def _(spark, d):
    n = F.col("l_linenumber").cast("string")
    p = jsonx.parse_path(F.concat(F.lit("order.items[n="), n, F.lit("].tags."), n))
    return driver.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.size(p).alias("segments"), p[2]["key_field"].alias("key_field"), p[2]["key_val"].alias("key_val"), p[4]["idx"].alias("idx"))


# ---- as-of -----------------------------------------------------------------------------------------------------------


@register("resolve_version", EV + ", e AS (SELECT DISTINCT entity_id FROM ev), latest AS (SELECT entity_id, max(version) AS latest FROM ev GROUP BY ALL) SELECT e.entity_id, max(version) FILTER (ts <= TIMESTAMP '2024-01-15') AS by_time, least(20, any_value(latest)) AS by_version FROM e JOIN ev USING (entity_id) JOIN latest USING (entity_id) GROUP BY e.entity_id")
def _(spark, d):
    e = driver.events(spark, d)
    keys = e.select(*KEY).distinct()
    probes = keys.withColumns({"at": F.lit(AT), "version": F.lit(None).cast("long")}).unionByName(keys.withColumns({"at": F.lit(None).cast("timestamp"), "version": F.lit(20).cast("long")}))
    out = asof.resolve_version(probes, e)
    return out.groupBy("entity_id").agg(F.max(F.when(F.col("at").isNotNull(), F.col("target"))).alias("by_time"), F.max(F.when(F.col("at").isNull(), F.col("target"))).alias("by_version"))


@register("build_snapshots", EV + "SELECT entity_id, version, del AS deleted FROM ev WHERE version % 10 = 0")
def _(spark, d):
    e = driver.events(spark, d).withColumn("deleted", F.col("op") == "delete")
    return asof.build_snapshots(e, 10).select("entity_id", "version", "deleted")


#: The last non-delete row at or before each version, which a delete keeps showing (a second delete shows nothing).
_SHOWN = EV + """, s AS (SELECT *, CASE WHEN NOT del THEN version WHEN lag(del) OVER w = FALSE THEN version - 1 END AS src FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY version)),
shown AS (SELECT s.entity_id, s.version, s.del AS deleted, s.ts, r.k, r.event_type AS type, r.value FROM s LEFT JOIN ev r ON r.entity_id = s.entity_id AND r.version = s.src)"""


def _fields(df):
    g = lambda n: F.get_json_object("state", f"$.{n}")
    return df.select("entity_id", "version", "deleted", g("k").alias("k"), g("type").alias("type"), g("value").cast("double").alias("value"))


def _log(spark, d) -> DataFrame:
    """The events as a stored log, for queries that read it several times."""
    return tables.stored(driver.events(spark, d).select(*KEY, "version", "ts_received", "op", "changes"), "log")


@register("state_history", _SHOWN + "SELECT entity_id, version, deleted, k, type, value FROM shown")
def _(spark, d):
    return _fields(asof.state_history(driver.events(spark, d)))


@register("state_history_segmented", _SHOWN + "SELECT entity_id, version, deleted, k, type, value FROM shown")
def _(spark, d):
    """The same from snapshots: every segment between two snapshots is replayed on its own."""
    e = _log(spark, d)
    whole = asof.state_history(e)
    return _fields(asof.state_history(e, asof.build_snapshots(whole, 10).select(*KEY, "version", "ts", "deleted", "state"), 10))


def _snapshots(e, interval: int):
    """Snapshots as the write path stores them: each event's own state, behind a delete the one before."""
    dead = F.col("op") == "delete"
    return asof.build_snapshots(e.select(*KEY, "version", F.col("ts_received").alias("ts"), dead.alias("deleted"), F.when(dead, F.col("base")).otherwise(F.col("state")).alias("state")), interval)


@register("state_at", _SHOWN + "SELECT entity_id, max(version) AS version, max_by(ts, version) AS ts, arg_max(deleted, version) AS deleted, arg_max(coalesce(k, '-'), version) AS k, max(version) // 10 * 10 AS snapshot_version FROM shown WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY entity_id")
def _(spark, d):
    e = driver.events(spark, d)
    probes = driver.commands(spark, d).select(*KEY).distinct().withColumn("at", F.lit(AT))
    out = asof.state_at(probes, e, _snapshots(e, 10))
    return out.select("entity_id", "version", "ts", "deleted", F.coalesce(F.get_json_object("state", "$.k"), F.lit("-")).alias("k"), F.coalesce("snapshot_version", F.lit(0)).alias("snapshot_version"))


@register("state_at_many", _SHOWN + """, last AS (SELECT entity_id, max(version) AS latest, max(version) FILTER (ts <= TIMESTAMP '2024-01-15') AS by_time FROM ev GROUP BY ALL),
    q AS (SELECT entity_id, 'v2' AS asked, least(2, latest) AS version FROM last UNION ALL SELECT entity_id, 'v25', least(25, latest) FROM last UNION ALL SELECT entity_id, 'at', by_time FROM last WHERE by_time IS NOT NULL)
    SELECT entity_id, asked, version, ts, deleted, k, type, value, version // 10 * 10 AS snapshot_version, version % 10 AS events_applied FROM q JOIN shown USING (entity_id, version)""")
def _(spark, d):
    """Three probes of every entity, two by version and one by time."""
    e = driver.events(spark, d)
    snaps = asof.build_snapshots(asof.state_history(e), 10).select(*KEY, "version", "ts", "deleted", "state")
    asks = F.array(*[F.struct(F.lit(v).cast("long").alias("version"), F.lit(t).cast("timestamp").alias("at")) for v, t in ((2, None), (25, None), (None, AT))])
    probes = e.select(*KEY).distinct().select(*KEY, F.inline(asks))
    out = asof.state_at(probes, e, snaps)
    asked = F.coalesce(F.concat(F.lit("v"), F.col("asked_version").cast("string")), F.lit("at")).alias("asked")
    g = lambda n: F.get_json_object("state", f"$.{n}")
    return out.select("entity_id", asked, "version", "ts", "deleted", g("k").alias("k"), g("type").alias("type"), g("value").cast("double").alias("value"), F.coalesce("snapshot_version", F.lit(0)).alias("snapshot_version"), "events_applied")


@register("state_at_few", _SHOWN + """SELECT entity_id, version, ts, deleted, k, type, value FROM shown
    WHERE CAST(entity_id AS INT) % 100 = 3 AND version IN (SELECT unnest([5, 17, 30])) """)
def _(spark, d):
    """Three versions of one entity in a hundred: other entities' events leave before anything is shuffled."""
    e = driver.events(spark, d)
    keys = driver.commands(spark, d).select(*KEY).distinct().where(F.col("entity_id").cast("int") % 100 == 3)
    probes = keys.withColumn("version", F.explode(F.array(*[F.lit(v).cast("long") for v in (5, 17, 30)])))
    out = asof.state_at(probes, e, _snapshots(e, 10))
    g = lambda n: F.get_json_object("state", f"$.{n}").alias(n)
    return out.where("asked_version = version").select("entity_id", "version", "ts", "deleted", g("k"), g("type"), g("value").cast("double").alias("value"))


#: The command stream with one user in whose history a third of all commands lie.
_HOT = _SHOWN.replace("CAST(user_id AS VARCHAR) AS entity_id", "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS entity_id")


@register("hot_history", _HOT + "SELECT entity_id, version, deleted, k, type, value FROM shown")
def _(spark, d):
    """The state after every version where one entity holds a third of all events: runs of 50 versions merge and are
    replayed side by side."""
    cmds = driver.commands(spark, d).withColumn("entity_id", F.when(F.col("seq") % 3 == 0, "hot").otherwise(F.col("entity_id")))
    e = tables.stored(ingest.ingest_states(cmds).where("code is null").select(*KEY, "version", "ts_received", "op", "changes"), "hot-events")
    return _fields(compose.parallel_history(e, 50))


_FLAT = EV + """, d0 AS (SELECT entity_id, max(version) FILTER (del) AS death FROM ev WHERE ts <= TIMESTAMP '{at}' GROUP BY ALL),
l AS (SELECT f.entity_id, path, max(version) AS version, arg_max(new, version) AS value, arg_max(new_num, version) AS value_num FROM fc f JOIN d0 ON d0.entity_id = f.entity_id
    WHERE ts <= TIMESTAMP '{at}' AND version > coalesce(death, 0) GROUP BY ALL)"""


@register("state_at_flat", _FLAT.replace("{at}", "2024-01-15") + "SELECT entity_id, path, version, value, value_num FROM l")
def _(spark, d):
    out = asof.state_at_flat(driver.events(spark, d), AT)
    return out.select("entity_id", "path", "version", txt(F.col("value")).alias("value"), num(F.col("value")).alias("value_num"))


@register("flat_legal", EV + "SELECT DISTINCT entity_id, TRUE AS legal FROM ev")
def _(spark, d):
    return asof.flat_legal(driver.events(spark, d)).select("entity_id", "legal")


_BETWEEN = _FLAT.replace("{at}", "2024-01-10").replace("d0 ", "d1 ").replace("d0.", "d1.").replace("l AS", "a AS") + ", " + _FLAT.replace("{at}", "2024-01-20")[len(EV) + 2:].replace("l AS", "z AS") + """,
    r AS (SELECT coalesce(a.entity_id, z.entity_id) AS entity_id, coalesce(a.path, z.path) AS path, CASE WHEN a.entity_id IS NULL THEN 'add' WHEN z.entity_id IS NULL THEN 'remove' ELSE 'change' END AS op
    FROM a FULL JOIN z ON a.entity_id = z.entity_id AND a.path = z.path WHERE a.value IS DISTINCT FROM z.value OR a.value_num IS DISTINCT FROM z.value_num) """


@register("state_between", _BETWEEN + "SELECT entity_id, path, op FROM r")
def _(spark, d):
    out = asof.state_between(driver.events(spark, d), FROM, TO)
    return out.select("entity_id", F.explode("changes").alias("c")).select("entity_id", "c.path", "c.op")


def _nested_events(spark, d):
    """The command stream with two fields inside an object."""
    g = lambda n: F.get_json_object("state", f"$.{n}").alias(n)
    nested = F.to_json(F.struct(F.struct(g("k"), g("type")).alias("d"), g("value").cast("double").alias("value")))
    cmds = driver.commands(spark, d).withColumn("state", F.when(F.col("kind") == "state", nested))
    return ingest.ingest_states(cmds).where("code is null")


@register("state_between_nested", _BETWEEN + "SELECT DISTINCT entity_id, CASE WHEN path = 'value' THEN path WHEN op = 'change' THEN 'd.' || path ELSE 'd' END AS path, op FROM r")
def _(spark, d):
    out = asof.state_between(_nested_events(spark, d), FROM, TO)
    return out.select("entity_id", F.explode("changes").alias("c")).select("entity_id", "c.path", "c.op")


@register("leaves_at", _SHOWN + """, p AS (SELECT entity_id, max(version) AS version FROM ev WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY ALL)
    SELECT entity_id, version, unnest(['d.k', 'd.type', 'value']) AS path, unnest(['"' || k || '"', '"' || type || '"', NULL]) AS value, unnest([NULL, NULL, value]) AS value_num FROM shown JOIN p USING (entity_id, version) WHERE NOT deleted""")
def _(spark, d):
    """Nested documents fail the test for the relational form and are replayed; their leaves come by full paths."""
    out = asof.leaves_at(_nested_events(spark, d), AT)
    return out.select("entity_id", "version", "path", txt(F.col("value")).alias("value"), num(F.col("value")).alias("value_num"))


# ---- chains ----------------------------------------------------------------------------------------------------------


def _chained(spark, d):
    e = driver.events(spark, d)
    links = chain.build_chain(e)
    return e.join(links.select(*KEY, "version", F.struct("hash", "prev_hash").alias("integrity")), [*KEY, "version"])


@register("genesis", "SELECT 'sha256:' || sha256('histspark:genesis:v1:' || p_name) AS genesis, count(*) AS n FROM part GROUP BY ALL")
def _(spark, d):
    return driver.table(spark, d, "part").select(chain.genesis("p_name").alias("genesis")).groupBy("genesis").agg(F.count("*").alias("n"))


_CANON = EV + f""", ch AS (SELECT entity_id, version, string_agg('{{' || CASE WHEN change_op <> 'remove' THEN '"new":' || {_NEW} || ',' ELSE '' END || CASE WHEN change_op <> 'add' THEN '"old":' || {_OLD} || ',' ELSE '' END || '"op":"' || change_op || '","path":"' || path || '"}}', ',' ORDER BY path) AS changes FROM fc GROUP BY ALL),
    cn AS (SELECT ev.entity_id, ev.version, '{{"author":"' || author || '",' || coalesce('"changes":[' || changes || '],', '') || '"entity_id":"' || ev.entity_id || '","flow":{{"id":"f-' || ev.entity_id || '-' || strftime(ts, '%Y%m%d') || '"}},"op":"' || op || '","source":"' || event_type || '","ts_source":"'
    || regexp_replace(regexp_replace(strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g'), '0+$', ''), '\\.$', '') || 'Z"}}' AS canonical FROM ev LEFT JOIN ch ON ch.entity_id = ev.entity_id AND ch.version = ev.version)
"""


@register("event_canonical", _CANON + "SELECT entity_id, version, canonical FROM cn")
def _(spark, d):
    e = driver.events(spark, d)
    return e.select("entity_id", "version", chain.event_canonical(e).alias("canonical"))


@register("chain_starts", _CANON + """, one AS (SELECT entity_id, 'sha256:' || sha256('sha256:' || sha256('histspark:genesis:v1:app.users') || canonical) AS hash FROM cn WHERE version = 1)
    SELECT cn.entity_id, one.hash AS first_hash, 'sha256:' || sha256(one.hash || canonical) AS second_hash FROM cn JOIN one ON one.entity_id = cn.entity_id WHERE version = 2""")
def _(spark, d):
    """The first two links of every chain."""
    links = chain.build_chain(driver.events(spark, d)).where("version <= 2")
    pick = lambda v: F.max(F.when(F.col("version") == v, F.col("hash")))
    return links.groupBy("entity_id").agg(pick(1).alias("first_hash"), pick(2).alias("second_hash")).where("second_hash is not null")


@register("verify_chain", EV + "SELECT entity_id, 3 AS version, 'bad_hash' AS problem, TRUE AS first FROM ev WHERE version = 3")
def _(spark, d):
    """Version 3 of every entity is altered behind its hash: exactly those links break."""
    e = _chained(spark, d).withColumn("author", F.when(F.col("version") == 3, "someone").otherwise(F.col("author")))
    return chain.verify_chain(e).select("entity_id", "version", "problem", "first")


@register("chain_gaps", EV + "SELECT entity_id, count(*) - 1 AS events, count(*) - 1 AS versions, max(version) AS latest FROM ev GROUP BY entity_id HAVING count(*) > 2")
def _(spark, d):
    return chain.chain_gaps(driver.events(spark, d).where("version <> 2")).select("entity_id", "events", "versions", "latest")


# ---- rules and deliveries --------------------------------------------------------------------------------------------

RULES = [
    {"id": "r1", "name": "updates", "collection": "app.users", "condition": {"all": [{"field": "op", "op": "eq", "value": "update"}, {"field": "author_id", "op": "in", "value": [1, 2, 3]}, {"not": {"field": "entity_id", "op": "lt", "value": 10}}]}, "actions": [{"type": "log", "level": "warning", "message": "m"}, {"type": "webhook", "url": "https://example.test/h", "secret_ref": "s1"}]},
    {"id": "r2", "name": "bought", "collection": "app.users", "condition": {"match": {"path": "*", "op": "change", "new": "purchase"}}, "actions": [{"type": "webhook", "url": "https://example.test/p", "secret_ref": "s2", "max_attempts": 3}]},
    {"id": "r3", "name": "off", "enabled": False, "condition": {"all": []}, "actions": [{"type": "log"}]},
    {"id": "r4", "name": "broken", "condition": {"field": "nope", "op": "eq", "value": 1}, "actions": [{"type": "log"}]},
    {"id": "r5", "name": "pattern", "condition": {"any": [{"field": "source", "op": "regex", "value": "^sign"}, {"field": "entity_id", "op": "gte", "value": 1e9}]}, "actions": [{"type": "log"}]},
]
_MATCH = EV + """, m AS (
    SELECT entity_id, version, 'r1' AS rule_id, 0 AS action, 'log' AS type FROM ev WHERE op = 'update' AND author IN ('1', '2', '3') AND CAST(entity_id AS INT) >= 10
    UNION ALL SELECT entity_id, version, 'r1', 1, 'webhook' FROM ev WHERE op = 'update' AND author IN ('1', '2', '3') AND CAST(entity_id AS INT) >= 10
    UNION ALL SELECT entity_id, version, 'r2', 0, 'webhook' FROM fc WHERE path = 'type' AND change_op = 'change' AND new = '"purchase"'
    UNION ALL SELECT entity_id, version, 'r5', 0, 'log' FROM ev WHERE event_type LIKE 'sign%')"""


@register("match_rules", _MATCH + "SELECT * FROM m")
def _(spark, d):
    return rules.match_rules(driver.events(spark, d), RULES).select("entity_id", "version", "rule_id", "action", "type")


def _many_rules(n: int = 5_000) -> list[dict]:
    """``n`` rules of five kinds: one entity; an author's later entities; a changed type of two entities; an entity or an
    author's purchases; a collection of its own."""
    field = lambda f, op, v: {"field": f, "op": op, "value": v}
    kinds = (
        lambda i: field("entity_id", "eq", i),
        lambda i: {"all": [field("author_id", "eq", i % 10), field("entity_id", "gte", i)]},
        lambda i: {"all": [{"match": {"path": "type", "op": "change"}}, field("entity_id", "in", [i, i + 7])]},
        lambda i: {"any": [field("entity_id", "eq", i), {"all": [field("source", "eq", "purchase"), field("author_id", "eq", i % 10), field("entity_id", "lt", 20)]}]},
        lambda i: field("source", "regex", "^sign") if i == 4 else field("op", "eq", "create"),
    )
    own = lambda i: {"collection": "other.c"} if i % 5 == 4 and i > 4 else {}
    return [{"id": f"r{i}", "name": f"r{i}", "condition": kinds[i % 5](i), "actions": [{"type": "log"}], **own(i)} for i in range(n)]


@register("match_rules_indexed", EV + """, r AS (SELECT unnest(range(5000)) AS i), e AS (SELECT *, CAST(entity_id AS INT) AS u FROM ev),
    typed AS (SELECT entity_id, version, CAST(entity_id AS INT) AS u FROM fc WHERE path = 'type' AND change_op = 'change'),
    m AS (SELECT entity_id, version, i FROM e JOIN r ON u = i WHERE i % 5 = 0
    UNION ALL SELECT entity_id, version, i FROM e JOIN r ON u % 10 = i % 10 AND u >= i WHERE i % 5 = 1
    UNION ALL SELECT entity_id, version, i FROM typed JOIN r ON u = i OR u = i + 7 WHERE i % 5 = 2
    UNION ALL SELECT entity_id, version, i FROM e JOIN r ON u = i OR (event_type = 'purchase' AND u % 10 = i % 10 AND u < 20) WHERE i % 5 = 3
    UNION ALL SELECT entity_id, version, 4 FROM e WHERE event_type LIKE 'sign%')
    SELECT entity_id, version, 'r' || i AS rule_id FROM m""")
def _(spark, d):
    return rule_index.match_rules_indexed(driver.events(spark, d), _many_rules()).select("entity_id", "version", "rule_id")


@register("rule_match_counts", _MATCH + "SELECT 't' AS tenant, type, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d):
    return catalog.rule_match_counts(rules.match_rules(driver.events(spark, d), RULES))


@register("log_alerts", _MATCH + "SELECT rule_id, CASE WHEN rule_id = 'r1' THEN 'warn' ELSE 'info' END AS level, count(*) AS n FROM m WHERE type = 'log' GROUP BY ALL")
def _(spark, d):
    return rules.log_alerts(rules.match_rules(driver.events(spark, d), RULES)).groupBy("rule_id", "level").agg(F.count("*").alias("n"))


@register("duplicate_rules", "SELECT p_brand AS collection, p_name AS name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return rules.duplicate_rules(driver.table(spark, d, "part").select(F.col("p_brand").alias("collection"), F.col("p_name").alias("name")))


def _outbox(spark, d):
    return delivery.delivery_outbox(rules.match_rules(driver.events(spark, d), RULES))


@register("delivery_outbox", _MATCH + "SELECT sha256(concat_ws('|', 't', 'app.users', entity_id, CAST(version AS VARCHAR), rule_id, CAST(action AS VARCHAR))) AS delivery_id, entity_id, version, rule_id, CASE WHEN rule_id = 'r2' THEN 3 ELSE 5 END AS max_attempts, 5000 AS timeout_ms FROM m WHERE type = 'webhook'")
def _(spark, d):
    return _outbox(spark, d).select("delivery_id", "entity_id", "version", "rule_id", "max_attempts", "timeout_ms")


@register("signed_outbox")
def _(spark, d):
    """HMAC signatures have no SQL; tests compare them with Python's hmac."""
    return delivery.signed(_outbox(spark, d), {"s1": "first", "s2": "second"}).select("delivery_id", "signature")


#: Attempts of a delivery in these queries, near the mean number of error and signup events of a user.
_ATTEMPTS = 27


def _attempts(spark, d):
    e = driver.table(spark, d, "events")
    mine = e.where(F.col("event_type").isin("error", "signup"))
    done = (F.col("event_type") == "signup") & (F.col("user_id") % 3 == 0) & (F.col("event_id") % 7 == 0)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return mine.select(F.col("user_id").cast("string").alias("delivery_id"), n.alias("attempt"), F.col("ts").alias("at"), F.when(done, 200).otherwise(500).alias("status"), F.lit(False).alias("blocked"), F.col("event_type").alias("result"), (F.col("value") / 100).alias("seconds"))


def _user_outbox(spark, d):
    u = driver.table(spark, d, "events").select("user_id").distinct()
    return u.select(F.col("user_id").cast("string").alias("delivery_id"), F.lit("t").alias("tenant"), F.lit("app.users").alias("collection"), F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("rule_id"), F.lit("u").alias("url"), F.when(F.col("user_id") % 9 == 0, "lost").otherwise("s1").alias("secret_ref"), F.lit(_ATTEMPTS).alias("max_attempts"), F.lit("{}").alias("body"))


_RETRY = f"""WITH a AS (SELECT user_id, ts, event_type, value, event_type = 'signup' AND user_id % 3 = 0 AND event_id % 7 = 0 AS done FROM events WHERE event_type IN ('error', 'signup')),
l AS (SELECT user_id, count(*) AS attempts, bool_or(done) AS ok, max(ts) AS last_at FROM a GROUP BY ALL),
p AS (SELECT u.user_id, coalesce(attempts, 0) AS attempts, CASE WHEN coalesce(ok, FALSE) THEN 'delivered' WHEN u.user_id % 9 = 0 THEN 'dead' WHEN coalesce(attempts, 0) >= {_ATTEMPTS} THEN 'dead' ELSE 'pending' END AS state,
    u.user_id % 9 = 0 AS lost, last_at FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l ON l.user_id = u.user_id)"""


@register("plan_retries", _RETRY + f"""SELECT CAST(user_id AS VARCHAR) AS delivery_id, attempts, state, CASE WHEN state = 'dead' THEN CASE WHEN lost THEN 'unknown_secret' ELSE 'attempts_exhausted' END END AS reason,
    CASE WHEN state = 'pending' AND attempts > 0 THEN last_at + INTERVAL 1 MICROSECOND * CAST(1000000 * least(0.5 * pow(2, attempts - 1), {delivery.MAX_S}) AS BIGINT) END AS next_attempt_at FROM p""")
def _(spark, d):
    out = delivery.plan_retries(_user_outbox(spark, d), _attempts(spark, d), ["s1"])
    return out.select("delivery_id", "attempts", "state", "reason", "next_attempt_at")


def _dlq(spark, d):
    dead = delivery.dead_letters(delivery.plan_retries(_user_outbox(spark, d), _attempts(spark, d), ["s1"]))
    return dead.withColumn("failed_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id").cast("long") % 50))


@register("dlq_list", _RETRY + "SELECT CAST(user_id AS VARCHAR) AS id, 'r' || (user_id % 4) AS rule_id FROM p WHERE state = 'dead' AND user_id % 4 = 1 ORDER BY user_id % 50 DESC, CAST(user_id AS VARCHAR) DESC LIMIT 20")
def _(spark, d):
    return delivery.dlq_list(_dlq(spark, d), "r1", 20).select("id", "rule_id")


@register("dlq_counts", _RETRY + "SELECT tenant, rule_id, count(*) AS n FROM (SELECT 't' AS tenant, 'r' || (user_id % 4) AS rule_id FROM p WHERE state = 'dead') GROUP BY ROLLUP (tenant, rule_id)")
def _(spark, d):
    return catalog.dlq_counts(_dlq(spark, d))


@register("redeliver", _RETRY + "SELECT 'outbox' AS part, count(*) AS n FROM p WHERE state = 'dead' AND user_id % 4 = 1 AND user_id % 2 = 1 UNION ALL SELECT 'remaining', count(*) FROM p WHERE state = 'dead' AND NOT (user_id % 4 = 1) UNION ALL SELECT 'missing', count(*) FROM p WHERE user_id % 2 = 1 AND NOT (state = 'dead' AND user_id % 4 = 1)")
def _(spark, d):
    ids = driver.table(spark, d, "events").where("user_id % 2 = 1").select(F.col("user_id").cast("string").alias("id")).distinct()
    parts = zip(("outbox", "remaining", "missing"), delivery.redeliver(_dlq(spark, d), ids, "r1"), strict=True)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts]
    return out[0].union(out[1]).union(out[2])


@register("delivery_stats", _RETRY.split(",\nl AS")[0] + ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM a) SELECT event_type AS result, count(*) AS n, count(*) FILTER (rn > 1) AS retries, count(*) FILTER (value / 100 <= 0.25) AS le_0_25, count(*) FILTER (value / 100 <= 1) AS le_1 FROM n GROUP BY ALL")
def _(spark, d):
    return catalog.delivery_stats(_attempts(spark, d)).select("result", "n", "retries", "le_0_25", "le_1")


# ---- flows -----------------------------------------------------------------------------------------------------------


def _nodes(spark, d):
    return flows.flow_nodes(driver.activities(spark, d), driver.events(spark, d))


_NODES = EV + """, fl AS (SELECT 'f-' || entity_id || '-' || strftime(ts, '%Y%m%d') AS flow_id, 'app.users/' || entity_id || '/' || version AS node_id, 'event' AS kind, ts, 0 AS causes, 'e|app.users|' || entity_id || '|' || version AS ord FROM ev
    UNION ALL SELECT CAST(conv_id AS VARCHAR), conv_id || '-' || turn, 'activity', make_timestamp(turn * 1000000), CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END, 'a|' || conv_id || '-' || turn FROM conversations),
    ids AS (SELECT DISTINCT conv_id || '-' || turn AS id FROM conversations)"""


@register("assemble_flow", _NODES + "SELECT flow_id, node_id, kind, row_number() OVER (PARTITION BY flow_id ORDER BY ts, ord) AS place FROM fl")
def _(spark, d):
    return flows.assemble_flow(_nodes(spark, d)).select("flow_id", "node_id", "kind", "place")


@register("flow_page", _NODES + "SELECT flow_id, node_id FROM fl WHERE flow_id = '3' ORDER BY ts, ord LIMIT 3")
def _(spark, d):
    return flows.flow_page(_nodes(spark, d), "3", None, 2).select("flow_id", "node_id")


@register("flow_ties", EV + """, n AS (SELECT user_id % 20 AS f, 'a|' || event_id AS ord FROM events UNION ALL SELECT CAST(entity_id AS INT) % 20, 'e|app.users|' || entity_id || '|' || version FROM ev)
    SELECT CAST(f AS VARCHAR) AS flow_id, ord, row_number() OVER (PARTITION BY f ORDER BY ord) AS place FROM n""")
def _(spark, d):
    """Nodes of one instant: activities come first, then events by collection, entity and version as text."""
    one = {"flow_id": (F.col("entity_id").cast("int") % 20).cast("string"), "ts_received": F.lit(AT)}
    e = driver.events(spark, d).withColumns({"ts_received": one["ts_received"], "flow": F.struct(one["flow_id"].alias("id"), F.col("flow.caused_by").alias("caused_by"), F.col("flow.step").alias("step"))})
    a = driver.commands(spark, d).select("tenant", F.col("event_id").alias("activity_id"), F.col("source").alias("type"), one["flow_id"].alias("flow_id"), one["ts_received"].alias("ts_received"), F.col("flow.caused_by").alias("caused_by"))
    n = flows.flow_nodes(a, e)
    return flows.assemble_flow(n.withColumn("ord", flows.node_order(n))).select("flow_id", "ord", "place")


_EDGES = _NODES + """, c AS (SELECT DISTINCT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
    ed AS (SELECT CAST(conv_id AS VARCHAR) AS flow_id, conv_id || '-' || turn AS child, i.id AS cause, i.id IS NULL AS dangling FROM c LEFT JOIN ids i ON i.id = conv_id || '-' || (turn - 1) WHERE turn > first)"""


@register("flow_edges", _EDGES + "SELECT flow_id, child, cause, dangling FROM ed")
def _(spark, d):
    return flows.flow_edges(_nodes(spark, d)).select("flow_id", "child", "cause", "dangling")


@register("flow_summary", _EDGES + """, dn AS (SELECT flow_id, count(*) FILTER (dangling) AS dangling FROM ed GROUP BY ALL)
    SELECT fl.flow_id, count(*) AS nodes, count(*) FILTER (kind = 'event') AS events, count(*) FILTER (kind = 'activity') AS activities, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (causes = 0) AS roots,
    coalesce(any_value(dn.dangling), 0) AS dangling FROM fl LEFT JOIN dn ON dn.flow_id = fl.flow_id GROUP BY fl.flow_id""")
def _(spark, d):
    n = _nodes(spark, d)
    return flows.flow_summary(n, flows.flow_edges(n)).drop("tenant")


@register("flow_lineage", _EDGES.replace("WITH cmd", "WITH RECURSIVE cmd", 1) + """, s AS (SELECT DISTINCT child AS node, cause AS ancestor FROM ed WHERE cause IS NOT NULL),
    r AS (SELECT node, ancestor, 1 AS distance FROM s UNION SELECT r.node, s.ancestor, r.distance + 1 FROM r JOIN s ON s.node = r.ancestor WHERE r.distance < 3)
    SELECT node, ancestor, min(distance) AS distance FROM r GROUP BY ALL""")
def _(spark, d):
    return flows.flow_lineage(flows.flow_edges(_nodes(spark, d)), 3).drop("tenant")


@register("flow_closure", _EDGES.replace("WITH cmd", "WITH RECURSIVE cmd", 1) + """, s AS (SELECT DISTINCT child AS node, cause AS ancestor FROM ed WHERE cause IS NOT NULL),
    r AS (SELECT node, ancestor, 1 AS distance FROM s UNION SELECT r.node, s.ancestor, r.distance + 1 FROM r JOIN s ON s.node = r.ancestor)
    SELECT node, ancestor, min(distance) AS distance, FALSE AS cycle FROM r GROUP BY ALL""")
def _(spark, d):
    return flows.flow_closure(flows.flow_edges(_nodes(spark, d))).drop("tenant")


@register("flow_closure_chains", EV + "SELECT a.entity_id, a.version AS node, b.version AS ancestor, a.version - b.version AS distance FROM ev a JOIN ev b ON a.entity_id = b.entity_id AND a.version > b.version")
def _(spark, d):
    """Each event is caused by the entity's event before it: chains as long as histories."""
    name = lambda v: F.concat_ws("/", "entity_id", v.cast("string"))
    v = F.col("version")
    e = driver.events(spark, d).select("tenant", name(v).alias("child"), F.when(v > 1, name(v - 1)).alias("cause"))
    at = lambda c: F.substring_index(c, "/", -1).cast("long")
    return flows.flow_closure(e).select(F.substring_index("node", "/", 1).alias("entity_id"), at("node").alias("node"), at("ancestor").alias("ancestor"), "distance")


@register("flows_of_entity", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderkey % 100 AS VARCHAR) AS flow_id FROM orders")
def _(spark, d):
    ref = F.struct(F.lit(None).cast("string").alias("activity_id"), F.lit("crm.customers").alias("collection"), F.col("o_custkey").cast("string").alias("entity_id"))
    a = driver.table(spark, d, "orders").select(F.lit("t").alias("tenant"), (F.col("o_orderkey") % 100).cast("string").alias("flow_id"), F.array(ref).alias("refs"))
    return flows.flows_of_entity(a).select("entity_id", "flow_id")


@register("valid_flow_refs", "SELECT role, role <> 'user' AS ok, count(*) AS n FROM conversations GROUP BY ALL")
def _(spark, d):
    user = F.col("role") == "user"
    ref = F.struct(F.when(user, "").otherwise("a").alias("activity_id"), F.when(user, "c").alias("collection"), F.lit(None).cast("string").alias("entity_id"))
    c = driver.table(spark, d, "conversations").select("role", F.array(ref).alias("refs"))
    return c.select("role", flows.valid_flow_refs("refs").alias("ok")).groupBy("role", "ok").agg(F.count("*").alias("n"))


# ---- catalog, statistics, lifecycle ----------------------------------------------------------------------------------


def _config(spark, d):
    s = driver.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("c"), k.cast("string")).alias("name"), F.when(k % 2 == 0, "strict").when(k % 5 == 0, "odd").otherwise("").alias("reliability_mode"), F.when(k % 3 == 0, "update").alias("first_event_op"), F.lit(None).cast("string").alias("ordering_mode"),
        F.when(k % 7 == 0, -1).otherwise(0).cast("long").alias("snapshot_interval"), F.lit("").alias("retention_type"), F.when(k % 4 == 0, 2048).cast("long").alias("max_event_size_bytes"),
    )


@register("effective_config", "SELECT 'c' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'strict' WHEN s_suppkey % 5 = 0 THEN 'odd' ELSE 'durable' END AS reliability_mode, CASE WHEN s_suppkey % 3 = 0 THEN 'update' ELSE 'create' END AS first_event_op, 'received' AS ordering_mode, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE 100 END AS snapshot_interval, CASE WHEN s_suppkey % 4 = 0 THEN 2048 ELSE 1048576 END AS max_event_size_bytes FROM supplier")
def _(spark, d):
    return catalog.effective_config(_config(spark, d)).select("name", "reliability_mode", "first_event_op", "ordering_mode", "snapshot_interval", "max_event_size_bytes")


@register("defaulted_fields", "SELECT 'c' || s_suppkey AS name, 2 + CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END + CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS n FROM supplier")
def _(spark, d):
    return catalog.effective_config(_config(spark, d)).select("name", F.size("defaulted").alias("n"))


@register("validate_config", "SELECT CASE WHEN s_suppkey % 2 <> 0 AND s_suppkey % 5 = 0 THEN 'reliability_mode' WHEN s_suppkey % 7 = 0 THEN 'snapshot_interval' END AS invalid_field, count(*) AS n FROM supplier GROUP BY ALL")
def _(spark, d):
    return catalog.validate_config(_config(spark, d)).groupBy("invalid_field").agg(F.count("*").alias("n"))


@register("config_audit", """WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'strict' WHEN s_suppkey % 5 = 0 THEN 'odd' ELSE '' END AS mode FROM supplier),
    v AS (SELECT k, CASE WHEN k % 3 = 0 OR k % 5 <> 0 THEN mode END AS a, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 7 = 0 AND k % 5 <> 0 THEN 'fast' ELSE mode END END AS b FROM c)
    SELECT CASE WHEN b IS NULL THEN 'collection.deleted' WHEN a IS NULL THEN 'collection.created' ELSE 'collection.updated' END AS action, 'c' || k AS target, 'admin' AS actor, TIMESTAMP '2024-01-15' AS ts,
    '{"reliability_mode":"' || a || '"}' AS old, '{"reliability_mode":"' || b || '"}' AS new FROM v WHERE a IS DISTINCT FROM b""")
def _(spark, d):
    k = F.substring("name", 2, F.lit(20)).cast("long")
    cfg = _config(spark, d).select("name", "reliability_mode")
    old = cfg.where((k % 3 == 0) | (k % 5 != 0))
    new = cfg.where(k % 3 != 0).withColumn("reliability_mode", F.when((k % 7 == 0) & (k % 5 != 0), "fast").otherwise(F.col("reliability_mode")))
    return catalog.config_audit(old, new, actor="admin", at=AT)


def _crm(spark, d):
    o = driver.table(spark, d, "orders").select(F.lit("crm.orders").alias("collection"), F.col("o_orderkey").cast("string").alias("entity_id"), F.col("o_orderdate").alias("ts_stored"))
    c = driver.table(spark, d, "customer").select(F.lit("crm.customers").alias("collection"), F.col("c_custkey").cast("string").alias("entity_id"), F.lit(None).cast("timestamp").alias("ts_stored"))
    return o.unionByName(c)


@register("collection_stats", "SELECT 'crm.orders' AS name, count(DISTINCT o_orderkey) AS entities, count(*) AS events, max(o_orderdate) AS last_event_at FROM orders UNION ALL SELECT 'crm.customers', count(DISTINCT c_custkey), count(*), NULL FROM customer UNION ALL SELECT 'crm.empty', 0, 0, NULL")
def _(spark, d):
    e = _crm(spark, d)
    cfg = spark.range(2).select(F.when(F.col("id") == 0, "crm.empty").otherwise("_system").alias("name"))
    return catalog.collection_stats(e, e.select("collection", "entity_id").distinct(), cfg)


@register("catalog", "SELECT 'crm.orders' AS name, count(*) AS events, 'durable' AS reliability_mode, 7 AS snapshot_interval FROM orders UNION ALL SELECT 'crm.customers', count(*), 'durable', 100 FROM customer")
def _(spark, d):
    e = _crm(spark, d)
    cfg = spark.range(1).select(F.lit("crm.orders").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("reliability_mode", "first_event_op", "ordering_mode", "retention_type")], F.lit(7).cast("long").alias("snapshot_interval"), F.lit(None).cast("long").alias("max_event_size_bytes"))
    stats = catalog.collection_stats(e, e.select("collection", "entity_id").distinct(), cfg)
    return catalog.catalog(stats, cfg).select("name", "events", "reliability_mode", "snapshot_interval")


@register("mask_collections", "SELECT p_brand, lower(p_brand) = 'brand#1' OR lower(p_brand) = 'brand#2' AS shown, count(*) AS n FROM part GROUP BY ALL")
def _(spark, d):
    p = driver.table(spark, d, "part")
    name = F.concat(F.lit("x."), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(".")))
    return p.select("p_brand", jsonx.collection_mask(name, ["x.brand.1.*", "x.brand.2", "y.*"]).alias("shown")).groupBy("p_brand", "shown").agg(F.count("*").alias("n"))


@register("mask_table", """WITH n AS (SELECT s_suppkey AS k, 'crm.' || CASE s_suppkey % 4 WHEN 0 THEN 'deals' WHEN 1 THEN 'deals.eu' WHEN 2 THEN 'leads' ELSE 'a' || s_suppkey END AS c FROM supplier)
    SELECT k, 'all' AS reader FROM n UNION ALL SELECT k, 'deals' FROM n WHERE c = 'crm.deals' OR c LIKE 'crm.deals.%' UNION ALL SELECT k, 'two' FROM n WHERE c IN ('crm.leads', 'crm.a7')""")
def _(spark, d):
    """Readers' masks as a table: all, one collection and below (named twice), and two single ones."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "deals").when(k % 4 == 1, "deals.eu").when(k % 4 == 2, "leads").otherwise(F.concat(F.lit("a"), k.cast("string")))
    rows = driver.table(spark, d, "supplier").select(k.alias("k"), F.concat(F.lit("crm."), name).alias("collection"))
    masks = [("all", "*"), ("deals", "crm.deals.*"), ("deals", "crm.deals"), ("two", "crm.leads"), ("two", "crm.a7"), ("none", "crm"), ("none", "sales.*")]
    return catalog.shown_to(rows, spark.createDataFrame(masks, "reader string, pattern string")).select("k", "reader")


@register("valid_collection", "SELECT p_name, regexp_full_match(replace(p_name, ' ', '.'), '[a-z0-9]+(\\.[a-z0-9]+)*') AS ok, replace(replace(p_name, ' ', '.'), '.', '_') AS physical, count(*) AS n FROM part GROUP BY ALL")
def _(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    p = driver.table(spark, d, "part").select("p_name", jsonx.valid_collection(name).alias("ok"), jsonx.physical_name(name).alias("physical"))
    return p.groupBy("p_name", "ok", "physical").agg(F.count("*").alias("n"))


@register("accept_counts", "SELECT n_name AS tenant, CASE WHEN c_acctbal < 0 THEN 'strict' ELSE 'durable' END AS mode, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _(spark, d):
    c = driver.table(spark, d, "customer").join(driver.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return catalog.accept_counts(c.select(F.col("n_name").alias("tenant"), F.when(F.col("c_acctbal") < 0, "strict").otherwise("durable").alias("mode")))


@register("usage_by_tenant", "SELECT CAST(user_id % 5 AS VARCHAR) AS tenant, event_type AS op, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n FROM events GROUP BY ALL")
def _(spark, d):
    e = driver.table(spark, d, "events")
    return catalog.usage_by_tenant(e.select((F.col("user_id") % 5).cast("string").alias("tenant"), F.col("event_type").alias("op"), F.get_json_object("props", "$.k").cast("long").alias("n")))


@register("activity_by", EV + "SELECT author, op, count(*) AS n FROM ev GROUP BY CUBE (author, op)")
def _(spark, d):
    return catalog.activity_by(driver.events(spark, d), "author", "op")


@register("latency_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY ALL")
def _(spark, d):
    return catalog.latency_percentiles(driver.table(spark, d, "events"), "value", "event_type", exact=True)


@register("latency_sketches", "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, TRUE AS p50_close, TRUE AS p99_close FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL")
def _(spark, d):
    """Percentiles of a range of stored windows, and whether their ranks among the rows are within 1%."""
    e = driver.table(spark, d, "events")
    path = _folder(spark, "sketches")
    catalog.latency_sketches(e, "value", "ts", "event_type").write.parquet(path)
    got = catalog.sketched_percentiles(spark.read.parquet(path), "event_type", since=FROM, until=TO)
    rows = e.where((F.col("ts") >= F.lit(FROM)) & (F.col("ts") < F.lit(TO))).select("event_type", "value").join(F.broadcast(got), "event_type")
    share = lambda test: F.count_if(test) / F.count("*")
    close = lambda p, r: (share(F.col("value") < F.col(p)) <= r + 0.01) & (share(F.col("value") <= F.col(p)) >= r - 0.01)
    return rows.groupBy("event_type", "n", "low", "high").agg(close("p50", 0.5).alias("p50_close"), close("p99", 0.99).alias("p99_close"))


@register("depth_over_time", """WITH s AS (SELECT event_type AS queue, ts AS "at", event_id AS id, 1 AS step FROM events UNION ALL SELECT event_type, ts + INTERVAL 1 HOUR, event_id, -1 FROM events WHERE event_id % 4 <> 0)
    SELECT queue, id, step, sum(step) OVER (PARTITION BY queue ORDER BY "at", step DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM s""")
def _(spark, d):
    e = driver.table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return catalog.depth_over_time(e, e.where("id % 4 <> 0").withColumn("at", F.expr("at + INTERVAL 1 HOUR"))).select("queue", "id", "step", "depth")


@register("lag_report", "SELECT event_type AS queue, arg_max(greatest(value - 50, 0), ts) AS lag_s FROM events WHERE user_id % 3 <> 0 GROUP BY ALL")
def _(spark, d):
    e = driver.table(spark, d, "events")
    shift = F.timestamp_micros(F.unix_micros("ts") - F.round((F.col("value") - 50) * 1e6).cast("long"))
    m = e.select(F.col("event_type").alias("queue"), F.col("ts").alias("stored_at"), F.when(F.col("user_id") % 3 != 0, shift).alias("enqueued_at"))
    return catalog.lag_report(m).withColumn("lag_s", F.round("lag_s", 6))


@register("backlog", "SELECT event_type AS queue, count(*) FILTER (event_type <> 'click' AND event_id % 4 <> 0) AS depth FROM events GROUP BY ALL")
def _(spark, d):
    e = driver.table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("id"))
    return catalog.backlog(e, e.where("queue = 'click' or id % 4 = 0"))


@register("alert_rules", """WITH m AS (SELECT event_type AS name, ts, value FROM events), h AS (SELECT name, unnest(range(0, 3)) AS i, ts, value FROM m),
    w AS (SELECT name, date_trunc('hour', ts) + INTERVAL 1 HOUR * (i + 1) AS "at", sum(value) AS total FROM h GROUP BY ALL),
    f AS (SELECT *, sum(CASE WHEN total > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY "at" RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) = 2 AS firing FROM w)
    SELECT name, "at", firing FROM f""")
def _(spark, d):
    m = driver.table(spark, d, "events").select(F.col("event_type").alias("name"), "ts", "value")
    return catalog.alert_rules(m, 600, "3 hours", "1 hour", 2).select("name", "at", "firing")


@register("ratio_alerts", """WITH h AS (SELECT CAST(user_id % 7 AS VARCHAR) AS name, event_type, unnest(range(0, 3)) AS i, ts FROM events),
    w AS (SELECT name, date_trunc('hour', ts) + INTERVAL 1 HOUR * (i + 1) AS "at", count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'click') AS good FROM h GROUP BY ALL)
    SELECT name, "at", bad, good, sum(CASE WHEN bad > good THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY "at" RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) = 2 AS firing FROM w""")
def _(spark, d):
    """Errors outnumber clicks in a trailing window, twice on end by time."""
    e = driver.table(spark, d, "events")
    m = e.select((F.col("user_id") % 7).cast("string").alias("name"), F.col("event_type").alias("result"), "ts", F.lit(1).alias("value"))
    return catalog.ratio_alerts(m, "error", "click", "3 hours", "1 hour", 2)


@register("apply_retention", EV + ", r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) AS newest FROM ev) SELECT newest <= 5 AS kept, count(*) AS n, count(DISTINCT entity_id) AS entities FROM r GROUP BY ALL")
def _(spark, d):
    cfg = spark.range(1).select(F.lit("app.users").alias("name"), F.lit("versions").alias("retention_type"), F.lit(5).alias("retention_value"))
    kept, dropped = lifecycle.apply_retention(driver.events(spark, d), cfg, TO)
    both = kept.select(F.lit(True).alias("kept"), "entity_id").union(dropped.select(F.lit(False), "entity_id"))
    return both.groupBy("kept").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))


@register("retention_days", EV + "SELECT ts >= TIMESTAMP '2024-01-15' AS kept, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, d):
    cfg = spark.range(1).select(F.lit("app.users").alias("name"), F.lit("days").alias("retention_type"), F.lit(5).alias("retention_value"))
    kept, dropped = lifecycle.apply_retention(driver.events(spark, d), cfg, TO)
    return kept.select(F.lit(True).alias("kept")).union(dropped.select(F.lit(False))).groupBy("kept").agg(F.count("*").alias("n"))


@register("retention_unset", EV + "SELECT entity_id, version, kind, kind = 'forever' OR kind = 'days' AS kept FROM ev, (VALUES ('days'), ('forever'), ('zero')) k(kind) WHERE kind <> 'zero' UNION ALL SELECT entity_id, version, 'zero', TRUE FROM ev")
def _(spark, d):
    """A policy without a value, or with none above 0, keeps every event."""
    e, out = tables.stored(driver.events(spark, d).select(*KEY, "version", "ts_received"), "events"), []
    for kind, (type_, value) in {"days": ("days", None), "forever": ("forever", None), "zero": ("versions", 0)}.items():
        cfg = spark.range(1).select(F.lit("app.users").alias("name"), F.lit(type_).alias("retention_type"), F.lit(value).cast("int").alias("retention_value"))
        out += [part.select("entity_id", "version", F.lit(kind).alias("kind"), F.lit(kept).alias("kept")) for part, kept in zip(lifecycle.apply_retention(e, cfg, TO), (True, False), strict=True)]
    return functools.reduce(DataFrame.union, out)


@register("cut_versions", EV + "SELECT entity_id, max(version) - 5 AS version FROM ev GROUP BY entity_id HAVING max(version) > 5")
def _(spark, d):
    cfg = spark.range(1).select(F.lit("app.users").alias("name"), F.lit("versions").alias("retention_type"), F.lit(5).alias("retention_value"))
    return lifecycle.cut_versions(lifecycle.apply_retention(driver.events(spark, d), cfg, TO)[1]).select("entity_id", "version")


@register("retention_reads", _SHOWN + """, m AS (SELECT entity_id, max(version) AS latest FROM ev GROUP BY ALL)
    SELECT entity_id, version, deleted, k, type, value FROM shown JOIN m USING (entity_id) WHERE version > latest - 3""")
def _(spark, d):
    """States of the three last versions, read from the five kept events and the snapshot at the cut."""
    e = _log(spark, d)
    cfg = spark.range(1).select(F.lit("app.users").alias("name"), F.lit("versions").alias("retention_type"), F.lit(5).alias("retention_value"))
    kept, dropped = lifecycle.apply_retention(e, cfg, TO)
    snaps = lifecycle.cut_snapshots(e, dropped)
    last = e.groupBy(*KEY).agg(F.max("version").alias("latest"))
    probes = last.select(*KEY, F.explode(F.sequence(F.greatest(F.col("latest") - 2, F.lit(1).cast("long")), F.col("latest"))).alias("version"))
    return _fields(asof.state_at(probes, kept, snaps))


@register("purge_entities", EV + "SELECT 'left' AS part, count(*) AS n FROM ev WHERE author <> '4' UNION ALL SELECT 'tombstones', count(DISTINCT entity_id) FROM ev WHERE author = '4'")
def _(spark, d):
    e = driver.events(spark, d)
    keys = e.where("author = '4'").select(*KEY)
    left = lifecycle.purge_entities(e, keys).agg(F.count("*").alias("n")).select(F.lit("left").alias("part"), "n")
    return left.union(lifecycle.tombstones(e, keys, TO).agg(F.count("*").alias("n")).select(F.lit("tombstones"), "n"))


# ---- tables at rest and plugin steps ---------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _two_logs(spark, d) -> str:
    """A stored log of two collections, the commands of even and of odd users."""
    path = _folder(spark, "log")
    cmds = driver.commands(spark, d).withColumn("collection", F.when(F.col("entity_id").cast("int") % 2 == 0, "app.even").otherwise("app.odd"))
    e = ingest.ingest_states(cmds).where("code is null").withColumns({"ts_stored": F.col("ts_received"), "integrity": F.lit(None).cast(INTEGRITY)})
    tables.append_events(e.select(*_columns(EVENTS)), path)
    return path


def _columns(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names


@register("retention_stored", _SHOWN + """, m AS (SELECT entity_id, max(version) AS latest FROM ev GROUP BY ALL)
    SELECT entity_id, version, deleted, k, type, value, CASE WHEN CAST(entity_id AS INT) % 2 = 0 THEN least(latest, 5) ELSE latest END AS events FROM shown JOIN m USING (entity_id) WHERE version > latest - 3""")
def _(spark, d):
    """A stored log whose even collection keeps five versions: cut twice, as a repeat would, then states of the last three
    versions read from what is stored, and how many events are left."""
    path, snaps = _two_logs(spark, d), _folder(spark, "snaps")
    cfg = spark.createDataFrame([("app.even", "versions", 5), ("app.odd", "forever", None)], "name string, retention_type string, retention_value int")
    for run in ("one", "again"):
        lifecycle.retain_stored(spark, path, snaps, cfg, TO, run)
    log = tables.read_events(spark, path)
    last = tables.stored(log.groupBy(*KEY).agg(F.max("version").alias("latest"), F.count("*").alias("events")), "last")
    probes = last.select(*KEY, F.explode(F.sequence(F.greatest(F.col("latest") - 2, F.lit(1).cast("long")), F.col("latest"))).alias("version"))
    out = asof.state_at(probes, log, spark.read.schema(SNAPSHOTS).parquet(snaps)).join(last.select(*KEY, "events"), KEY)
    g = lambda n: F.get_json_object("state", f"$.{n}").alias(n)
    return out.select("entity_id", "version", "deleted", g("k"), g("type"), g("value").cast("double").alias("value"), "events")


@register("purge_stored", EV + "SELECT 'event' AS part, entity_id, version FROM ev WHERE CAST(entity_id AS INT) % 10 <> 4 UNION ALL SELECT 'tombstone', 'app.even/' || entity_id, count(*) FROM ev WHERE CAST(entity_id AS INT) % 10 = 4 GROUP BY entity_id")
def _(spark, d):
    """Entities removed from a stored log, and the tombstones of each."""
    path, audit = _two_logs(spark, d), _folder(spark, "audit")
    keys = tables.read_events(spark, path).where(F.col("entity_id").cast("int") % 10 == 4).select(*KEY).distinct()
    lifecycle.purge_stored(spark, path, tables.stored(keys, "purged"), audit, TO, "one")
    left = tables.read_events(spark, path).select(F.lit("event").alias("part"), "entity_id", "version")
    return left.union(spark.read.parquet(audit).select(F.lit("tombstone"), "target", "events"))


@register("read_events", EV + "SELECT entity_id, version, op, ts AS ts_received FROM ev")
def _(spark, d):
    """The log, appended in two batches and read by tenant and collection."""
    path, e = _folder(spark, "events"), driver.events(spark, d)
    e = e.withColumn("integrity", F.lit(None).cast(INTEGRITY)).select(*[c.split()[0] for c in EVENTS.split(", ")])
    e = tables.stored(e, "both")  # made once for the two batches
    for part in (F.col("ts_received") < F.lit(AT), F.col("ts_received") >= F.lit(AT)):
        tables.append_events(e.where(part), path)
    return tables.read_events(spark, path, "app.users", "t").select("entity_id", "version", "op", "ts_received")


@register("read_current", EV + "SELECT entity_id, max(version) AS version, arg_max(del, version) AS deleted, max(ts) AS ts FROM ev GROUP BY entity_id")
def _(spark, d):
    """Current rows stored at an instant, then upserted with the later ones."""
    path, e = _folder(spark, "current"), driver.events(spark, d)
    ingest.build_current(e.where(F.col("ts_received") < F.lit(AT))).write.partitionBy(*tables.PARTITIONS).parquet(path)
    tables.upsert_current(spark, path, ingest.build_current(e), _folder(spark, "scratch"))
    return tables.read_current(spark, path).select("entity_id", "version", "deleted", "ts")


@register("upsert_snapshots", EV + "SELECT entity_id, version, del AS deleted FROM ev WHERE version % 10 = 0")
def _(spark, d):
    """Snapshots stored twice: the second write adds what is missing only."""
    path = _folder(spark, "snapshots")
    e = driver.events(spark, d).select(*KEY, "version", F.col("ts_received").alias("ts"), (F.col("op") == "delete").alias("deleted"), "state")
    snaps = asof.build_snapshots(e, 10)
    snaps.where("version <= 30").write.partitionBy(*tables.PARTITIONS).parquet(path)
    tables.upsert_snapshots(spark.read.schema(SNAPSHOTS).parquet(path), snaps, path)
    return spark.read.schema(SNAPSHOTS).parquet(path).select("entity_id", "version", "deleted")


@register("read_activities", "SELECT conv_id || '-' || turn AS activity_id, CAST(conv_id AS VARCHAR) AS flow_id, role AS type FROM conversations")
def _(spark, d):
    path = _folder(spark, "activities")
    tables.append_activities(driver.activities(spark, d), path)
    return tables.read_activities(spark, path).select("activity_id", "flow_id", "type")


def _lines(spark, d) -> str:
    """Commands as JSON lines in several files."""
    path = _folder(spark, "lines")
    c = driver.commands(spark, d).select("tenant", "collection", "entity_id", "kind", "seq", "event_id", F.try_parse_json("state").alias("state"))
    c.repartition(4).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


_COMMANDS = "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS entity_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'state' END AS kind, CASE WHEN event_type <> 'error' THEN event_type END AS type FROM events"


@register("read_commands", _COMMANDS)
def _(spark, d):
    return tables.read_commands(spark, _lines(spark, d)).select("seq", "entity_id", "kind", F.get_json_object("state", "$.type").alias("type"))


@register("read_change_stream", _COMMANDS)
def _(spark, d):
    """The same lines as a stream, at most two files in each micro-batch."""
    path = _folder(spark, "stream")
    rows = tables.read_change_stream(spark, _lines(spark, d), 2).select("seq", "entity_id", "kind", F.get_json_object("state", "$.type").alias("type"))
    rows.writeStream.format("parquet").option("path", path + "/out").option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path + "/out")


@register("park_dead_letters", _RETRY + "SELECT CAST(user_id AS VARCHAR) AS id, 'r' || (user_id % 4) AS rule_id, CASE WHEN lost THEN 'unknown_secret' ELSE 'attempts_exhausted' END AS last_error FROM p WHERE state = 'dead'")
def _(spark, d):
    path = _folder(spark, "dead")
    tables.park_dead_letters(_dlq(spark, d), path)
    return spark.read.parquet(path).select("id", "rule_id", "last_error")


@register("read_dimension", _MATCH + "SELECT * FROM m")
def _(spark, d):
    """Rules kept as a settings table, read and matched."""
    path = _folder(spark, "rules")
    rows = [(r["id"], r["name"], r.get("collection"), r.get("enabled", True), json.dumps(r["condition"]), json.dumps(r["actions"])) for r in RULES]
    spark.createDataFrame(rows, "id string, name string, collection string, enabled boolean, condition string, actions string").write.parquet(path)
    found = tables.rules_by_collection(spark.read.parquet(path))
    return rules.match_rules(driver.events(spark, d), [r for own in found.values() for r in own]).select("entity_id", "version", "rule_id", "action", "type")


def _plugins() -> plugins.Registry:
    """A step that adds a note, one that forges the author of deletes, one that fails on creates, one that rejects."""
    reg = plugins.Registry()
    reg.pre_store("note", lambda e: e.withColumn("meta", F.concat(F.lit("n"), F.col("entity_id"))))
    reg.pre_store("forge", lambda e: e.withColumns({"author": F.when(F.col("op") == "delete", "x").otherwise(F.col("author")), "meta": F.lit("forged")}))
    reg.pre_store("strict", lambda e: e.withColumn("plugin_error", F.when((F.col("op") == "create") & (F.col("version") > 1), "no rebirth")), "closed")
    reg.pre_store("gate", lambda e: e.withColumn("reject", F.when(F.col("source") == "view", "no views")))
    reg.action("log", lambda m: m.groupBy("rule_id").agg(F.count("*").alias("n")))
    reg.action("webhook", lambda m: m.select("rule_id", F.lit(1).cast("long").alias("n")))
    return reg


_ON = {"app.users": ["note", "forge", "strict", "gate"], "app.other": ["note"]}


@register("plugin_pre_store", EV + """SELECT entity_id, version, author, CASE WHEN del THEN 'n' || entity_id ELSE 'forged' END AS meta, CASE WHEN op = 'create' AND version > 1 THEN 'plugin_error' WHEN event_type = 'view' THEN 'no views' END AS reject_code,
    CASE WHEN del THEN 'forge:signed_column_changed' WHEN op = 'create' AND version > 1 THEN 'strict:no rebirth' ELSE '' END AS errors FROM ev""")
def _(spark, d):
    """An open step in error leaves the row as it was; a closed one rejects it; later steps do not see rejected rows."""
    out = _plugins().run_pre_store(driver.events(spark, d), _ON)
    return out.select("entity_id", "version", "author", "meta", "reject_code", F.array_join("plugin_errors", ",").alias("errors"))


@register("plugin_errors", EV + "SELECT 'forge' AS plugin, count(*) AS n FROM ev WHERE del UNION ALL SELECT 'strict', count(*) FROM ev WHERE op = 'create' AND version > 1")
def _(spark, d):
    return plugins.plugin_error_counts(_plugins().run_pre_store(driver.events(spark, d), _ON))


@register("plugin_post_store", EV + "SELECT op, count(*) AS n FROM ev GROUP BY op")
def _(spark, d):
    """A step behind the append writes its own table."""
    path, reg = _folder(spark, "post"), plugins.Registry()
    reg.post_store("count", lambda e: e.groupBy("op").agg(F.count("*").alias("n")).write.parquet(path))
    reg.run_post_store(driver.events(spark, d))
    return spark.read.parquet(path)


@register("plugin_actions", _MATCH + "SELECT rule_id, count(*) AS n FROM m WHERE type = 'log' GROUP BY rule_id UNION ALL SELECT rule_id, 1 FROM m WHERE type = 'webhook'")
def _(spark, d):
    """Fired actions go to the step of their type."""
    done = _plugins().run_actions(rules.match_rules(driver.events(spark, d), RULES))
    return done["log"].unionByName(done["webhook"])


@register("rule_exists", EV + "SELECT entity_id, version FROM ev WHERE event_type <> 'view' OR author = '3'")
def _(spark, d):
    """exists, and ne against what a field lacks: a missing source differs from any concrete value."""
    e = driver.events(spark, d).withColumn("source", F.when(F.col("source") != "view", F.col("source")))
    rule = {"id": "x", "condition": {"any": [{"field": "source", "op": "exists"}, {"all": [{"field": "source", "op": "ne", "value": "view"}, {"field": "author_id", "op": "eq", "value": 3.0}, {"not": {"field": "source", "op": "ne", "value": None}}]}]}, "actions": [{"type": "log"}]}
    return rules.match_rules(e, [rule]).select("entity_id", "version")


# ---- streams ---------------------------------------------------------------------------------------------------------


@register("ticket_status", """WITH t AS (SELECT user_id AS ticket_id, ts AS "at", CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'stored' WHEN 'error' THEN 'failed' ELSE 'bogus' END AS status FROM events),
    v AS (SELECT * FROM t WHERE status <> 'bogus') SELECT ticket_id, coalesce(arg_min(status, "at") FILTER (status IN ('stored', 'failed')), CASE WHEN bool_or(status = 'processing') THEN 'processing' ELSE 'accepted' END) AS status FROM v GROUP BY ticket_id""")
def _(spark, d):
    s = F.create_map(*[F.lit(x) for x in ("click", "accepted", "view", "processing", "purchase", "stored", "error", "failed")])[F.col("event_type")]
    log = driver.table(spark, d, "events").select(F.col("user_id").alias("ticket_id"), s.alias("status"), F.col("ts").alias("at"))
    return stream.ticket_status(log).select("ticket_id", "status")


@register("reorder", """WITH c AS (SELECT user_id, event_id, ts, ts - INTERVAL 1 HOUR * (event_id % 7) AS src FROM events),
    m AS (SELECT *, coalesce(src < max(src) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3 HOUR, FALSE) AS late FROM c)
    SELECT event_id AS seq, late, CASE WHEN NOT late THEN row_number() OVER (PARTITION BY user_id, late ORDER BY src, event_id) ELSE 0 END AS place FROM m""")
def _(spark, d):
    """Source times up to six hours behind the arrival: places in source order, and rows too late for the window."""
    cmds = driver.commands(spark, d).withColumn("ts_source", F.col("ts_source") - F.make_interval(hours=(F.col("seq") % 7).cast("int")))
    rows, late = stream.reorder(cmds, "3 hours")
    return rows.select("seq", F.lit(False).alias("late"), "place").union(late.select("seq", F.lit(True), F.lit(0)))


def _streamed(spark, d, commands, **sink) -> str:
    """Run a stream over everything there is, into a folder of its own in the shared folder."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.run_stream(commands, path, path + "/checkpoint", **sink).awaitTermination()
    return path


@register("stream_ingest", EV + "SELECT entity_id, version, op, seq FROM ev")
def _(spark, d):
    """The stateful stream gives what the batch gives."""
    path = _streamed(spark, d, driver.command_stream(spark, d))
    return spark.read.parquet(path + "/events").select("entity_id", "version", "op", "seq")


@register("stream_micro_batches", EV + "SELECT entity_id, version, op, seq FROM ev")
def _(spark, d):
    """The same under a processing-time trigger."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.run_stream(driver.command_stream(spark, d), path, path + "/checkpoint", once=False, every="100 milliseconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(path + "/events").select("entity_id", "version", "op", "seq")


@register("stream_snapshots", EV + "SELECT entity_id, version, del AS deleted FROM ev WHERE version % 10 = 0")
def _(spark, d):
    path = _streamed(spark, d, driver.command_stream(spark, d), interval=10)
    return spark.read.parquet(path + "/snapshots").select("entity_id", "version", "deleted")


@register("stream_rules", _MATCH + "SELECT sha256(concat_ws('|', 't', 'app.users', entity_id, CAST(version AS VARCHAR), rule_id, CAST(action AS VARCHAR))) AS delivery_id FROM m WHERE type = 'webhook'")
def _(spark, d):
    path = _streamed(spark, d, driver.command_stream(spark, d), rules=RULES)
    return spark.read.parquet(path + "/outbox").select("delivery_id")


@register("stream_dedup", "SELECT CAST(id AS VARCHAR) AS event_id, 1 AS n FROM (SELECT DISTINCT event_id // 2 AS id FROM events)")
def _(spark, d):
    """Ids that each occur twice leave one row."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = driver.command_stream(spark, d).withColumn("event_id", F.expr("cast(cast(event_id as long) div 2 as string)"))
    out = stream.stream_dedup(rows, "60 days").select("event_id")
    q = out.writeStream.format("parquet").option("path", path + "/out").option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path + "/out").groupBy("event_id").agg(F.count("*").alias("n"))


#: Rows of one file of a stream's input.
_FILE_ROWS = 100_000


def _by_time(spark, d, parts: int = 4, ahead: bool = False, **columns) -> DataFrame:
    """The command stream in several micro-batches: its rows in ``parts`` sets of files, one set written after the other by
    time; with ``ahead`` a last file moves the watermark 400 days on. Every set has the same number of files, which grows with
    the rows, so that a micro-batch is a set and is written and read by many tasks."""
    path, rows = _folder(spark, "by-time"), driver.table(spark, d, "events")
    files = 1 + rows.count() // (parts * _FILE_ROWS)
    at = rows.agg(F.percentile_approx(F.unix_micros("ts"), [i / parts for i in range(1, parts)])).first()[0]
    for lo, hi in zip([None, *at], [*at, None], strict=True):
        part = rows.where((F.unix_micros("ts") > F.lit(lo)) if lo is not None else F.lit(True)).where((F.unix_micros("ts") <= F.lit(hi)) if hi is not None else F.lit(True))
        part = part.repartition(files) if files > 1 else part.coalesce(1)
        held = len(spark.read.schema(rows.schema).parquet(path).inputFiles()) if lo is not None else 0
        part.write.mode("append").parquet(path)
        for _ in range(held + files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):  # a part of few rows
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    if ahead:
        last = rows.groupBy().agg((F.max("ts") + F.expr("interval 400 days")).alias("ts"))
        last.select(*[F.col("ts") if c == "ts" else F.lit(-1 if c in ("event_id", "user_id") else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(path)
    return driver.as_commands(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)).withColumns(columns)


def _appended(spark, rows: DataFrame) -> DataFrame:
    """What a stream gives over everything there is, micro-batch after micro-batch."""
    path = _folder(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    with stateful.rocksdb(spark):
        rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path + "/out")


@register("stream_keyed_ingest", EV + "SELECT entity_id, version, op, seq FROM ev")
def _(spark, d):
    """Versions from the state store, over several micro-batches, without a table of current rows."""
    return _appended(spark, stateful.keyed_ingest(_by_time(spark, d))).where("code is null").select("entity_id", "version", "op", "seq")


@register("stream_keyed_chain", ORACLES["chain_starts"])
def _(spark, d):
    """The chain that the keyed stream extends from batch to batch is the batch form's."""
    links = _appended(spark, stateful.keyed_ingest(_by_time(spark, d, 8))).where("version <= 2")
    pick = lambda v: F.max(F.when(F.col("version") == v, F.col("hash")))
    return links.groupBy("entity_id").agg(pick(1).alias("first_hash"), pick(2).alias("second_hash")).where("second_hash is not null")


@register("stream_keyed_verify", EV + "SELECT entity_id, count(*) AS links, 0 AS broken FROM ev GROUP BY ALL")
def _(spark, d):
    """Every link of the streamed chains verifies against its event."""
    e = _appended(spark, stateful.keyed_ingest(_by_time(spark, d))).where("code is null")
    flow = driver.commands(spark, d).select("seq", "flow")
    e = e.join(flow, "seq").withColumn("integrity", F.struct("hash", "prev_hash"))
    broken = chain.verify_chain(e).groupBy(*KEY).agg(F.count("*").alias("broken"))
    return e.groupBy(*KEY).agg(F.count("*").alias("links")).join(broken, KEY, "left").select("entity_id", "links", F.coalesce("broken", F.lit(0)).alias("broken"))


@register("stream_tickets", ORACLES["ticket_status"])
def _(spark, d):
    """Ticket state with a time to live, over several micro-batches."""
    kinds = F.create_map(*[F.lit(x) for x in ("click", "accepted", "view", "processing", "purchase", "stored", "error", "failed")])
    log = _by_time(spark, d).select(F.col("entity_id").cast("long").alias("ticket_id"), kinds[F.col("source")].alias("status"), F.col("ts_received").alias("at"))
    out = _appended(spark, stateful.stream_tickets(log, "60 days"))
    return out.groupBy("ticket_id").agg(F.max_by("status", "entries").alias("status"))


@register("stream_reorder", ORACLES["reorder"])
def _(spark, d):
    """Rows released in source order as newer ones come, the last of each entity by timers."""
    cmds = _by_time(spark, d, ahead=True, ts_source=F.col("ts_source") - F.make_interval(hours=(F.col("seq") % 7).cast("int")))
    out = _appended(spark, stateful.stream_reorder(cmds, "3 hours", "300 days"))
    return out.where("seq >= 0").select("seq", "late", F.coalesce("place", F.lit(0)).alias("place"))


@register("stream_stored_ids", "SELECT part, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'events' AS part, min(event_id) AS id FROM events WHERE event_id % 5 <> 0 GROUP BY event_id % 400 UNION ALL SELECT 'events', event_id FROM events WHERE event_id % 5 = 0) GROUP BY part")
def _(spark, d):
    """Ids that come again long after, and rows without an id: the index of stored ids leaves one row of each id, and all
    rows without."""
    none = F.when(F.col("seq") % 5 != 0, (F.col("seq") % 400).cast("string"))
    cmds = _by_time(spark, d, event_id=none, kind=F.lit("state"), state=F.format_string('{"n":%d}', "seq"), entity_id=F.col("seq").cast("string"))
    path = _streamed(spark, d, cmds, ids=True)
    e = spark.read.parquet(path + "/events")
    return e.groupBy(F.lit("events").alias("part")).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.concat(F.lit("i"), "event_id"), F.concat(F.lit("s"), "entity_id"))).alias("ids"))


@register("stream_settings", EV + """, c AS (SELECT *, CAST(entity_id AS INT) % 2 = 0 AS even FROM ev)
    SELECT 'event' AS part, entity_id, version, CASE WHEN op = 'create' AND even THEN 'update' ELSE op END AS what FROM c WHERE CAST(entity_id AS INT) % 5 <> 0
    UNION ALL SELECT 'snapshot', entity_id, version, '' FROM c WHERE CAST(entity_id AS INT) % 5 <> 0 AND version % CASE WHEN even THEN 4 ELSE 100 END = 0
    UNION ALL SELECT 'reject', CAST(user_id AS VARCHAR), event_id, 'collection_not_found' FROM events WHERE user_id % 5 = 0""")
def _(spark, d):
    """Settings of each collection in the stream: first operation and snapshot interval, and commands of a collection that
    is not configured."""
    number = F.col("entity_id").cast("int")
    name = F.when(number % 5 == 0, "app.none").when(number % 2 == 0, "app.even").otherwise("app.odd")
    cfg = spark.createDataFrame([("app.even", "update", None, 4, None), ("app.odd", None, None, None, None)], "name string, first_event_op string, array_keys map<string,string>, snapshot_interval int, max_event_size_bytes long")
    path = _streamed(spark, d, _by_time(spark, d, collection=name), config=cfg)
    events, snaps, rejects = (spark.read.parquet(f"{path}/{t}") for t in ("events", "snapshots", "rejects"))
    out = events.select(F.lit("event").alias("part"), "entity_id", "version", F.col("op").alias("what"))
    out = out.union(snaps.select(F.lit("snapshot"), "entity_id", "version", F.lit("")))
    return out.union(rejects.select(F.lit("reject"), "entity_id", F.col("seq"), "code"))

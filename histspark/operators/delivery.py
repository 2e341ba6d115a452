"""Webhook deliveries as data: outbox, signatures, retries, dead letters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histspark.functions.jsonx import decode_cursor, hmac_sha256, quoted

BASE_S, MAX_S, ATTEMPTS, TIMEOUT_MS = 0.5, 30.0, 5, 5000


def delivery_body() -> Column:
    """The signed body: event and rule, fields in a fixed order, absent ones left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f',"{name}":'), quoted(c))).otherwise("")
    side = lambda name, c: F.when(c.isNotNull() & (c != "null"), F.concat(F.lit(f',"{name}":'), c)).otherwise("")
    change = lambda c: F.concat(F.lit('{"path":'), quoted(c["path"]), F.lit(',"op":'), quoted(c["op"]), side("old", c["old"]), side("new", c["new"]), F.lit("}"))
    stamp = F.concat(F.regexp_replace(F.regexp_replace(F.date_format("ts_received", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"0+$", ""), r"\.$", ""), F.lit("Z"))
    return F.concat(
        F.lit('{"event":{"entity_id":'), quoted(F.col("entity_id")), F.lit(',"collection":'), quoted(F.col("collection")), F.lit(',"version":'), F.col("version").cast("string"), F.lit(',"op":'), quoted(F.col("op")),
        part("author_id", F.col("author")), part("source", F.col("source")), F.lit(',"ts_received":"'), stamp, F.lit('","changes":['), F.array_join(F.transform("changes", change), ","), F.lit("]"),
        F.when(F.coalesce(F.col("meta"), F.lit("{}")) != "{}", F.concat(F.lit(',"meta":'), F.col("meta"))).otherwise(""), F.lit('},"rule":{"id":'), quoted(F.col("rule_id")), part("name", F.col("rule_name")), F.lit("}}"),
    )


def delivery_outbox(matches: DataFrame) -> DataFrame:
    """One row per webhook firing. The id is a hash of rule, action and event, so a replay makes the same row."""
    key = F.sha2(F.concat_ws("|", "tenant", "collection", "entity_id", F.col("version").cast("string"), "rule_id", F.col("action").cast("string")), 256)
    return matches.where("type = 'webhook'").select(
        key.alias("delivery_id"), "tenant", "collection", "entity_id", "version", "rule_id", "url", "secret_ref",
        F.coalesce("timeout_ms", F.lit(TIMEOUT_MS)).alias("timeout_ms"), F.coalesce("max_attempts", F.lit(ATTEMPTS)).alias("max_attempts"), delivery_body().alias("body"),
    )


def signed(outbox: DataFrame, secrets: dict[str, str]) -> DataFrame:
    """``signature`` of each body; NULL where the secret is unknown. The secrets are a driver-side setting."""
    out = F.lit(None).cast("string")
    for ref, secret in secrets.items():
        out = F.when(F.col("secret_ref") == ref, hmac_sha256(F.col("body"), secret)).otherwise(out)
    return outbox.withColumn("signature", out)


def backoff(attempt: Column, base: float = BASE_S, most: float = MAX_S, jitter_on: Column | None = None) -> Column:
    """Seconds before retry number ``attempt``; with ``jitter_on`` a share of it that depends on that column's hash only."""
    d = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(61))), F.lit(most))
    return d if jitter_on is None else d * (F.pmod(F.xxhash64(jitter_on, attempt), F.lit(10_000)) / 10_000)


def plan_retries(outbox: DataFrame, attempts: DataFrame, known_secrets: list[str] | None = None, base: float = BASE_S, most: float = MAX_S, jitter: bool = False) -> DataFrame:
    """Where each delivery stands: delivered, dead (with reason) or pending with ``next_attempt_at`` and ``attempts``.

    ``attempts`` is a log (delivery_id, attempt, at, status, blocked): 2xx is done; blocked targets and unknown secrets
    are dead at once; else retries double until the attempts are used up.
    """
    last = attempts.groupBy("delivery_id").agg(F.max_by(F.struct("at", "status", "blocked"), "attempt").alias("l"), F.count("*").alias("attempts"), F.max(F.col("status").between(200, 299)).alias("ok"))
    rows = outbox.join(last, "delivery_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    unknown = F.lit(False) if known_secrets is None else F.col("secret_ref").isNotNull() & ~F.col("secret_ref").isin(known_secrets)
    state = (
        F.when(F.coalesce("ok", F.lit(False)), "delivered").when(unknown, "dead").when(F.coalesce("l.blocked", F.lit(False)), "dead").when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("pending")
    )
    reason = F.when(state == "dead", F.when(unknown, "unknown_secret").when(F.coalesce("l.blocked", F.lit(False)), "blocked").otherwise("attempts_exhausted"))
    wait = backoff(F.col("attempts") - 1, base, most, F.col("delivery_id") if jitter else None)
    at = F.when((state == "pending") & (F.col("attempts") > 0), F.timestamp_micros((F.unix_micros("l.at") + wait * 1e6).cast("long")))
    return rows.withColumns({"state": state, "reason": reason, "next_attempt_at": at}).drop("l", "ok")


def dead_letters(planned: DataFrame) -> DataFrame:
    """Dead deliveries in the dead-letter shape."""
    return planned.where("state = 'dead'").select(F.col("delivery_id").alias("id"), "tenant", "rule_id", "collection", "delivery_id", "url", "secret_ref", F.col("body").cast("binary").alias("body"), "attempts", F.col("reason").alias("last_error"))


def redeliver(dlq: DataFrame, ids: DataFrame | None = None, rule_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outbox rows from attempt 0, remaining dead letters, ids not found). An id of another rule is not found."""
    own = dlq if rule_id is None else dlq.where(F.col("rule_id") == rule_id)
    back = own if ids is None else own.join(ids.select("id").distinct(), "id", "left_semi")
    missing = dlq.select("id").limit(0) if ids is None else ids.select("id").distinct().join(own, "id", "left_anti")
    outbox = back.select("delivery_id", "tenant", "collection", "rule_id", "url", "secret_ref", F.lit(TIMEOUT_MS).alias("timeout_ms"), F.lit(ATTEMPTS).alias("max_attempts"), F.col("body").cast("string").alias("body"))
    return outbox, dlq.join(back.select("id"), "id", "left_anti"), missing


def dlq_list(dlq: DataFrame, rule_id: str | None = None, limit: int = 100, after: str | None = None) -> DataFrame:
    """Dead letters, newest first, strictly after a cursor (ts, id)."""
    rows = dlq if rule_id is None else dlq.where(F.col("rule_id") == rule_id)
    if after:
        at = decode_cursor(after)
        ts = F.lit(datetime.fromisoformat(at["ts"]))
        rows = rows.where((F.col("failed_at") < ts) | ((F.col("failed_at") == ts) & (F.col("id") < at["id"])))
    return rows.orderBy(F.col("failed_at").desc(), F.col("id").desc()).limit(limit)

"""The driver tables seen as history relations.

``events`` is a command stream: entity user_id, order (ts, event_id), state ``{k, type, value}``; an ``error`` row is a
delete. ``orders``, ``customer``, ``supplier`` and ``part`` are collections; ``conversations`` are activities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histspark.operators.ingest import ingest_states
from histspark.schemas import CHANGES, FLOW, FLOW_REF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without zone are read in the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and delete commands of the ``events`` table."""
    return as_commands(table(spark, sf_dir, "events"))


def command_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same commands as a file stream. A stream reads folders: a table of part files is read whole, a single file by
    its name in its folder."""
    path = f"{sf_dir}/events.parquet"
    rows = spark.read.parquet(path)
    reader = spark.readStream.schema(rows.schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).isDirectory()
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return as_commands(stream.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"}))


def as_commands(e: DataFrame) -> DataFrame:
    """Rows of ``events`` as commands."""
    state = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("type"), "value"))
    return e.select(
        F.lit("t").alias("tenant"), F.lit("app.users").alias("collection"), F.col("user_id").cast("string").alias("entity_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("state").alias("kind"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("long").alias("expected_version"),
        (F.col("user_id") % 10).cast("string").alias("author"), F.col("event_type").alias("source"), F.col("ts").alias("ts_source"), F.col("ts").alias("ts_received"), F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("event_id"), F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("client_ip"), F.lit(None).cast("string").alias("meta"),
        F.when(F.col("event_type") != "error", state).alias("state"), F.lit(None).cast(CHANGES).alias("changes"),
        F.struct(F.concat_ws("-", F.lit("f"), F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("id"), F.array().cast(f"array<{FLOW_REF}>").alias("caused_by"), F.lit(None).cast("string").alias("step")).cast(FLOW).alias("flow"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned events of the command stream, with their structural changes and states."""
    return ingest_states(commands(spark, sf_dir)).where("code is null").drop("code").withColumn("ts_stored", F.col("ts_received"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations: flow conv_id, caused by the turn before."""
    c = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    ref = F.struct(name(F.col("turn") - 1).alias("activity_id"), *[F.lit(None).cast(t).alias(n) for n, t in (("collection", "string"), ("entity_id", "string"), ("version", "long"), ("event_id", "string"))])
    return c.select(
        F.lit("t").alias("tenant"), name(F.col("turn")).alias("activity_id"), F.col("role").alias("type"), F.col("conv_id").cast("string").alias("flow_id"),
        F.when(F.col("turn") > F.min("turn").over(_by_conv()), F.array(ref)).otherwise(F.array().cast(f"array<{FLOW_REF}>")).alias("caused_by"),
        F.array().cast(f"array<{FLOW_REF}>").alias("refs"), F.col("role").alias("author"), F.lit("chat").alias("source"), F.lit(None).cast("timestamp").alias("ts_source"),
        (F.lit("1970-01-01").cast("timestamp") + F.make_interval(secs=F.col("turn").cast("decimal(18,6)"))).alias("ts_received"), F.lit(None).cast("timestamp").alias("ts_stored"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("string").alias("meta"),
    )


def _by_conv():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id")

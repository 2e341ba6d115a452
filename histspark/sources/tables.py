"""Tables at rest: Parquet, partitioned by tenant and collection; commands as JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histspark.schemas import ACTIVITIES, COMMANDS, CURRENT, EVENTS, KEY
from histspark.session import shared_dir

PARTITIONS = ["tenant", "collection"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """A step's table in the shared folder, read back: cuts lineage, so that lost executors cost a step only."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def read_events(spark: SparkSession, path: str, collection: str | None = None, tenant: str | None = None) -> DataFrame:
    """The event log; collection and tenant prune partitions."""
    out = spark.read.schema(EVENTS).parquet(path)
    if tenant is not None:
        out = out.where(F.col("tenant") == tenant)
    return out if collection is None else out.where(F.col("collection") == collection)


def read_current(spark: SparkSession, path: str, entity_id: str | None = None) -> DataFrame:
    """Latest rows, deleted ones with their kept value included."""
    out = spark.read.schema(CURRENT).parquet(path)
    return out if entity_id is None else out.where(F.col("entity_id") == entity_id)


def parse_commands(lines: DataFrame, column: str = "value") -> DataFrame:
    """Write commands from JSON text; ``state`` becomes canonical text and is NULL where it is malformed."""
    raw = COMMANDS.replace("state string", "state variant").replace("meta string", "meta variant")
    c = lines.select(F.from_json(column, raw).alias("c")).select("c.*")
    return c.withColumns({"state": F.to_json("state"), "meta": F.to_json("meta")})


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """Commands from JSON-lines files."""
    return parse_commands(spark.read.text(path))


def read_change_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Commands as a stream of JSON-lines files; the source's rate cap shapes the load, its checkpoint gives replay."""
    return parse_commands(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def append_events(events: DataFrame, path: str) -> None:
    """Append a versioned batch, clustered so that file statistics prune entities."""
    events.sortWithinPartitions(*KEY, "version").write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def append_once(events: DataFrame, path: str, batch_id: int) -> None:
    """The stream form of ``append_events``: a batch owns a folder, so a replay overwrites itself."""
    events.sortWithinPartitions(*KEY, "version").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def merged_current(stored: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per entity: the higher version of two current tables."""
    rest = [c for c in stored.columns if c not in KEY]
    both = stored.unionByName(latest.select(*stored.columns))
    return both.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*KEY, "r.*").select(*stored.columns)


def upsert_current(spark: SparkSession, path: str, latest: DataFrame, scratch: str) -> None:
    """Keep the latest row per entity; only partitions that ``latest`` touches are rewritten. The merge is written to
    ``scratch`` (shared storage) first, since a table cannot be overwritten while it is read."""
    touched = latest.select(*PARTITIONS).distinct()
    stored = spark.read.schema(CURRENT).parquet(path).join(touched, PARTITIONS, "left_semi")
    merged_current(stored, latest).write.mode("overwrite").parquet(scratch)
    spark.read.schema(CURRENT).parquet(scratch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def new_snapshots(stored: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots whose (entity, version) is not stored yet; repeats inside the batch leave one."""
    key = [*KEY, "version"]
    return snapshots.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def upsert_snapshots(stored: DataFrame, snapshots: DataFrame, path: str) -> None:
    new_snapshots(stored, snapshots).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def with_activity_ids(activities: DataFrame) -> DataFrame:
    """Missing activity ids from a hash of the row, the same on every retry."""
    made = F.sha2(F.to_json(F.struct("tenant", "type", "flow_id", "author", "source", "ts_source", "data")), 256)
    return activities.withColumn("activity_id", F.when(F.coalesce("activity_id", F.lit("")) == "", made).otherwise(F.col("activity_id")))


def append_activities(activities: DataFrame, path: str) -> None:
    with_activity_ids(activities).write.mode("append").partitionBy("tenant").parquet(path)


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACTIVITIES).parquet(path)


def park_dead_letters(dead: DataFrame, path: str) -> None:
    dead.write.mode("append").partitionBy("tenant").parquet(path)


def rules_by_collection(rules: DataFrame) -> dict[str, list[dict]]:
    """Rules (id, name, collection, enabled, condition and actions as JSON) grouped by collection; a settings table, read
    on the driver."""
    from histspark.functions.jsonvalue import loads

    out: dict[str, list[dict]] = {}
    for r in rules.orderBy("collection", "id").collect():
        out.setdefault(r["collection"], []).append({**r.asDict(), "condition": loads(r["condition"]), "actions": loads(r["actions"])})
    return out



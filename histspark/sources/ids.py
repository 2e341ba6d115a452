"""Index of stored event ids: ids bucketed by hash, with one Bloom filter for each bucket.

A batch asks the filters first; only buckets in which some id may be stored are read, and the answer is exact. The filters
have a fixed size whatever is stored (``BUCKETS * BLOCKS`` bitmaps of 4 KB); when they fill up, more buckets are read.
A batch owns its folders, so a replayed batch replaces itself and never meets its own ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID = ["tenant", "collection", "event_id"]
#: Buckets of ids, bitmaps of a bucket's filter, bits of a bitmap, and bits that an id sets.
BUCKETS, BLOCKS, BITS, PROBES = 64, 64, 1 << 15, 4
_IDS = "tenant string, collection string, event_id string, batch long, bucket int"
_FILTERS = "bucket int, block int, bits binary"


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*ID), F.lit(BUCKETS)).cast("int")


def _probes(ids: DataFrame) -> DataFrame:
    """One row for each bit of each id."""
    at = F.array(*[F.pmod(F.xxhash64(F.lit(i), *reversed(ID)), F.lit(BLOCKS * BITS)) for i in range(PROBES)])
    rows = ids.select(*ID, _bucket().alias("bucket"), F.explode(at).alias("_at"))
    return rows.select(*ID, "bucket", F.floor(F.col("_at") / BITS).cast("int").alias("block"), (F.col("_at") % BITS).cast("int").alias("bit"))


def filters(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The filters of all ids stored before a batch."""
    return spark.read.schema(_FILTERS).parquet(f"{path}/filters/batch={batch_id - 1}") if batch_id > 0 else None


def add_ids(ids: DataFrame, path: str, batch_id: int) -> None:
    """Store the ids of a batch and the filters up to it."""
    fresh = ids.where("event_id is not null").select(*ID).distinct()
    fresh.withColumn("bucket", _bucket()).sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ids/batch={batch_id}")
    mine = _probes(fresh).groupBy("bucket", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = filters(ids.sparkSession, path, batch_id)
    both = mine if held is None else mine.unionByName(held).groupBy("bucket", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    both.write.mode("overwrite").parquet(f"{path}/filters/batch={batch_id}")


def maybe_stored(ids: DataFrame, held: DataFrame) -> DataFrame:
    """The ids all of whose bits are set: all that are stored, and few others; with their bucket."""
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("bit") % 8 + 1).cast("int"))) != 0
    hits = _probes(ids).join(held, ["bucket", "block"]).where(is_set)
    return hits.groupBy(*ID, "bucket").agg(F.count("*").alias("_n")).where(F.col("_n") == PROBES).drop("_n")


def known_ids(ids: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Those of the ids (distinct, not null) that batches before ``batch_id`` stored."""
    spark = ids.sparkSession
    held = filters(spark, path, batch_id)
    if held is None:
        return ids.select(*ID).limit(0)
    maybe = maybe_stored(ids, held)
    buckets = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # BUCKETS at most
    stored = spark.read.schema(_IDS).option("basePath", f"{path}/ids").parquet(f"{path}/ids").where(F.col("bucket").isin(buckets) & (F.col("batch") < batch_id))
    return maybe.select(*ID).join(stored.select(*ID), ID, "left_semi")

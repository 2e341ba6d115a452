"""Grace hash deduplication of whole texts.

Records are partitioned by content hash, recursively, until the distinct content of each bucket fits an
open-addressing table; inside a bucket the table compares complete content, so a hash collision never merges texts.

How the Grace steps map to Spark:

* *Local collapse* (narrow): each task keeps its distinct texts in a bounded open-addressing table and sends one
  representative per distinct text, so a text that fills a third of the corpus travels once per task, not once per row.
* *Recursive partitioning*: bucket sizes are summed from (hash, bytes) alone; a bucket above ``bucket_bytes`` is split
  again by another hash seed, level by level. Only when the plan is final do texts move, once, to Spark's spill
  (shuffle) files. A bucket with one hash cannot be split and needs one slot.
* *Probe*: each bucket runs through an open-addressing table.

Defined results: null text is the empty text; null doc_id sorts below every id; of equal texts the row with the largest
doc_id stays, of rows repeated with that id exactly one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of, tune

#: Bytes of distinct content that one bucket's table may hold.
BUCKET_BYTES = 32 << 20
#: Levels of partitioning; each splits an oversized bucket by its size over BUCKET_BYTES.
MAX_LEVELS = 8
#: Oversized buckets that are broadcast at most (about 1 MB); more are joined.
BROADCAST_BUCKETS = 20_000

_LOCAL = "kind int, uid long, doc_id long, sha binary, lk long, h long, text binary, bytes long, n long, max_id long, win_uid long"
_LOCAL_ARROW = pa.schema(
    [("kind", pa.int32()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("lk", pa.int64()), ("h", pa.int64()), ("text", pa.binary()), ("bytes", pa.int64()), ("n", pa.int64()), ("max_id", pa.int64()), ("win_uid", pa.int64())]
)
_CLASS = "lk long, keep_id long, group_size long, win_uid long"
_CLASS_ARROW = pa.schema([("lk", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("win_uid", pa.int64())])


class ContentTable:
    """Open addressing with linear probing; equal means equal hash and equal content."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def entry(self, h: int, content: bytes) -> tuple[int, bool]:
        """Entry number of the content and whether it is new."""
        mask = len(self.slots) - 1
        i = h & mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            i = (i + 1) & mask
        e = self.slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = e


def _better(a: tuple, b: tuple) -> bool:
    """Whether (doc_id, uid) a wins over b: larger id, null lowest, then the smaller uid."""
    if a[0] != b[0]:
        return b[0] is None or (a[0] is not None and a[0] > b[0])
    return a[1] < b[1]


def _local_collapse(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        row, first_lk = 0, 0
        table, counts, wins = ContentTable(), [], []

        def reps() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(counts), 256):
                part = slice(at, at + 256)
                size = len(counts[part])
                none = [None] * size
                contents = table.contents[part]
                yield pa.record_batch(
                    [pa.array([1] * size, pa.int32()), none_array(size), none_array(size), pa.array(none, pa.binary()), pa.array([base + first_lk + at + i for i in range(size)], pa.int64()), pa.array(table.hashes[part], pa.int64()), pa.array(contents, pa.binary()), pa.array([len(c) for c in contents], pa.int64()), pa.array(counts[part], pa.int64()), pa.array([w[0] for w in wins[part]], pa.int64()), pa.array([w[1] for w in wins[part]], pa.int64())],
                    schema=_LOCAL_ARROW,
                )

        for batch in batches:
            ids, texts, hashes = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("h").to_pylist()
            uids, lks = [], []
            flushed: list[pa.RecordBatch] = []
            for doc_id, text, h in zip(ids, texts, hashes, strict=True):
                if table.bytes + len(text) > limit and table.hashes:
                    flushed += reps()
                    first_lk += len(counts)
                    table, counts, wins = ContentTable(), [], []
                uid = base + row
                row += 1
                e, new = table.entry(h, text)
                if new:
                    counts.append(0)
                    wins.append((doc_id, uid))
                elif _better((doc_id, uid), wins[e]):
                    wins[e] = (doc_id, uid)
                counts[e] += 1
                uids.append(uid)
                lks.append(base + first_lk + e)
            size = len(uids)
            yield pa.record_batch(
                [pa.array([0] * size, pa.int32()), pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), batch.column("sha").cast(pa.binary()), pa.array(lks, pa.int64()), none_array(size), pa.array([None] * size, pa.binary()), none_array(size), none_array(size), none_array(size), none_array(size)],
                schema=_LOCAL_ARROW,
            )
            yield from flushed
        yield from reps()

    return run


def none_array(n: int) -> pa.Array:
    return pa.nulls(n, pa.int64())


def _probe_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per representative: its class. Rows arrive sorted by bucket; only one bucket's table is held."""
    bucket, table, counts, wins, lks, entries = None, ContentTable(), [], [], [], []

    def out() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(lks), 8192):
            es = entries[at : at + 8192]
            yield pa.record_batch([pa.array(lks[at : at + 8192], pa.int64()), pa.array([wins[e][0] for e in es], pa.int64()), pa.array([counts[e] for e in es], pa.int64()), pa.array([wins[e][1] for e in es], pa.int64())], schema=_CLASS_ARROW)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "lk", "h", "text", "n", "max_id", "win_uid")]
        for b, lk, h, text, n, max_id, win_uid in zip(*columns, strict=True):
            if b != bucket:
                yield from out()
                bucket, table, counts, wins, lks, entries = b, ContentTable(), [], [], [], []
            e, new = table.entry(h, text)
            if new:
                counts.append(0)
                wins.append((max_id, win_uid))
            elif _better((max_id, win_uid), wins[e]):
                wins[e] = (max_id, win_uid)
            counts[e] += n
            lks.append(lk)
            entries.append(e)
    yield from out()


def plan_buckets(reps: DataFrame, bucket_bytes: int, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Add ``bucket`` to representatives so that each bucket's distinct content fits ``bucket_bytes``.

    Sizes are planned on (h, bytes) alone. The loop ends when no bucket of several hashes is too large.
    """
    sizes = reps.groupBy("h").agg(F.max("bytes").alias("bytes"))
    total = int(sizes.agg(F.sum("bytes")).first()[0] or 0)
    fan = max(1, -(-2 * total // bucket_bytes))
    out = reps.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(0)), F.lit(fan)).cast("string"))
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(0)), F.lit(fan)).cast("string"))
    for level in range(1, max_levels):
        over = (
            sizes.groupBy("bucket")
            .agg(F.sum("bytes").alias("b"), F.count("*").alias("c"))
            .where((F.col("b") > bucket_bytes) & (F.col("c") > 1))
            .select("bucket", F.ceil(F.col("b") / F.lit(bucket_bytes)).alias("split"))
        )
        large = over.limit(BROADCAST_BUCKETS + 1).count()
        if not large:
            break
        if large <= BROADCAST_BUCKETS:
            over = F.broadcast(over)
        deeper = F.concat_ws(".", F.col("bucket"), F.when(F.col("split").isNotNull(), F.pmod(F.xxhash64("h", F.lit(level)), F.col("split") + 1).cast("string")))
        out = out.join(over, "bucket", "left").withColumn("bucket", deeper).drop("split")
        sizes = sizes.join(over, "bucket", "left").withColumn("bucket", deeper).drop("split")
    return out


def grace_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Classes of equal texts. Returns uid, doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    spark = tune(docs.sparkSession)
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.xxhash64(text).alias("h"))
    local = stored(rows.mapInArrow(_local_collapse(bucket_bytes), _LOCAL), "dedup-local", ("kind",))
    reps = local.where("kind = 1").select("lk", "h", "text", "bytes", "n", "max_id", "win_uid")
    planned = plan_buckets(reps, bucket_bytes)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    classes = planned.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_probe_buckets, _CLASS)
    return (
        local.where("kind = 0")
        .select("uid", "doc_id", "sha", "lk")
        .join(classes, "lk")
        .select("uid", "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("win_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def deduplicated(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per distinct text."""
    marked = stored(grace_dedup(docs, bucket_bytes).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept"), "dedup-marks")
    stay = marked.where("kept").select("doc_id", "sha")
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("_sha"))
    kept = left.join(stay.hint("shuffle_hash"), left["_id"].eqNullSafe(stay["doc_id"]) & (left["_sha"] == stay["sha"]), "left_semi")
    # rows repeated whole (same id, same text) pass together and leave one; only then are texts grouped again
    if not marked.groupBy("doc_id", "sha").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_sha"])
    return kept.select("row.*")


def query(spark, sf_dir):
    """op2: classes of equal texts over all of ``documents``."""
    return grace_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("uid")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d
"""

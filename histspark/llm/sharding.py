"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted hash draws.

Every shard draws ``ln(u) / weight`` with u a uniform hash of (doc_id, its place in the tree). A rack's draw is the greatest
of its shards', a region's the greatest of its racks'; at each level the greatest draw wins. The greatest of such draws is
again one of the summed weight, so a subtree wins rows in proportion to its weight, and what changes in one subtree changes no
other's draw: rows move only into or out of the shard whose weight changed. A shard's place follows from its number alone, so
the tree of n + 1 shards is the tree of n with one shard more, for every n, and that shard takes rows only into itself.

Native: hashing, descent and slots are DataFrame expressions. Slots are dealt in two levels (bucket counts, then
positions inside a bucket), so that no task sees a whole shard.

Defined results: null text has no bytes (crc of the empty text); a null doc_id hashes as a key of its own; rows
repeated whole get slots of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: Bytes that each row counts beside its text.
ROW_BYTES = 16
#: Rows of one slot bucket: one task numbers about so many rows at once.
BUCKET_ROWS = 100_000
#: Buckets of a shard at least.
LEAST_BUCKETS = 8


@dataclass(frozen=True)
class Node:
    """A subtree: its name takes part in the hash; ``shard`` is set on leaves."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def planned_tree(shards: int, per_rack: int = 4, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """A tree of ``shards`` leaves in racks of ``per_rack`` and regions of ``racks`` racks."""
    leaf = lambda s, at: Node(f"{at}/s{s}", (weights or {}).get(s, 1.0), shard=s)
    regions = []
    for r, first in enumerate(range(0, shards, per_rack * racks)):
        members = range(first, min(first + per_rack * racks, shards))
        cut = [members[i : i + per_rack] for i in range(0, len(members), per_rack)]
        regions.append(_inner(f"r{r}", [_inner(f"r{r}/k{k}", [leaf(s, f"r{r}/k{k}") for s in c]) for k, c in enumerate(cut)]))
    return _inner("root", regions)


def _inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def grown_tree(tree: Node, shard: int, weight: float = 1.0, per_rack: int = 4, racks: int = 2) -> Node:
    """The tree with one more shard, at the place that its number names."""
    at = [f"r{shard // (per_rack * racks)}", f"k{shard // per_rack % racks}", f"s{shard}"]

    def put(node: Node, depth: int) -> Node:
        name = "/".join(at[: depth + 1])
        inside = [c for c in node.children if c.name == name]
        if depth == 2:
            child = Node(name, weight, shard=shard)
        else:
            child = put(inside[0] if inside else _inner(name, []), depth + 1)
        rest = [child if c.name == name else c for c in node.children]
        return _inner(node.name, rest if inside else [*rest, child])

    return put(tree, 0)


def _best(tree: Node, key: Column) -> Column:
    """The greatest draw under a node and its shard (as a negative number: of equal draws the smaller number wins)."""
    if tree.shard is None:
        return F.array_max(F.array(*[_best(c, key) for c in tree.children]))
    u = (F.xxhash64(key, F.lit(tree.name)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return F.struct((F.ln(u) / float(tree.weight)).alias("draw"), F.lit(-tree.shard).alias("shard"))


def descend(tree: Node, key: Column) -> Column:
    """Shard number of a key: the best of the regions' best of their racks' best shard."""
    return -_best(tree, key)["shard"]


def shard_rows(docs: DataFrame, tree: Node, grown: Node | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard of every row; narrow."""
    text = text_of().cast("binary")
    key = F.col("doc_id")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        descend(tree, key).cast("int").alias("shard"),
        (descend(grown, key).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )


def with_slots(rows: DataFrame, shards: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard.

    Rows are dealt to buckets once and stored, so that counts and positions see the same deal; a bucket's first slot
    is the sum of the counts before it.
    """
    dealt = stored(rows.withColumn("_deal", F.monotonically_increasing_id()), "shard-rows")
    buckets = max(LEAST_BUCKETS, -(-dealt.count() // (shards * bucket_rows)))
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64("_deal"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "_deal")
    placed = dealt.withColumn("_at", F.row_number().over(inside).cast("long"))
    return placed.join(first, ["shard", "_bucket"]).withColumn("slot", F.col("_first") + F.col("_at") - 1).drop("_deal", "_bucket", "_at", "_first")


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shards by the ``key`` law, with the shard of each row after one more shard joins."""
    tree = planned_tree(shards)
    placed = with_slots(shard_rows(docs, tree, grown_tree(tree, shards)), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark, sf_dir):
    """op3: all ``documents`` in shards 0 to 39."""
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)

"""Hard-negative mining with rotated one-bit codes and deterministic intervals.

A vector of integers is rotated by a fixed orthogonal matrix and kept as its signs (one bit a component), its length and
the alignment of vector and code. The part outside the code is coded again under another rotation, ``STAGES`` times in
all; what is left has a known length. For an anchor q, rotated and rounded to a few bits a component, popcounts of code and
anchor planes give the inner product with the code; by Cauchy-Schwarz the left part adds at most its length times the
length of q, and the rounding of q at most its own length times the length along the code. So every pair has an interval
that surely holds its score, from the first stage on; later stages are worked out for the pairs that the stage before
leaves open. Only pairs whose interval still reaches the asked range are scored, in integers.

Anchors meet all rows in a grid of cells (anchor block, row block), both cut by hash; a cell gets its anchors first and
then streams its rows, so its memory is one block of anchors whatever a label's share of the rows is. The best of each
cell are merged per anchor. Two rounds: positives, then negatives between the score bounds that the positives set.

Defined results: rows with a null label or vector, or any null or non-finite component, take no part, nor do rows with a
component of 2**19 or more, whose scores might not fit a long; a null vec_id is neither anchor nor partner; of rows with
the same vec_id the one with the least (label, vector) takes part, once; shorter vectors count as filled up with zeros; an
anchor without positives gives no row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, stored, tune

#: Rotations and codes of a vector, bits of a rounded anchor component, seed of the rotations.
STAGES, BITS, SEED = 6, 6, 13
#: Anchors and rows of a cell (about), and rows of one batch of a cell.
ANCHORS, ROWS, BATCH = 2048, 200_000, 4096
#: Positives of an anchor and negatives of a pair; lower bound of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
#: Components from here on take no part.
LIMIT = 1 << 27


@lru_cache(maxsize=64)
def rotation(dim: int, stage: int, seed: int = SEED) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng((seed, stage, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Codes of vectors: per stage the sign bits and the length along the code, and the length of what is left."""

    def __init__(self, vectors: np.ndarray, stages: int = STAGES):
        rest = vectors.astype(np.float64)
        dim = rest.shape[1]
        self.norm = np.linalg.norm(rest, axis=1)
        self.bits, self.along, self.left = [], [], []
        for k in range(stages):
            turn = rotation(dim, k)
            turned = rest @ turn.T
            signs = np.where(turned >= 0, 1.0, -1.0) / np.sqrt(dim)
            along = np.einsum("ij,ij->i", turned, signs)
            self.bits.append(_packed_bits(turned >= 0))
            self.along.append(along)
            rest = (turned - along[:, None] * signs) @ turn
            # the rounding of these sums is far below one part in 2**40
            self.left.append(np.linalg.norm(rest, axis=1) + self.norm * 2.0**-40)


def _packed_bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    width = -(-signs.shape[1] // 64) * 64
    wide = np.zeros((len(signs), width), bool)
    wide[:, : signs.shape[1]] = signs
    return np.packbits(wide, axis=1).view(np.uint64)


class Anchor:
    """An anchor rotated and rounded for every stage: bit planes, and how far the rounding is off."""

    def __init__(self, vector: np.ndarray, stages: int = STAGES, bits: int = BITS):
        q = vector.astype(np.float64)
        self.vector, self.dim, self.norm = vector, len(q), float(np.linalg.norm(q))
        self.planes = []
        for k in range(stages):
            turned = rotation(self.dim, k) @ q
            low = float(turned.min()) if self.dim else 0.0
            step = (float(turned.max()) - low) / (2**bits - 1) if self.dim else 0.0
            level = np.rint((turned - low) / step).astype(np.int64) if step else np.zeros(self.dim, np.int64)
            words = [_packed_bits(((level >> b) & 1).astype(bool)[None, :])[0] for b in range(bits)]
            off = float(np.linalg.norm(turned - (low + step * level)))
            self.planes.append((low, step, words, int(level.sum()), off))

    def dots(self, bits: np.ndarray, stage: int) -> tuple[np.ndarray, float]:
        """Inner products of the anchor with unit codes by popcounts, and how far they may be off."""
        low, step, words, total, off = self.planes[stage]
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        raised = np.zeros(len(bits), np.int64)
        for b, plane in enumerate(words):
            raised += np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64) << b
        # a set bit is +1, a clear one -1
        return (low * (2 * ones - self.dim) + step * (2 * raised - total)) / np.sqrt(self.dim), off + self.norm * 2.0**-40


def within(anchor: Anchor, codes: Codes, rows: np.ndarray, least, most) -> np.ndarray:
    """Those of ``rows`` (indexes) whose interval reaches a score in [least, most]; the intervals narrow stage by stage."""
    middle, slack = np.zeros(len(rows)), np.zeros(len(rows))
    for k in range(len(codes.bits)):
        if not len(rows):
            break
        dots, off = anchor.dots(codes.bits[k][rows], k)
        along = codes.along[k][rows]
        middle = middle + along * dots
        slack = slack + np.abs(along) * off
        reach = slack + codes.left[k][rows] * anchor.norm
        open_ = (middle + reach >= least) & (middle - reach <= most)
        rows, middle, slack = rows[open_], middle[open_], slack[open_]
    return rows


def intervals(anchor: Anchor, codes: Codes, stages: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all coded vectors after so many stages."""
    middle = slack = np.zeros(len(codes.norm))
    for k in range(stages or len(codes.bits)):
        dots, off = anchor.dots(codes.bits[k], k)
        middle = middle + codes.along[k] * dots
        slack = slack + np.abs(codes.along[k]) * off
    reach = slack + codes.left[k] * anchor.norm
    return middle - reach, middle + reach


class Best:
    """The first k by (score descending, id ascending)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -scores))[: self.k]
        self.rows = sorted(self.rows + [(-int(s), int(i)) for s, i in zip(scores[order], ids[order], strict=True)])[: self.k]

    def bound(self) -> float:
        """Scores below this cannot enter any more."""
        return -self.rows[-1][0] if len(self.rows) == self.k else -np.inf


def vectors_of(table: DataFrame, vec: str = "embedding", label: str = "label", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part, one for each id, components as ``floor(scale * x)``."""
    x = lambda c: F.floor(c.cast("double") * F.lit(float(scale)))
    fits = F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double") * float(scale)) < float(LIMIT), F.lit(False)) & ~F.isnan(c))
    rows = table.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull())
    named = rows.where(fits).select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), F.transform(vec, x).cast("array<bigint>").alias("v")).alias("r"))
    return named.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v")


_CELL = "cell long, side int, id long, label long, v array<bigint>, ask array<struct<id:bigint,score:bigint>>"
_BEST = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of one matrix, filled up with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int64)
    at = np.repeat(np.arange(len(offsets)), offsets)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(offsets) - offsets, offsets)] = flat
    return out


class Ask:
    """A range of scores an anchor asks for (for one of its positives, if any), and the best of it so far."""

    def __init__(self, low: float, top: float, k: int, positive: int | None = None):
        self.low, self.top, self.best, self.positive = low, top, Best(k), positive

    def open(self) -> float:
        """The least score that still counts."""
        return max(self.low, self.best.bound())


class _Cell:
    """The anchors of a cell with the best found so far."""

    def __init__(self, dim: int, mode: str):
        self.dim, self.mode, self.anchors = dim, mode, []

    def meet(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        codes, at = Codes(v), np.arange(len(ids))
        for anchor, own, label, asks in self.anchors:
            mates = at[(labels == label) & (ids != own)] if self.mode == "positives" else at[labels != label]
            rows = within(anchor, codes, mates, min((x.open() for x in asks), default=np.inf), max((x.top for x in asks), default=-np.inf))
            scores = v[rows] @ anchor.vector
            for ask in asks:
                fit = (scores >= ask.open()) & (scores <= ask.top)
                ask.best.add(scores[fit], ids[rows][fit])

    def found(self) -> Iterator[tuple]:
        for _, own, _, asks in self.anchors:
            for ask in asks:
                for score, i in ask.best.rows:
                    yield own, ask.positive, None if ask.positive is None else ask.top, i, -score


def _meet(dim: int, mode: str):
    """Rows arrive cell by cell, anchors (side 0) before rows (side 1)."""
    types = [pa.int64()] * 5
    names = [c.split()[0] for c in _BEST.split(", ")]

    def out(cell: _Cell) -> Iterator[pa.RecordBatch]:
        rows = list(cell.found())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        for batch in batches:
            numbers, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            turn = np.flatnonzero(np.append(True, (numbers[1:] != numbers[:-1]) | (sides[1:] != sides[:-1]))) if len(numbers) else []
            for a, e in zip(turn, [*turn[1:], len(numbers)], strict=True):
                if numbers[a] != now:
                    if cell is not None:
                        yield from out(cell)
                    now, cell = numbers[a], _Cell(dim, mode)
                part = batch.slice(int(a), int(e - a))
                ids, labels, v = part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"), dim)
                if sides[a] == 1:
                    if cell.anchors:
                        cell.meet(ids, labels, v)
                    continue
                for own, label, vector, ask in zip(ids.tolist(), labels.tolist(), v, part.column("ask").to_pylist(), strict=True):
                    asks = [Ask(-np.inf, np.inf, POSITIVES)] if mode == "positives" else [Ask(-(-LEAST * p["score"] // 100), p["score"], NEGATIVES, p["id"]) for p in ask]
                    cell.anchors.append((Anchor(vector), own, label, asks))
        if cell is not None:
            yield from out(cell)

    return run


def _round(rows: DataFrame, anchors: DataFrame, dim: int, sizes: tuple[int, int], mode: str) -> DataFrame:
    """The best of every cell: anchors are copied to each row block, rows to each anchor block, one shuffle for both."""
    spark = rows.sparkSession
    across, down = max(1, -(-sizes[0] // ANCHORS)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes[1] // ROWS))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")
    number = lambda a, r: (a * F.lit(down) + r).alias("cell")
    side = lambda df, n, cell, ask: df.select(cell, F.lit(n).alias("side"), "id", "label", "v", ask.alias("ask"))
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    left = side(anchors.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))), 0, number(block(across), F.col("_r")), F.col("ask") if mode == "negatives" else none)
    right = side(rows.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))), 1, number(F.col("_a"), block(down)), none)
    cells = left.unionByName(right).repartition(across * down if across * down < 100_000 else 100_000, "cell").sortWithinPartitions("cell", "side")
    return cells.mapInArrow(_meet(dim, mode), _BEST)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key by (score descending, id ascending); ``place`` from 1."""
    best = found.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))), 1, k).alias("b"))
    return best.select(*keys, F.posexplode("b").alias("place", "r")).select(*keys, (F.col("place") + 1).cast("int").alias("place"), F.col("r.id").alias("id"), (-F.col("r.down")).alias("score"))


def mine(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``vectors`` and ``anchors`` have id,
    label and v, as ``vectors_of`` makes them."""
    spark = tune(vectors.sparkSession)
    rows, asked = stored(vectors, "vectors"), stored(anchors, "anchors")
    dim, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    dim, sizes = max(1, dim), (asked.count(), n)
    with batch_rows(spark, BATCH):
        near = stored(_round(rows, asked, dim, sizes, "positives").select("anchor_id", "id", "score"), "positives")
        positives = _first(near, ["anchor_id"], POSITIVES).groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("ask"))
        pairs = asked.join(positives, asked["id"] == positives["anchor_id"]).drop("anchor_id")
        far = stored(_round(rows, pairs, dim, sizes, "negatives"), "negatives")
    top = _first(far, ["anchor_id", "positive_id", "positive_score"], NEGATIVES)
    return top.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir):
    """op13: anchors are the rows whose vec_id is divisible by 100, against all rows of ``embeddings``; where vec_id is
    divisible by 7 the label is the next one."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = vectors_of(moved)
    return mine(rows, rows.where(F.col("id") % 100 == 0))


ORACLE = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0
), p AS (
  SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""

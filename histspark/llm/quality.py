"""Quality scores: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic
calibration.

1. Every whole text becomes a short vector of statistics (narrow).
2. Labelled rows, at most about TRAIN_ROWS of them, give mean and deviation, then the sums ``Z'Z`` and ``Z'y`` of the random Fourier features, one pair of
   fixed size per partition; sums meet level by level, so the driver sees a few matrices whatever the corpus.
3. Scores of labelled rows kept out of the ridge are counted in fixed bins; pooled adjacent violators over the bins give
   the calibration curve, which is applied by interpolation.

Defined results: null text is the empty text and is scored; labels with null id or value are left out, a doc_id with
several labels takes the largest; without labels of both kinds every score is 0.5; an empty table gives no rows;
repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stored, text_of, tune

#: Random Fourier features, ridge strength, seed of the frequencies.
FEATURES, RIDGE, SEED = 300, 1e-3, 7
#: One of so many training rows is kept out of the ridge for calibration.
CALIBRATION = 4
#: Bins of the calibration counts over scores -0.5 to 1.5.
BINS = 2000
#: Partition sums that are added in one task.
FAN_IN = 16
#: Labelled rows the model is fitted on, about; of more a hash of doc_id chooses. Their ids and labels are sent to all tasks.
TRAIN_ROWS = 200_000

STATISTICS = ("bytes", "words", "word_mean", "word_dev", "word_max", "distinct", "top_word", "repeat", "upper", "digit", "symbol", "exclaim", "bar", "high", "space", "lines", "line_dup", "line_mean", "entropy", "packed", "punct_words")
_EXCLAIM, _BAR = ord("!"), ord("|")
_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()!|"]


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tally: dict[str, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    lines = text.split("\n")
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    return [
        np.log1p(n), np.log1p(len(words)), float(sizes.mean()), float(sizes.std()), np.log1p(float(sizes.max())),
        len(tally) / w, max(tally.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        float(counts[65:91].sum()) / letters, float(counts[48:58].sum()) / n, float(counts[_SYMBOLS].sum()) / n, counts[_EXCLAIM] / n, counts[_BAR] / n,
        float(counts[128:].sum()) / n, float(counts[32] + counts[10]) / n, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        float(-(p * np.log2(p)).sum()), len(zlib.compress(raw, 1)) / (n + 32), sum(x[-1] in ".,;:!?" for x in words) / w,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every row; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


def known(labels: DataFrame, column: str, folds: int, out: int, most: int | None = None) -> DataFrame:
    """doc_id and y of the labelled ids whose crc32(doc_id) mod folds is not ``out``, about ``most`` of them at most."""
    most = TRAIN_ROWS if most is None else most
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    one = stored(one.where(crc_mod("doc_id", folds) != out), "labels")
    total = one.count()
    return one if total <= most else one.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(1 << 30)) < int(most / total * (1 << 30)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def partition_sums(df: DataFrame, add) -> dict[str, np.ndarray]:
    """Sum ``add(batch) -> dict of arrays`` over all rows: one row per partition, then FAN_IN at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in add(batch).items():
                    total[k] = total.get(k, 0) + v
        if total:
            yield pa.record_batch([pa.array([k for k in total], pa.string()), pa.array([np.asarray(v, np.float64).tobytes() for v in total.values()], pa.binary())], names=["name", "sums"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": pdf["name"].iloc[:1], "sums": [sum(np.frombuffer(x) for x in pdf["sums"]).tobytes()]})

    sums = stored(df.mapInArrow(run, "name string, sums binary"), "partition-sums")
    while (most := sums.groupBy("name").count().agg(F.max("count")).first()[0] or 0) > FAN_IN:
        groups = -(-most // FAN_IN)
        slot = F.pmod(F.monotonically_increasing_id(), F.lit(groups))
        sums = stored(sums.withColumn("slot", slot).groupBy("name", "slot").applyInPandas(merge, "name string, sums binary"), "partition-sums")
    out: dict[str, np.ndarray] = {}
    for row in sums.collect():  # FAN_IN rows of fixed size for each name
        out[row["name"]] = out.get(row["name"], 0) + np.frombuffer(row["sums"])
    return out


class Model:
    """Standardised statistics -> random Fourier features -> ridge -> calibration curve."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, features: int = FEATURES, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.mean, self.dev = mean, np.where(dev > 1e-9, dev, 1.0)
        self.freq = draw.normal(0.0, 1.0 / np.sqrt(len(mean)), (len(mean), features))
        self.phase = draw.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.curve = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -8, 8)
        return np.hstack([np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.freq + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.curve), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over sorted x: block centres and their means."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(train: DataFrame) -> Model | None:
    """Fit on rows (doc_id, stats, y); None without both labels."""
    d = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        x, y = _matrix(batch), batch.column("y").to_numpy()
        return {"n": np.array([len(y), y.sum()]), "s": x.sum(0), "q": (x * x).sum(0)}

    m = partition_sums(train.select("stats", "y"), moments)
    if not m or not 0 < m["n"][1] < m["n"][0]:
        return None
    mean = m["s"] / m["n"][0]
    model = Model(mean, np.sqrt(np.maximum(m["q"] / m["n"][0] - mean**2, 0)))
    assert len(mean) == d
    share = m["n"][1] / m["n"][0]
    aside = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(CALIBRATION)) == 0

    def normal(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        z, y = model.features(_matrix(batch)), batch.column("y").to_numpy()
        w = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))[:, None]
        return {"a": (z.T @ (w * z)).ravel(), "b": z.T @ (w[:, 0] * y)}

    sums = partition_sums(train.where(~aside).select("stats", "y"), normal)
    if not sums:
        return None
    size = len(sums["b"])
    model.weights = np.linalg.solve(sums["a"].reshape(size, size) + RIDGE * m["n"][0] * np.eye(size) / size, sums["b"])

    def bins(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        s, y = model.raw(_matrix(batch)), batch.column("y").to_numpy()
        at = np.clip(((s + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return {"n": np.bincount(at, minlength=BINS), "y": np.bincount(at, y, BINS), "x": np.bincount(at, s, BINS)}

    held = partition_sums(train.where(aside).select("stats", "y"), bins)
    if held:
        full = held["n"] > 0
        n, y, x = (held[k][full] for k in ("n", "y", "x"))
        model.at, model.curve = isotonic(x / n, y / n, n)
        # a slight slope keeps the order of scores inside a block
        model.at = np.concatenate([[model.at[0] - 1], model.at, [model.at[-1] + 1]])
        model.curve = np.concatenate([[model.curve[0] * 0.9], model.curve, [min(1.0, 0.9 * model.curve[-1] + 0.1)]])
    else:
        model.at, model.curve = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from labels whose crc32(doc_id) mod folds is not ``out``."""
    tune(docs.sparkSession)
    stats = stored(with_statistics(docs), "statistics")
    model = fit(stored(stats.join(F.broadcast(known(labels, column, folds, out)), "doc_id").select("doc_id", "stats", "y"), "quality-train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.record_batch([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select("doc_id", (crc_mod("doc_id", folds) == out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 3, out: int = 1) -> DataFrame:
    """The rows of ``docs`` with score 0.5 or more, all columns kept; the decision is made on each row's own text.

    Statistics are worked out for the rows the model is fitted on, and then once for every row while it is judged.
    """
    tune(docs.sparkSession)
    ids = F.broadcast(known(labels, column, folds, out))
    train = with_statistics(docs.select("doc_id", "text").join(ids.select("doc_id"), docs["doc_id"].cast("long") == ids["doc_id"], "left_semi"))
    model = fit(stored(train.join(ids, "doc_id").select("doc_id", "stats", "y"), "quality-train"))
    if model is None:
        return docs
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    """op4: quality of all ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, labels)

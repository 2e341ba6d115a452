"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

1. Every text is tokenized once and stored as ids (narrow); the documents of each id are counted over the whole corpus.
2. Documents are put in one order by ``SIGS`` weighted min-hashes of their ids: an id draws in proportion to a power of
   its inverse document frequency, ids of one document or of more than ``FREQUENT`` of all draw nothing. Similar
   documents share the first hash; those of a heavy hash are ordered by the next ones, so near copies stay adjacent.
   The order is range-partitioned over the tasks and cut into index shards of about ``shard_tokens`` tokens.
3. Each shard builds a BM25 inverted index. The next unused document is the seed; its unused neighbours, best first, are
   appended until the window is full. The document that overflows is cut and its rest opens the next window as seed.
   Only the last window of a task can have padding.

Defined results: null text is the empty text (one token, the end id); a null doc_id is carried; repeated rows are
documents of their own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored, text_of, tune
from .tokens import cache_for

WINDOW = 4096
END_ID = 2
#: Tokens of one index shard.
SHARD_TOKENS = 2_000_000
#: Min-hashes that order the documents, and the power of idf by which ids draw.
SIGS, IDF_POWER = 4, 3
#: Ids in more than this share of all documents do not draw.
FREQUENT = 0.1
K1, B = 1.2, 0.75
#: Terms in more than 1/DENSE of a shard's documents are kept as rows, at most DENSE cells a posting.
DENSE = 8
#: Best neighbours fetched at once; when they are used up the next best follow.
FETCH = 32

_TOKENS = "uid long, doc_id long, ids binary"
_SIGNED = _TOKENS + ", sigs array<int>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _PIECES.split(", ")])


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """uid, doc_id, ids (with the end id) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(path)
        end = np.array([end_id], cache.dtype).tobytes()
        base, row = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            ids = [cache.ids(t) + end for t in batch.column("text").to_pylist()]
            uids = np.arange(base + row, base + row + len(ids))
            row += len(ids)
            yield pa.record_batch([pa.array(uids, pa.int64()), batch.column("doc_id"), pa.array(ids, pa.binary())], names=["uid", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _TOKENS)


def frequencies(tokens: DataFrame, dtype: np.dtype, size: int) -> np.ndarray:
    """Documents of each of the ``size`` ids of the vocabulary, in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                df[np.unique(np.frombuffer(ids, dtype))] += 1
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], names=["id", "df"])

    found = tokens.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()  # at most one row an id
    df = np.zeros(size, np.int64)
    df[found.column("id").to_numpy()] = found.column("df").to_numpy()
    return df


def draws(df: np.ndarray, docs: int) -> np.ndarray:
    """Per min-hash and id the draw of the id; a document's signature is its id of least draw."""
    idf = np.log1p((docs - df + 0.5) / (df + 0.5))
    weight = np.where((df > 1) & (df <= max(2.0, FREQUENT * docs)), idf**IDF_POWER, 1e-12)
    at = np.arange(1, 1 + len(df), dtype=np.uint64)
    chance = np.stack([((mix64(at * np.uint64(SIGS) + np.uint64(j)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53 for j in range(SIGS)])
    return (-np.log(chance) / weight).astype(np.float32)


def signatures(ids: np.ndarray, least: np.ndarray) -> list[int]:
    """The min-hashes of a document, the first one first."""
    return ids[least[:, ids].argmin(1)].tolist()


def ordered(tokens: DataFrame, dtype: np.dtype, size: int, tasks: int) -> DataFrame:
    """The documents in the order of their signatures, over ``tasks`` ranges; equal signatures are split by uid."""
    least = draws(frequencies(tokens, dtype, size), tokens.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signatures(np.frombuffer(x, dtype), least) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(sigs, pa.list_(pa.int32()))], names=["uid", "doc_id", "ids", "sigs"])

    return tokens.mapInArrow(run, _SIGNED).repartitionByRange(tasks, "sigs", "uid").sortWithinPartitions("sigs", "uid")


class Bm25Shard:
    """Inverted index of one shard: BM25 weights of each term's postings; terms of many documents as rows of all weights."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        sizes = np.array([len(x) for x in ids])
        doc = np.repeat(np.arange(n), sizes)
        wide = np.int32 if n < 1 << 14 and ids[0].dtype.itemsize == 2 else np.int64
        key, tf = np.unique(np.concatenate(ids).astype(wide) * wide(n) + doc.astype(wide), return_counts=True)
        term, self.doc = key // n, (key % n).astype(np.int64)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.first = np.append(first, len(term))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        length = K1 * (1 - B + B * sizes / max(1.0, sizes.mean()))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + length[self.doc])
        self.n = n
        dense = df * DENSE > n
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        posts = np.repeat(dense, df)
        self.rows = np.zeros((int(dense.sum()), n), np.float32)
        self.rows[np.repeat(self.row, df)[posts], self.doc[posts]] = self.weight[posts]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """BM25 scores of all documents for the distinct terms of ``ids``."""
        at = np.searchsorted(self.terms, np.unique(ids))
        row = self.row[at]
        many = np.add.reduce(self.rows[row[row >= 0]], 0, dtype=np.float32)
        at = at[row < 0]
        lo, sizes = self.first[at], self.first[at + 1] - self.first[at]
        posts = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return many + np.bincount(self.doc[posts], self.weight[posts], self.n)


class Windows:
    """The open window of a task and the pieces made so far."""

    def __init__(self, base: int, window: int):
        self.sequence, self.used, self.window, self.rows = base, 0, window, []

    def put(self, doc_id: int | None, ids: np.ndarray) -> int:
        """Append a document, cut at window ends; tokens of it in the open window."""
        start = 0
        while start < len(ids):
            length = min(len(ids) - start, self.window - self.used)
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            self.rows.append((doc_id, start, length, crc, len(ids), self.sequence, self.used))
            start += length
            self.used += length
            if self.used == self.window:
                self.sequence, self.used = self.sequence + 1, 0
        return self.used

    def take(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        for at in range(0, len(rows), 8192):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 8192], strict=True)], schema=_PIECES_ARROW)


def pack_shard(docs: list[tuple[int | None, np.ndarray]], windows: Windows) -> None:
    """Put all documents of a shard into windows: a seed, then its unused neighbours, best first.

    The neighbour that is cut at a window's end seeds the next window. When no unused document shares a term with the
    seed, the next unused document goes on in the open window as its new seed.
    """
    index = Bm25Shard([ids for _, ids in docs])
    unused = np.ones(len(docs), bool)
    following, query = 0, None
    while True:
        if query is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                return
            query = following
            unused[query] = False
            if windows.put(*docs[query]) == 0:
                query = None
                continue
        query = _fill(index, docs, unused, query, windows)


def _fill(index: Bm25Shard, docs: list, unused: np.ndarray, query: int, windows: Windows) -> int | None:
    """Fill the open window with neighbours of ``query``; the cut document, or None when there is none."""
    current = windows.sequence
    score = np.where(unused, index.scores(docs[query][1]), -1.0)
    while best := _best(score):
        for near in best:
            unused[near], score[near] = False, -1.0
            left = windows.put(*docs[near])
            if windows.sequence != current:
                return near if left else None
    return None


def _best(score: np.ndarray) -> list[int]:
    """The best unused neighbours, best first; ties by position; empty when none shares a term."""
    k = min(FETCH, len(score))
    top = np.argpartition(-score, k - 1)[:k]
    top = top[np.lexsort((top, -score[top]))]
    top = top[score[top] > 0]
    return top.tolist()


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents in windows of ``window`` tokens."""
    spark = tune(docs.sparkSession)
    cache = cache_for(path)
    dtype, size = cache.dtype, len(cache.packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(TaskContext.get().partitionId() << 32, window)
        held, mass = [], 0
        for batch in batches:
            for doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids")), strict=True):
                held.append((doc_id, np.frombuffer(ids, dtype)))
                mass += len(held[-1][1])
                if mass >= shard_tokens:
                    pack_shard(held, windows)
                    yield from windows.take()
                    held, mass = [], 0
        if held:
            pack_shard(held, windows)
            yield from windows.take()

    tokens = stored(tokenize(docs, path, end_id), "tokens")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ordered(tokens, dtype, size, tasks).select("doc_id", "ids").mapInArrow(run, _PIECES)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    return public_tokenizers.path(name)


def query(spark, sf_dir):
    """op1: all ``documents`` packed into sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())

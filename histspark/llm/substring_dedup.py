"""Removal of repeated 50-word passages behind a count-min prefilter.

Few windows occur in several documents, so windows are counted approximately first and only those estimated repeated are
grouped exactly:

1. Equal texts become one content with its least doc_id. Contents are packed into chunks of a few megabytes.
2. Every chunk makes a count-min sketch of its distinct windows, in coordinate form: a window's hash names a block of the
   sketch and a cell number in it, from which one cell of each of the block's rows follows. Blocks are as many as the text
   has megabytes, so a block stays small at any size and no task or driver holds the sketch.
3. The sketches of all chunks are merged block by block. A window's estimate is the least of its cells; cells only ever
   count too much, so no window that occurs twice is estimated once. Each chunk gets one bit back per window it asked for.
4. The second pass finds the windows with a set bit again, names each by 128 bits of BLAKE2 over its whole words, and the
   least doc_id of every name is an exact aggregation. Covered words are merged per content and cut.

Defined results: null text has no words; a row repeated whole (same doc_id) removes nothing of the other; a null doc_id
neither removes nor loses words; texts under 50 words stay whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, byte_chunks, mix64, stored, text_of, tune, utf8
from .wordhash import SPACE, _power, word_hashes

#: Words of a window.
WINDOW = 50
#: Bytes of text of one chunk, of one block of the sketch, and that are hashed at once.
CHUNK, BLOCK, PIECE = 4 << 20, 4 << 20, 1 << 20
#: Rows of a block of the sketch, and cells of a row for each window that was counted.
DEPTH, LOAD = 4, 8

_ODD = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09]
_CHUNKS = "chunk binary, c1 binary, c2 binary, doc binary, ends binary, text binary"


def _pieces(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of about PIECE bytes; a longer text comes in several, cut at white space."""
    for a, b in byte_chunks(np.diff(offsets), PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b > a + 1 or hi - lo <= PIECE:
            yield a, flat[lo:hi], offsets[a : b + 1] - lo
            continue
        while lo < hi:
            end = min(hi, lo + PIECE)
            while end < hi and not SPACE[flat[end]]:
                end = min(hi, end + 1 + int(np.argmax(np.append(SPACE[flat[end + 1 : end + 1 + PIECE]], True))))
            yield a, flat[lo:end], np.array([0, end - lo])
            lo = end


def chunk_words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, case kept, and per text the offset of its first word."""
    counts, parts = np.zeros(len(offsets), np.int64), []
    for first, part, at in _pieces(flat, offsets):
        h, words = word_hashes(part, at, fold=False)
        parts.append(h)
        counts[first + 1 : first + len(at)] += np.diff(words)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(counts)


def window_hashes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word in the text) of every window; windows never cross texts."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _power("up", n), out=sums[1:])
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), np.maximum(size - WINDOW + 1, 0))
    count = np.bincount(text, minlength=len(size))
    inside = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = at[:-1][text] + inside
    return mix64((sums[start + WINDOW] - sums[start]) * _power("down", n)[start]), text, inside


class Windows:
    """The distinct windows of a chunk in hash order, and where each occurs."""

    def __init__(self, hashes: np.ndarray, text: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")  # texts ascend among equal hashes
        ranked, owner = hashes[self.order], text[self.order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(ranked))
        self.hashes = ranked[self.first]
        self.many = owner[self.first] != owner[self.last - 1] if len(ranked) else np.zeros(0, bool)

    def blocks(self, blocks: int) -> Iterator[tuple[int, int, int]]:
        """(block, from, to) of the blocks that have windows."""
        block = ((self.hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
        for i, a in enumerate(starts):
            yield int(block[a]), int(a), int(starts[i + 1]) if i + 1 < len(starts) else len(block)

    def occurrences(self, chosen: np.ndarray) -> np.ndarray:
        """Places (indexes of the hashes given) of the chosen distinct windows, in order."""
        size = (self.last - self.first)[chosen]
        base = np.repeat(self.first[chosen] - (np.cumsum(size) - size), size)
        return np.sort(self.order[base + np.arange(len(base))])


def estimated_repeated(cells: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of the counted cell numbers a merged block estimates at two or more; ``many`` counts twice."""
    width = max(4, int(len(cells) * LOAD).bit_length())
    out = np.ones(len(cells), bool)
    weight = None if not many.any() else 1.0 + many
    for odd in _ODD[:DEPTH]:
        at = ((cells.astype(np.uint64) * np.uint64(odd)) & np.uint64(0xFFFFFFFF)) >> np.uint64(max(0, 32 - width))
        counts = np.bincount(at.astype(np.int64), weight, minlength=1)
        out &= counts[at.astype(np.int64)] >= 2
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents to chunks: one row each of about CHUNK bytes of text. Contents that take no part in the search (no doc_id)
    have the largest number as theirs."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        c1, c2, doc, text = zip(*held, strict=True)
        ends = np.cumsum([len(t) for t in text])
        key = np.array([c1[0], c2[0]], "<i8").tobytes()
        ids = np.array([np.iinfo(np.int64).max if d is None else d for d in doc], "<i8")
        row = [key, *(np.array(x, "<i8").tobytes() for x in (c1, c2, ids, ends)), b"".join(text)]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=[c.split()[0] for c in _CHUNKS.split(", ")])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "doc", "text")), strict=True):
            if held and size + len(row[3]) > CHUNK:
                yield out()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield out()


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, text offsets, c1, c2, doc) of a chunk."""
    ints = lambda name: np.frombuffer(row[name], "<i8")
    return np.frombuffer(row["text"], np.uint8), np.append(0, ints("ends")), ints("c1"), ints("c2"), ints("doc")


def _searched(row: dict) -> tuple[Windows, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat, offsets, _, _, doc = _opened(row)
    words, at = chunk_words(flat, offsets)
    hashes, text, inside = window_hashes(words, at)
    with_id = (doc != np.iinfo(np.int64).max)[text]
    hashes, text, inside = hashes[with_id], text[with_id], inside[with_id]
    return Windows(hashes, text), text, inside, at, doc


def sketches(blocks: int):
    """First pass: a chunk's sketch, one row for each block it has cells in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                windows, *_ = _searched(row)
                cells = (windows.hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
                parts = list(windows.blocks(blocks))
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _, _ in parts], pa.int32()), pa.array([row["chunk"]] * len(parts), pa.binary()),
                    pa.array([cells[a:e].tobytes() for _, a, e in parts], pa.binary()), pa.array([np.packbits(windows.many[a:e]).tobytes() for _, a, e in parts], pa.binary()),
                ], names=["block", "chunk", "cells", "many"])

    return run


def _merged(table: pa.Table) -> pa.Table:
    """Merge the sketches of one block and answer every chunk: a bit for each of its cells."""
    cells = [np.frombuffer(x, "<u4") for x in table.column("cells").to_pylist()]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(c)).astype(bool) for m, c in zip(table.column("many").to_pylist(), cells, strict=True)]
    hit = estimated_repeated(np.concatenate(cells), np.concatenate(many))
    ends = np.cumsum([len(c) for c in cells])
    bits = [hit[e - len(c) : e] for c, e in zip(cells, ends.tolist(), strict=True)]
    some = [i for i, b in enumerate(bits) if b.any()]
    return pa.table({"chunk": table.column("chunk").take(pa.array(some, pa.int64())), "block": table.column("block").take(pa.array(some, pa.int64())), "bits": pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary())})


_FOUND = "kind int, c1 long, c2 long, doc long, n_words long, sha binary, body binary, pos int, d1 long, d2 long"
_FOUND_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def candidates(blocks: int):
    """Second pass. Kind 0: a content's words and hash, with its words where some window is estimated repeated.
    Kind 1: where such a window starts, and its name."""

    def batch_of(kind: int, n: int, **own) -> pa.RecordBatch:
        columns = {"kind": pa.array(np.full(n, kind, np.int32)), **own}
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in zip(_FOUND_NAMES, _FOUND_TYPES, strict=True)], names=_FOUND_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                windows, text, inside, at, doc = _searched(row)
                flat, offsets, c1, c2, _ = _opened(row)
                answers = {x["block"]: x["bits"] for x in row["answers"] or []}
                chosen = np.zeros(len(windows.hashes), bool)
                for block, a, e in windows.blocks(blocks):
                    if block in answers:
                        chosen[a:e] = np.unpackbits(np.frombuffer(answers[block], np.uint8), count=e - a).astype(bool)
                places = windows.occurrences(chosen)
                text, inside = text[places], inside[places]
                cut = np.searchsorted(text, np.arange(len(doc) + 1)).tolist()
                raw, shas, bodies = flat.tobytes(), [], []
                names = np.empty((len(places), 2), "<i8")
                for d in range(len(doc)):
                    words = raw[offsets[d] : offsets[d + 1]].split()
                    body = b" ".join(words)
                    shas.append(hashlib.sha256(body).digest())
                    bodies.append(body if cut[d] < cut[d + 1] else None)
                    if cut[d] == cut[d + 1]:
                        continue
                    start = np.zeros(len(words) + 1, np.int64)
                    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=start[1:])
                    mine = inside[cut[d] : cut[d + 1]]
                    digest = [hashlib.blake2b(body[s:e], digest_size=16).digest() for s, e in zip(start[mine].tolist(), (start[mine + WINDOW] - 1).tolist(), strict=True)]
                    names[cut[d] : cut[d + 1]] = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                ids = pa.array(doc, mask=doc == np.iinfo(np.int64).max)
                yield batch_of(0, len(doc), c1=pa.array(c1), c2=pa.array(c2), doc=ids, n_words=pa.array(np.diff(at)), sha=pa.array(shas, pa.binary()), body=pa.array(bodies, pa.binary()))
                for a in range(0, len(places), 50_000):
                    t, part = text[a : a + 50_000], slice(a, a + 50_000)
                    yield batch_of(1, len(t), c1=pa.array(c1[t]), c2=pa.array(c2[t]), doc=pa.array(doc[t]), pos=pa.array(inside[part].astype(np.int32)), d1=pa.array(names[part, 0].copy()), d2=pa.array(names[part, 1].copy()))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words that windows at ``covered`` cover."""
    for batch in batches:
        removed, kept = [], []
        for body, covered in zip(batch.column("body").to_pylist(), batch.column("covered").to_pylist(), strict=True):
            words = body.split(b" ")
            edge = np.zeros(len(words) + 1, np.int64)
            starts = np.unique(np.array(covered, np.int64))
            edge[starts] += 1
            edge[starts + WINDOW] -= 1
            stay = np.cumsum(edge[:-1]) == 0
            removed.append(int(len(words) - stay.sum()))
            kept.append(hashlib.sha256(b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])).digest())
        yield pa.record_batch([batch.column("c1"), batch.column("c2"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["c1", "c2", "removed", "kept"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    spark = tune(docs.sparkSession)
    text = text_of()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(1), text).alias("c2"))
    rows = stored(base.select("doc_id", "c1", "c2", F.octet_length("text").alias("n_bytes")), "rows")
    contents = base.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.first("text").alias("text"))
    chunks = stored(contents.mapInArrow(_packed, _CHUNKS), "chunks")
    blocks = int(rows.agg(F.sum("n_bytes")).first()[0] or 0) // BLOCK + 1

    with batch_rows(spark, 8):
        cells = chunks.mapInArrow(sketches(blocks), "block int, chunk binary, cells binary, many binary")
        answers = stored(cells.groupBy("block").applyInArrow(_merged, "chunk binary, block int, bits binary"), "answers")
        asked = answers.groupBy(F.col("chunk").alias("_of")).agg(F.collect_list(F.struct("block", "bits")).alias("answers"))
        found = stored(chunks.join(asked.hint("shuffle_hash"), F.col("chunk") == F.col("_of"), "left").drop("_of").mapInArrow(candidates(blocks), _FOUND), "candidates", ("kind",))

    facts = found.where("kind = 0")
    places = found.where("kind = 1").select("c1", "c2", "doc", "pos", "d1", "d2")
    # stored, so that both sides of the join are plain shuffles and a window of very many documents can be split
    least = stored(places.groupBy("d1", "d2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("d1", "d2", "least"), "least")
    covered = places.join(least, ["d1", "d2"]).where("least < doc").groupBy("c1", "c2").agg(F.collect_list("pos").alias("covered"))
    marked = facts.where("body is not null").select("c1", "c2", "body").join(covered.hint("shuffle_hash"), ["c1", "c2"])
    cut = stored(marked.mapInArrow(_cut, "c1 long, c2 long, removed long, kept binary"), "cut")

    known = facts.select("c1", "c2", "n_words", "sha", F.col("doc").alias("lead")).join(cut, ["c1", "c2"], "left")
    copy = (F.col("doc_id") > F.col("lead")) & (F.col("n_words") >= WINDOW)
    own = F.col("doc_id") == F.col("lead")
    return rows.join(known, ["c1", "c2"]).select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex(F.when(own, F.coalesce("kept", "sha")).otherwise(F.col("sha"))))).alias("kept_sha256"),
    )


def query(spark, sf_dir):
    """op12: repeated passages of all ``documents``."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     keyed AS (SELECT r, doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50 AND doc_id IS NOT NULL)),
     least AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k),
     covered AS (SELECT DISTINCT r, p + o AS q FROM keyed JOIN least USING (k) CROSS JOIN range(50) AS t(o) WHERE m < doc_id),
     gone AS (SELECT r, list(q) AS qs FROM covered GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN qs IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""

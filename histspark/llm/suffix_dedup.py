"""Removal of repeated passages by suffix arrays over content-defined segments.

Every byte covered by a 50-byte string that also starts in a document of a smaller doc_id is removed; strings are judged
on the input. Suffix arrays are local, so equal strings have to meet in one task:

1. Each 50-byte window has one anchor, the least hash among the 24-byte strings in it (the first of equals). Equal
   windows have equal anchors at equal places. Anchors of different contents that share no hash cannot share a window,
   so one shuffle of anchor hashes leaves the contents with shared anchors.
2. Around each shared anchor its windows form one short segment. Distinct segments go, once per task, to the task of
   their anchor hash; where each lies stays with the documents.
3. There a suffix array over the segments' windows (two-stage sorting, then adjacent common prefixes) groups equal
   windows and gives the least doc_id of each.
4. Window results return to the places of their segments; covered bytes are merged per document and cut.

Texts that equal a whole text of a smaller doc_id need none of this. An anchor with very many distinct segments is
split by its windows instead and summed natively, so no task holds a hot group.

Steps 3 and 4 go by slices of the anchors, one after the other, so that only one slice of the segments is shuffled at a
time; a slice's segments, and every other table, go when nothing reads them any more.

Defined results: null text is the empty text; rows repeated whole (same doc_id) do not remove each other; a null doc_id
neither removes nor loses bytes; texts under 50 bytes stay whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, byte_chunks, drop, mix64, stored, tables_of, text_of, tune, utf8
from .suffix_array import order

#: Bytes of a repeated string, and of the strings that anchors are chosen from.
WINDOW, GRAM = 50, 24
#: Bytes hashed at once (positions need 20 bits), and bytes of segments in one suffix array.
CHUNK, ARRAY = (1 << 20) - 64, 1 << 20
#: Rows of an Arrow batch of anchors.
BATCH = 2000
#: Segments of one anchor that go through a suffix array at most.
HOT = 20_000
#: Bytes of text whose segments make one slice, and slices at most (each has two jobs and its own files).
SLICE_BYTES, SLICES = 128 << 20, 16

_BYTES = mix64(np.arange(301, 557, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)


def _gram_hashes(flat: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes at every position (the last ones wrap over nothing and are not used)."""
    power = lambda n: np.uint64(pow(_STEP, n, 1 << 64))
    h, size = {1: _BYTES[flat]}, 1
    while size < 16:
        a = h[size]
        h[2 * size] = a[: len(a) - size] * power(size) + a[size:]
        size *= 2
    long, short = h[16], h[8]
    return long[: len(flat) - GRAM + 1] * power(8) + short[16 : 16 + len(flat) - GRAM + 1]


def anchor_places(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of every window of ``flat``, and the hashes at every position.

    Windows may cross texts; ``anchors`` leaves those out."""
    h = _gram_hashes(flat)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, least, size = WINDOW - GRAM + 1, key, 1
    while 2 * size <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    n = len(flat) - WINDOW + 1
    least = np.minimum(least[:n], least[width - size : width - size + n])
    return (least & _LOW).astype(np.int64), h


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first window, window count and hash of every anchor run of the texts in ``flat``.

    A run's first window counts from its text's start. Long texts are cut into overlapping pieces."""
    out: list[tuple[np.ndarray, ...]] = []
    for a, b in byte_chunks(np.diff(offsets), CHUNK):
        lo, hi = int(offsets[a]), int(offsets[b])
        for piece in range(lo, max(hi - WINDOW + 1, lo + 1), CHUNK - WINDOW + 1):
            end = min(hi, piece + CHUNK)
            if end - piece < WINDOW:
                break
            at, h = anchor_places(flat[piece:end])
            starts = np.arange(piece, end - WINDOW + 1)
            text = np.searchsorted(offsets, starts, side="right") - 1
            valid = starts + WINDOW <= offsets[text + 1]
            starts, text, at = starts[valid], text[valid], at[valid]
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(starts)))
            out.append((text[first], starts[first] - offsets[text[first]], count, h[at[first]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, content) once per content and task."""
    seen: set[int] = set()
    for batch in batches:
        flat, offsets = utf8(batch.column("text"))
        keys = batch.column("c1").to_numpy()
        text, _, _, h = anchors(flat, offsets)
        cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
        hashes, owners = [], []
        for i, k in enumerate(keys.tolist()):
            if k in seen or cut[i] == cut[i + 1]:
                continue
            if len(seen) < 1_000_000:
                seen.add(k)
            own = np.unique(h[cut[i] : cut[i + 1]])
            hashes.append(own)
            owners.append(np.full(len(own), k))
        if hashes:
            hs, ks = np.concatenate(hashes), np.concatenate(owners)
            for at in range(0, len(hs), 100_000):
                yield pa.record_batch([pa.array(hs[at : at + 100_000]), pa.array(ks[at : at + 100_000])], names=["h", "c1"])


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (h, c1): those stay whose hash belongs to several contents."""
    carry: tuple[int, int, bool] | None = None
    for batch in batches:
        h, c = batch.column("h").to_numpy(), batch.column("c1").to_numpy()
        gone = False
        if carry is not None:
            h, c, gone = np.concatenate([[carry[0]], h]), np.concatenate([[carry[1]], c]), carry[2]
        if not len(h):
            continue
        repeat = np.zeros(len(h), bool)
        repeat[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        if gone:
            repeat[0] = False
        h2, c2 = h[~repeat], c[~repeat]  # one row per (h, content)
        same = h2[1:] == h2[:-1]
        keep = np.zeros(len(h2), bool)
        keep[1:] |= same
        keep[:-1] |= same
        last = bool(keep[-1])
        if gone:
            last = last or len(h2) == 1
            keep[0] = False
        if keep.any():
            yield pa.record_batch([pa.array(h2[keep]), pa.array(c2[keep])], names=["h", "c1"])
        carry = (int(h2[-1]), int(c2[-1]), last)


_SEGMENTS = "kind int, s1 long, s2 long, uid long, start long, h long, low long, high long, body binary"
_NAMES = [c.split()[0] for c in _SEGMENTS.split(", ")]
#: Segments that a task holds before they are sent on.
HELD = 300_000


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: where a segment (named by 128 bits) lies, with its anchor. Kind 1: a distinct segment of the task with the
    least and the largest doc_id it occurs in."""
    held: dict[bytes, list] = {}

    def halves(names: list[bytes]) -> tuple[pa.Array, pa.Array]:
        two = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
        return pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())

    def flush() -> Iterator[pa.RecordBatch]:
        items = list(held.items())
        held.clear()
        for at in range(0, len(items), 20_000):
            part = items[at : at + 20_000]
            none = pa.nulls(len(part), pa.int64())
            h, low, high, body = zip(*[v for _, v in part], strict=True)
            yield pa.record_batch([pa.array([1] * len(part), pa.int32()), *halves([k for k, _ in part]), none, none, pa.array(h), pa.array(low), pa.array(high), pa.array(body, pa.binary())], names=_NAMES)

    for batch in batches:
        flat, offsets = utf8(batch.column("text"))
        raw = flat.tobytes()
        text, first, count, h = anchors(flat, offsets)
        ids, uids, shared = (batch.column(c).to_pylist() for c in ("doc_id", "uid", "shared"))
        cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
        names, owners, starts, hashes = [], [], [], []
        for i, doc in enumerate(ids):
            a, b = cut[i], cut[i + 1]
            hit = np.flatnonzero(np.isin(h[a:b], np.array(shared[i], np.int64))) + a
            base = int(offsets[i])
            owners += [uids[i]] * len(hit)
            hashes += (own := h[hit].tolist())
            for s, n, x in zip(first[hit].tolist(), count[hit].tolist(), own, strict=True):
                body = raw[base + s : base + s + n + WINDOW - 1]
                name = hashlib.blake2b(body, digest_size=16).digest()
                names.append(name)
                starts.append(s)
                if (v := held.get(name)) is None:
                    held[name] = [x, doc, doc, body]
                elif doc < v[1]:
                    v[1] = doc
                elif doc > v[2]:
                    v[2] = doc
        for at in range(0, len(names), 50_000):
            part = slice(at, at + 50_000)
            size = len(names[part])
            none = pa.nulls(size, pa.int64())
            yield pa.record_batch([pa.array([0] * size, pa.int32()), *halves(names[part]), pa.array(owners[part]), pa.array(starts[part]), pa.array(hashes[part]), none, none, pa.nulls(size, pa.binary())], names=_NAMES)
        if len(held) > HELD:
            yield from flush()
    yield from flush()


_RESULT = "s1 long, s2 long, lo int, hi int, least long"


def window_runs(bodies: list[bytes], docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array over the windows of segments: (segment, first window, last window, least doc_id) runs."""
    text = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(bodies)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[owner] + inside
    ranked, same = order(text, at, WINDOW)
    place = np.zeros(len(text), np.int64)
    place[at] = np.arange(len(at))
    rows = place[ranked]
    starts = np.flatnonzero(~same)
    least = np.minimum.reduceat(np.array(docs, np.int64)[owner[rows]], starts)
    result = np.zeros(len(at), np.int64)
    result[rows] = np.repeat(least, np.diff(np.append(starts, len(rows))))
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (result[1:] != result[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return owner[first], inside[first], inside[last], result[first]


def _sorted_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (h, s1, s2); whole anchor groups are gathered to about ARRAY bytes for one suffix array. Only
    windows that lie in some document above their least one come out."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        s1, s2, low, high = (rows.column(c).to_numpy() for c in ("s1", "s2", "low", "high"))
        first = np.flatnonzero(np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]))
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        owner, lo, hi, least = window_runs(rows.column("body").take(pa.array(first)).to_pylist(), low)
        keep = least < high[owner]
        owner, lo, hi, least = first[owner[keep]], lo[keep].astype(np.int32), hi[keep].astype(np.int32), least[keep]
        for a in range(0, len(owner), 50_000):
            part = slice(a, a + 50_000)
            yield pa.record_batch([pa.array(s1[owner[part]]), pa.array(s2[owner[part]]), pa.array(lo[part]), pa.array(hi[part]), pa.array(least[part])], names=["s1", "s2", "lo", "hi", "least"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("body").nbytes
        if size > ARRAY:
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if whole:
                yield from out(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
            size = sum(b.column("body").nbytes for b in held)
    if held:
        yield from out(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge covered ranges (sorted) and hash what is left."""
    for batch in batches:
        flat, offsets = utf8(batch.column("text"))
        ranges = batch.column("ranges")
        owner = np.repeat(np.arange(batch.num_rows), ranges.value_lengths().to_numpy())
        s, e, least = (x.to_numpy() for x in ranges.flatten().flatten())
        keep = least < batch.column("doc_id").to_numpy()[owner]
        owner, s, e = owner[keep], offsets[owner[keep]] + s[keep], offsets[owner[keep]] + e[keep]
        reach = np.maximum.accumulate(e)
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        lo, hi, owner = s[first], reach[np.append(first[1:], len(s)) - 1] if len(s) else s, owner[first]
        removed = np.zeros(batch.num_rows, np.int64)
        np.add.at(removed, owner, hi - lo)
        cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        kept = []
        for i in range(batch.num_rows):
            at, left = int(offsets[i]), hashlib.sha256()
            for a, b in zip(lo[cut[i] : cut[i + 1]].tolist(), hi[cut[i] : cut[i + 1]].tolist(), strict=True):
                left.update(flat[at:a])
                at = b
            left.update(flat[at : int(offsets[i + 1])])
            kept.append(left.hexdigest())
        yield pa.record_batch([batch.column("c1"), batch.column("c2"), pa.array(removed), pa.array(np.diff(cut).astype(np.int64)), pa.array(kept, pa.string())], names=["c1", "c2", "removed", "spans", "kept"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = tune(docs.sparkSession)
    with tables_of(spark) as tables:
        return _repeats(spark, docs, tables)


def _repeats(spark: SparkSession, docs: DataFrame, tables: list[str]) -> DataFrame:
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_of()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(1), text).alias("c2"))
    rows = stored(base.select("doc_id", "c1", "c2", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "rows")
    lead = stored(rows.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= WINDOW)).groupBy("c1", "c2").agg(F.min("doc_id").alias("lead")), "contents")
    slices = min(SLICES, -(-(rows.agg(F.sum("n_bytes")).first()[0] or 1) // SLICE_BYTES))
    used = len(tables)  # rows and contents stay, the result reads them

    found = base.where((F.octet_length("text") >= WINDOW) & F.col("doc_id").isNotNull()).select("c1", "text").mapInArrow(_anchor_rows, "h long, c1 long")
    with batch_rows(spark, BATCH):
        shared = stored(found.repartition(tasks, "h").sortWithinPartitions("h", "c1").mapInArrow(_shared_rows, "h long, c1 long"), "shared-anchors")
    wanted = shared.groupBy("c1").agg(F.collect_set("h").alias("shared")).join(lead, "c1")
    texts = base.join(wanted.select(F.col("c1").alias("w1"), F.col("c2").alias("w2"), "lead", "shared").hint("shuffle_hash"), (F.col("c1") == F.col("w1")) & (F.col("c2") == F.col("w2")) & (F.col("doc_id") == F.col("lead")))
    texts = texts.select("doc_id", "c1", "c2", "text", "shared")
    if not rows.groupBy("doc_id", "c1", "c2").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["c1", "c2"])  # rows repeated whole are one content
    texts = stored(texts.withColumn("uid", F.monotonically_increasing_id()), "affected")
    drop(spark, [tables.pop(used)])  # shared-anchors
    ranges = _ranges(spark, texts, slices, tasks, tables)
    marked = texts.select("uid", "doc_id", "c1", "c2", "text").join(ranges.hint("shuffle_hash"), "uid").drop("uid")
    cut = stored(marked.mapInArrow(_cut, "c1 long, c2 long, removed long, spans long, kept string"), "cut")
    drop(spark, tables[used:-1])
    del tables[used:-1]

    copy = F.col("doc_id") > F.col("lead")
    all_rows = rows.join(lead.join(cut, ["c1", "c2"], "left"), ["c1", "c2"], "left")
    return all_rows.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("kept")), F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def _ranges(spark: SparkSession, texts: DataFrame, slices: int, tasks: int, tables: list[str]) -> DataFrame:
    """uid and its sorted covered ranges, (start, end, least doc_id) each; one slice of the anchors after the other."""
    part = F.pmod(F.xxhash64("h"), F.lit(slices)) + F.col("kind") * slices
    anchor = F.when(F.col("kind") == 1, F.col("h")).alias("h")  # places need it for their slice alone
    segments = stored(texts.mapInArrow(_segment_rows, _SEGMENTS).select("s1", "s2", "uid", "start", anchor, "low", "high", "body", part.cast("int").alias("part")), "segments", ("part",))
    where, used = tables[-1], len(tables)
    hot = stored(segments.where(F.col("part") >= slices).groupBy("h").count().where(F.col("count") > HOT).select("h"), "hot-anchors")
    any_hot = not hot.isEmpty()
    per = max(-(-tasks // slices), min(tasks, 2 * spark.sparkContext.defaultParallelism))
    covered = []
    for i in range(slices):
        bodies = segments.where(F.col("part") == slices + i).select("h", "s1", "s2", "low", "high", "body")
        # at most one hot anchor for HOT rows
        runs = bodies.join(F.broadcast(hot), "h", "left_anti") if any_hot else bodies
        runs = runs.repartition(per, "h").sortWithinPartitions("h", "s1", "s2").mapInArrow(_sorted_segments, _RESULT)
        if any_hot:
            runs = runs.unionByName(_hot_runs(bodies.join(F.broadcast(hot), "h", "left_semi")))
        with batch_rows(spark, BATCH):
            runs = stored(runs, "window-runs")
        drop(spark, [f"{where}/part={slices + i}"])
        places = segments.where(F.col("part") == i).select("s1", "s2", "uid", "start")
        covered.append(stored(places.join(runs, ["s1", "s2"]).select("uid", (F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") + WINDOW).alias("e"), "least"), "covered"))
        drop(spark, [f"{where}/part={i}", tables.pop(-2)])  # places and runs of the slice
    whole = reduce(DataFrame.unionByName, covered)
    ranges = stored(whole.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", "e", "least"))).alias("ranges")), "ranges")
    drop(spark, [where, *tables[used:-1]])
    del tables[used - 1 : -1]
    return ranges


def _hot_runs(bodies: DataFrame) -> DataFrame:
    """The exact way for anchors of very many segments: windows as rows, least doc_id by aggregation."""
    one = bodies.groupBy("s1", "s2").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("body").alias("body"))
    at = one.select("s1", "s2", "low", "high", "body", F.explode(F.sequence(F.lit(0), F.octet_length("body") - WINDOW)).alias("lo"))
    windows = at.select("s1", "s2", "low", "high", "lo", F.substring("body", F.col("lo") + 1, F.lit(WINDOW)).alias("w"))
    least = windows.groupBy("w").agg(F.min("low").alias("least"))
    return windows.join(least, "w").where("least < high").select("s1", "s2", F.col("lo").cast("int").alias("lo"), F.col("lo").cast("int").alias("hi"), "least")


def query(spark, sf_dir):
    """op6: repeated passages of all ``documents``."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

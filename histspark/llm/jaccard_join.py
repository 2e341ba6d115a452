"""Exact self-join of word shingle sets under Jaccard similarity by universe partitioning.

Two sets link when ``den * |x & y| >= num * |x | y|``; then their symmetric difference is at most a bound H that follows
from their sizes. Sizes are cut into bands so that linked sets lie in the same band or in neighbours. For a band the token
universe is hashed into m > H segments. A set spends H + 1 units on its segments: none, one (the partner's segment must be
equal) or two (it may differ by one token, which the one-deletion neighbourhoods of the designated segments find). By the
pigeonhole principle some segment of the partner agrees within its units.

Units are allocated by cost. All segments and neighbourhoods are indexed first and the signatures that several classes
share are counted; each set then spends its units where the fewest partners of other components are expected, so a
frequent signature is asked for only where the set has no H + 1 cheaper units. A set that finds H + 1 segments which no
other class shares cannot link and goes at once. Of two sets the one with the cheaper allocation asks. The units also bound every run of segments behind the one that agreed (cycle lemma: from some agreeing
segment on, no run differs by as much as its units); parities of the next segments' tokens, and of the whole sets, give
lower bounds of those differences, so most pairs that agree in one segment by chance are never formed.

Equal sets are collapsed to one class before anything is paired. Candidates go through an exact lower bound (parities of
hashed tokens, as many bits as tokens: each differing token changes at most one bit) and are then verified on the whole
sets of 64-bit shingle hashes, so results are exact up to hash collisions. Classes of one signature are first paired with
one pivot only; pairs inside a component already found are never formed. No link between components is lost. ``links``
gives all links between classes instead.

Defined results: a text without words (or null) has no shingles and links with nothing; rows repeated whole are equal
sets; a null doc_id takes part but never names a component unless all its members have none; an empty table gives no
rows; extra columns are ignored by ``components`` and kept by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, byte_chunks, mix64, stored, text_of, tune, utf8
from .wordhash import shingle_sets, word_hashes

#: Words of a shingle; similarity as a fraction.
K, NUM, DEN = 4, 85, 100
#: Segments whose one-deletion neighbourhoods are indexed.
DESIGNATED = 2
#: Fewest bits of a parity sketch of a set.
SKETCH = 512
#: Segments behind an agreeing one whose parities (32 bits each, two to a word) bound the difference.
CHAIN = 8
#: Times that sets without a chance to link are taken out; a second time took out 0.2% more of the signatures.
ROUNDS = 1
#: Bytes of text that are hashed at once, and rows of an Arrow batch of signatures.
CHUNK, BATCH = 1 << 20, 2000
DELETED, LOWER = 1, 2

_ROWS = "sig long, ref long, extra binary"
_EXTRA = np.dtype([("has_id", "<i8"), ("doc_id", "<i8"), ("n", "<i8"), ("s1", "<i8"), ("s2", "<i8"), ("key", "<i8"), ("slack", "<i8"), ("slack_low", "<i8")])
_FACTS = ("n", "s1", "s2", "key", "slack", "slack_low")
_GROUPED = "kind int, sig long, uid long, flags int, doc_id long, " + ", ".join(f"{c} long" for c in _FACTS) + ", sketch binary"
_PARITY = [f"c{i}" for i in range(CHAIN // 2)]
_FOLDED = [f"k{i}" for i in range(SKETCH // 64)]
_OFFERS = "sig long, cls long, label long, n long, exact boolean, probe boolean, minor boolean, cost long, need long, allow long, " + ", ".join(f"{c} long" for c in (*_PARITY, *_FOLDED))


class Bands:
    """Size bands, and for each the difference bound and the number of segments."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.upper: list[int] = []

    def band(self, n: int) -> int:
        while not self.upper or self.upper[-1] < n:
            low = self.upper[-1] + 1 if self.upper else 1
            self.upper.append(max(low, low * self.den // self.num))
        lo, hi = 0, len(self.upper) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.upper[mid] >= n else (mid + 1, hi)
        return lo

    def bound(self, k: int) -> int:
        """Largest symmetric difference of linked sets whose smaller one is in band k."""
        u = self.upper[k]
        return (self.den - self.num) * (u + u * self.den // self.num) // (self.den + self.num)

    def segments(self, k: int) -> int:
        return self.bound(k) + 1 + self.slack(k)

    def slack(self, k: int) -> int:
        """Segments that a set need not ask for."""
        return 1 + (self.bound(k) + 1) // 8


class Segments:
    """A set cut into the segments of band k, with the signatures of all segments and one-deletion neighbourhoods."""

    def __init__(self, tokens: np.ndarray, values: np.ndarray, k: int, bands: Bands):
        self.m, self.need = bands.segments(k), bands.bound(k) + 1
        seg = (tokens % np.uint64(self.m)).astype(np.int64)
        self.order = np.argsort(seg, kind="stable")
        self.count = np.bincount(seg, minlength=self.m)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.full = np.flatnonzero(self.count)
        sums = np.zeros(self.m, np.uint64)
        sums[self.full] = np.add.reduceat(values[self.order], self.first[self.full])
        salt = mix64(np.arange(self.m, dtype=np.uint64) + np.uint64((k + 1) << 32))
        parts, where = [mix64(sums + salt)], [np.arange(self.m)]
        for s in range(min(DESIGNATED, self.m)):
            own = values[self.order[self.first[s] : self.first[s] + self.count[s]]]
            parts.append(mix64(sums[s] - own + salt[s]))
            where.append(np.full(len(own), s))
        self.sigs = np.concatenate(parts).astype(np.int64)
        self.segment = np.concatenate(where)
        self.deleted = np.arange(len(self.sigs)) >= self.m

    def allocate(self, cost: np.ndarray) -> np.ndarray:
        """Units (0, 1 or 2) of each segment, H + 1 in all, where ``cost`` (per signature) is least. A second unit asks the
        neighbourhoods of a designated segment; it is never cheaper than the first, so it comes with it."""
        some = min(DESIGNATED, self.m)
        second = np.bincount(self.segment[self.m :], cost[self.m :], some)[:some] + cost[:some]
        chosen = np.argsort(np.concatenate([cost[: self.m], second]), kind="stable")[: self.need]
        units = np.zeros(self.m, np.int64)
        np.add.at(units, np.where(chosen < self.m, chosen, chosen - self.m), 1)
        return units

    def chains(self, tokens: np.ndarray, at: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the segments ``at``: parities of the CHAIN segments behind each, and the difference allowed up to each."""
        parity = np.zeros(self.m, np.uint32)
        bit = np.uint32(1) << (tokens >> np.uint64(40)).astype(np.uint32) % np.uint32(32)
        parity[self.full] = np.bitwise_xor.reduceat(bit[self.order], self.first[self.full])
        ring = (at[:, None] + np.arange(CHAIN + 1)) % self.m
        behind = parity[ring[:, 1:]]
        allowed = np.minimum(np.cumsum(units[ring], axis=1)[:, 1:] - 1, 255)
        behind[:, self.m - 1 :], allowed[:, self.m - 1 :] = 0, 255  # the ring is shorter than the chain
        words = np.ascontiguousarray(behind).view("<i8").reshape(len(at), CHAIN // 2)
        return words, np.ascontiguousarray(allowed.astype(np.uint8)).view("<i8").reshape(len(at))


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that hash to each bit; at least as many bits as tokens, a power of two."""
    bits = max(SKETCH, 1 << int(len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(own: bytes) -> np.ndarray:
    """A sketch at its least length."""
    return np.bitwise_xor.reduce(np.frombuffer(own, "<i8").reshape(-1, SKETCH // 64), axis=0)


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference; the longer sketch is folded to the length of the shorter."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def own_bands(n: int, num: int, den: int, bands: Bands) -> list[int]:
    """The bands in which a set of n tokens is indexed: its own, and the one below where a linked set may lie in it."""
    band = bands.band(n)
    return [band] if band == 0 or -(-num * n // den) > bands.upper[band - 1] else [band, band - 1]


def _sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    flat, offsets = utf8(column)
    for a, b in byte_chunks(np.diff(offsets), CHUNK):
        yield from shingle_sets(*word_hashes(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), k)


def _signed(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row = TaskContext.get().partitionId() << 34, 0
        bands, seen = Bands(num, den), set()
        for batch in batches:
            extra = np.zeros(batch.num_rows, _EXTRA)
            sketches = [b""] * batch.num_rows
            sigs, refs = [], []
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_numpy()
            for i, tokens in enumerate(_sets_of(batch.column("text"), k)):
                uid = base + row + i
                n = len(tokens)
                values = mix64(tokens)
                s1, s2 = (values.sum(), mix64(values ^ np.uint64(0x5851F42D4C957F2D)).sum()) if n else (np.uint64(0), np.uint64(0))
                e = extra[i]
                e["has_id"], e["doc_id"] = ids[i] is not None, ids[i] or 0
                e["n"], e["s1"], e["s2"], e["key"] = n, s1.view(np.int64), s2.view(np.int64), keys[i]
                if not n:
                    continue
                sketches[i] = sketch(tokens)
                near = own_bands(n, num, den, bands)
                e["slack"], e["slack_low"] = (bands.slack(b) for b in (near * 2)[:2])
                if (pair := (int(s1), int(s2))) in seen:
                    continue  # an equal set of this task speaks for it
                if len(seen) < 1_000_000:
                    seen.add(pair)
                for low, band in enumerate(near):
                    cut = Segments(tokens, values, band, bands)
                    sigs.append(cut.sigs)
                    refs.append((uid << 2) | cut.deleted | LOWER * low)
            uids = np.arange(base + row, base + row + batch.num_rows)
            row += batch.num_rows
            yield pa.record_batch([pa.array(mix64(uids).view(np.int64)), pa.array(uids << 2), pa.array([x.tobytes() + y for x, y in zip(extra, sketches, strict=True)], pa.binary())], names=["sig", "ref", "extra"])
            if sigs:
                s, r = np.concatenate(sigs), np.concatenate(refs)
                for at in range(0, len(s), 100_000):
                    part = len(s[at : at + 100_000])
                    yield pa.record_batch([pa.array(s[at : at + 100_000]), pa.array(r[at : at + 100_000]), pa.nulls(part, pa.binary())], names=["sig", "ref", "extra"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by sig: document rows pass decoded; signature rows stay where a neighbour has the same sig."""
    carry: tuple[int, int, bool] | None = None  # the last signature row, and whether it has gone out
    names = ["kind", "sig", "uid", "flags", "doc_id", *_FACTS, "sketch"]

    def out(sig: np.ndarray, ref: np.ndarray) -> pa.RecordBatch:
        n = len(sig)
        none = [pa.nulls(n, pa.int64())] * (1 + len(_FACTS))
        return pa.record_batch([pa.array(np.ones(n, np.int32)), pa.array(sig), pa.array(ref >> 2), pa.array((ref & 3).astype(np.int32)), *none, pa.nulls(n, pa.binary())], names=names)

    for batch in batches:
        extra = batch.column("extra")
        is_doc = extra.is_valid().to_numpy(zero_copy_only=False)
        sig, ref = batch.column("sig").to_numpy(), batch.column("ref").to_numpy()
        if is_doc.any():
            raw = extra.filter(pa.array(is_doc)).to_pylist()
            e = np.frombuffer(b"".join(x[: _EXTRA.itemsize] for x in raw), _EXTRA)
            n = len(e)
            rows = [pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(ref[is_doc] >> 2), pa.nulls(n, pa.int32()), pa.array(e["doc_id"].copy(), mask=e["has_id"] == 0)]
            rows += [pa.array(e[c].copy()) for c in _FACTS]
            rows.append(pa.array([x[_EXTRA.itemsize :] for x in raw], pa.binary()))
            yield pa.record_batch(rows, names=names)
        sig, ref = sig[~is_doc], ref[~is_doc]
        if not len(sig):
            continue
        gone = False
        if carry is not None:
            sig, ref, gone = np.concatenate([[carry[0]], sig]), np.concatenate([[carry[1]], ref]), carry[2]
        same = sig[1:] == sig[:-1]
        keep = np.zeros(len(sig), bool)
        keep[1:] |= same
        keep[:-1] |= same
        last = bool(keep[-1])
        if gone:
            keep[0] = False
            last = last or len(sig) == 1
        if keep.any():
            yield out(sig[keep], ref[keep])
        carry = (int(sig[-1]), int(ref[-1]), last)


def _possible(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave room for a link. ``facts`` is (cls, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            apart = np.fromiter(map(sketch_distance, batch.column("sa").to_pylist(), batch.column("sb").to_pylist()), np.int64, batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(apart * (den + num) <= n * (den - num)))

    side = lambda name: facts.select(F.col("cls").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.where(shared * (den + num) >= (F.size("ta") + F.size("tb")) * num).select("a", "b")


def _offers(open_: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """What each class indexes and asks for. ``open_`` has (sig, cls, label, others, minor): the signatures that classes of
    several labels share, how many classes of other labels hold each, and whether the label is not the signature's most
    frequent one; a class's lists are as long as its own set."""
    lists = open_.groupBy("cls").agg(F.first("label").alias("label"), *[F.collect_list(c).alias(n) for c, n in (("sig", "sigs"), ("others", "others"), ("minor", "minors"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            out = []
            cls, label = batch.column("cls").to_numpy(), batch.column("label").to_numpy()
            for i in range(batch.num_rows):
                tokens, sigs, others, minors = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("tokens", "sigs", "others", "minors"))
                tokens = tokens.view(np.uint64)
                values, by_sig, n, whole = mix64(tokens), np.argsort(sigs), len(tokens), folded(sketch(tokens))
                sigs, others, minors = sigs[by_sig], others[by_sig], minors[by_sig]
                for band in own_bands(n, num, den, bands):
                    cut = Segments(tokens, values, band, bands)
                    place = np.minimum(np.searchsorted(sigs, cut.sigs), len(sigs) - 1)
                    held = sigs[place] == cut.sigs
                    cost = np.where(held, others[place], 0)
                    units = cut.allocate(cost)
                    probe = np.where(cut.deleted, 2, 1) <= units[cut.segment]
                    at = np.flatnonzero(held)
                    words, allowed = cut.chains(tokens, cut.segment[at], units)
                    size = len(at)
                    out.append(
                        [cut.sigs[at], np.full(size, cls[i]), np.full(size, label[i]), np.full(size, n), ~cut.deleted[at], probe[at], minors[place[at]], np.full(size, int(cost[probe].sum())), np.full(size, cut.need), allowed]
                        + [words[:, j] for j in range(CHAIN // 2)] + [np.full(size, v) for v in whole]
                    )
            if out:
                whole = pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[f.split()[0] for f in _OFFERS.split(", ")])
                for at in range(0, whole.num_rows, 50_000):
                    yield whole.slice(at, 50_000)

    return lists.join(sets, "cls").select("cls", "label", "sigs", "others", "minors", "tokens").mapInArrow(run, _OFFERS)


def _asked(offers: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of classes of different labels of which one asks for the other and no bound rules them out.

    Two classes of different labels are never both of the most frequent label, so classes of that label ask only those of
    the others: a group is compared with its minority, not with itself."""
    own = ("cls", "label", "n", "exact", "cost", *_PARITY, *_FOLDED)
    x = offers.where("probe").select("sig", F.col("minor").alias("all"), *[F.col(c).alias(f"x_{c}") for c in (*own, "need", "allow")])
    sides = F.when(F.col("minor"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    y = offers.select("sig", F.explode(sides).alias("all"), *[F.col(c).alias(f"y_{c}") for c in own])
    differ = lambda c: F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))
    spent = F.when(F.col("x_exact") & F.col("y_exact"), 0).otherwise(1)
    total = F.col("x_n") + F.col("y_n")
    # the units of a run, scaled from the band's bound to the bound of these two sizes
    most = F.floor(total * (den - num) / (den + num)) + 1
    within = lambda d, step: (d + spent) * F.col("x_need") < (F.shiftright("x_allow", 8 * (step - 1)).bitwiseAND(255) + 1) * most
    chain, so_far = F.lit(True), F.lit(0)
    for i, c in enumerate(_PARITY):
        chain = chain & within(so_far + F.bit_count(differ(c).bitwiseAND(F.lit(0xFFFFFFFF))), 2 * i + 1)
        so_far = so_far + F.bit_count(differ(c))
        chain = chain & within(so_far, 2 * i + 2)
    may = (
        (F.col("x_label") != F.col("y_label")) & (F.col("x_exact") | F.col("y_exact"))
        & ((F.col("x_cost") < F.col("y_cost")) | (F.col("x_cost") == F.col("y_cost")) & (F.col("x_cls") < F.col("y_cls")))
        & (F.least("x_n", "y_n") * den >= F.greatest("x_n", "y_n") * num)
        & (sum((F.bit_count(differ(c)) for c in _FOLDED), F.lit(0)) * (den + num) <= total * (den - num))
    )
    found = x.join(y, (x["sig"] == y["sig"]) & (x["all"] == y["all"]) & may & chain)
    return found.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(cls, label) of every class in ``links`` (a, b): label is the smallest class reachable.

    Each round takes the least label among neighbours and then that label's own label, so chains halve.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("cls").alias("b"), "label"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
        step = labels.join(near, "cls").select("cls", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("cls").alias("to"), F.col("label").alias("far"))
        moved = stored(step.join(jump, "to", "left").select("cls", F.least("to", F.coalesce("far", "to")).alias("label"), "was"), "labels")
        labels = moved.select("cls", "label")
        if moved.where("label <> was").isEmpty():
            return labels


def _between_classes(hits: DataFrame) -> DataFrame:
    """The hits whose signature belongs to several classes, one of them exactly, with one of those as pivot."""
    groups = hits.groupBy("sig").agg(F.count("*").alias("size"), F.min(F.when(F.col("exact"), F.col("cls"))).alias("pivot"))
    return hits.join(groups.where("size > 1 and pivot is not null").select("sig", "pivot"), "sig")


def _classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """member (uid, doc_id, n, key, cls) of all rows; facts (cls, n, sketch); hits (sig, cls, exact, pivot) of the
    signatures that classes share; sets (cls, tokens) of the classes in hits (twice where a row is repeated whole)."""
    spark = tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("key"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = rows.mapInArrow(_signed(k, num, den), _ROWS).repartition(tasks, "sig").sortWithinPartitions("sig")
    with batch_rows(spark, BATCH):
        grouped = stored(signed.mapInArrow(_shared, _GROUPED), "signatures", ("kind",))

    rows = grouped.where("kind = 0").select("uid", "doc_id", *_FACTS, "sketch")
    first = rows.where("n > 0").groupBy("s1", "s2").agg(F.min_by(F.struct("uid", "doc_id", "n", "key", "slack", "slack_low", "sketch"), "uid").alias("f"))
    classes = stored(first.select("s1", "s2", F.col("f.uid").alias("cls"), "f.doc_id", "f.n", "f.key", "f.slack", "f.slack_low", "f.sketch"), "classes")
    member = stored(rows.select("uid", "doc_id", "n", "s1", "s2", "key").join(classes.select("s1", "s2", "cls"), ["s1", "s2"], "left").drop("s1", "s2"), "members")

    deleted, low = F.col("flags").bitwiseAND(DELETED) > 0, F.col("flags").bitwiseAND(LOWER) > 0
    hits = grouped.where("kind = 1").select("sig", "uid", low.alias("low"), (~deleted).alias("exact")).join(member.select("uid", "cls"), "uid")
    hits = stored(_between_classes(hits.groupBy("sig", "cls", "low").agg(F.max("exact").alias("exact"))), "shared-signatures")
    for _ in range(ROUNDS):
        full = hits.groupBy("cls", "low").agg(F.count_if("exact").alias("shared")).join(classes.select("cls", "slack", "slack_low"), "cls")
        full = full.where(F.col("shared") > F.when(F.col("low"), F.col("slack_low")).otherwise(F.col("slack"))).select("cls", "low")
        hits = stored(_between_classes(hits.drop("pivot").join(full, ["cls", "low"], "left_semi")), "shared-signatures")

    wanted = hits.select("cls").distinct().join(classes.select("cls", "doc_id", "key"), "cls")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    found = texts.join(wanted.hint("shuffle_hash"), (texts["key"] == wanted["key"]) & texts["d"].eqNullSafe(wanted["doc_id"])).select("cls", "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets_of(batch.column("text"), k)]
            yield pa.record_batch([batch.column("cls"), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "tokens"])

    sets = stored(found.mapInArrow(tokens, "cls long, tokens array<long>"), "candidate-sets")
    return member, classes.select("cls", "n", "sketch"), hits, sets


def _open(hits: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(sig, cls, label, others, minor) of the signatures whose classes have several labels; without labels each has its own."""
    side = hits.select("sig", "cls")
    if labels is None:
        size = hits.groupBy("sig").agg((F.count("*") - 1).alias("others"), F.min("cls").alias("major"))
        return side.join(size, "sig").select("sig", "cls", F.col("cls").alias("label"), "others", (F.col("cls") != F.col("major")).alias("minor"))
    side = stored(side.join(labels, "cls", "left").select("sig", "cls", F.coalesce("label", "cls").alias("label")), "labelled-signatures")
    own = side.groupBy("sig", "label").agg(F.count("*").alias("own"))
    whole = own.groupBy("sig").agg(F.sum("own").alias("size"), F.count("*").alias("labels"), F.max(F.struct("own", "label")).alias("most")).where("labels > 1").select("sig", "size", F.col("most.label").alias("major"))
    return side.join(own.join(whole, "sig"), ["sig", "label"]).select("sig", "cls", "label", (F.col("size") - F.col("own")).alias("others"), (F.col("label") != F.col("major")).alias("minor"))


def _stages(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, n, key, cls) of all rows, and (cls, label) of the classes that link."""
    member, facts, hits, sets = _classes(docs, k, num, den)
    star = hits.where("cls <> pivot").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    star = stored(_possible(star, facts, num, den), "star")
    links = stored(_linked(star, sets, num, den), "links")
    labels = connected(links)
    offers = stored(_offers(_open(hits, labels), sets, num, den), "offers")
    rest = _possible(_asked(offers, num, den).join(star, ["a", "b"], "left_anti"), facts, num, den)
    more = stored(_linked(rest, sets, num, den), "links")
    if more.isEmpty():
        return member, labels
    return member, connected(links.unionByName(more))


def links(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """All links (a, b), a < b, between classes of equal sets, and (uid, doc_id, cls) of every row; a row without shingles
    has no class."""
    member, facts, hits, sets = _classes(docs, k, num, den)
    offers = stored(_offers(_open(hits, None), sets, num, den), "offers")
    return stored(_linked(_possible(_asked(offers, num, den), facts, num, den), sets, num, den).distinct(), "links"), member.select("uid", "doc_id", "cls")


def components(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, key of every row."""
    member, labels = _stages(docs, k, num, den)
    labelled = member.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "label", "left").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "label", "key")


def representatives(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id; all rows without words stay."""
    found = components(docs, k, num, den)
    stay = found.where("label is null").select("doc_id", "key").unionByName(
        found.where("label is not null").groupBy("label").agg(F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("s")).select("s.doc_id", "s.key")
    )
    stay = stored(stay.distinct(), "representatives")
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_of()).alias("_key"))
    kept = left.join(stay.hint("shuffle_hash"), (left["_key"] == stay["key"]) & left["_id"].eqNullSafe(stay["doc_id"]), "left_semi")
    return kept.select("row.*")


def query(spark, sf_dir):
    """op9: components of all ``documents``."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")

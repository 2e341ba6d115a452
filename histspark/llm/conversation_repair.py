"""Repair of conversation structure by divide and conquer over four-state cost vectors.

A repaired conversation is empty or reads: perhaps one system turn, then user and assistant in turn, ending with the
assistant. Rows are kept, given another role, deleted, and empty turns are inserted, each at a cost; blank and repeated
rows have to go. What stands before a row is one of four states (nothing, system, user, assistant), so a run of rows is
summed up by the cheapest cost from each state to each state, and by the order of the edit texts that reach them.

To find the edits in linear space, a forward vector over the first half and a backward vector over the second half meet in
the middle; of the cheapest crossings the one with the least edit text is taken, and both halves are solved on their own.
Edit texts that reach different states always differ before either ends, so the order of the four texts (not the texts) is
all a forward vector carries.

On Spark the same division is the plan: rows are ranged by conversation and turn, so a conversation of any size is many
pieces; a piece is one byte a row, and its 4 x 4 summary goes where the crossings between pieces are chosen; then every piece
finds its own edits. Only the digest of a whole conversation, a hash of its text from first to last, reads its rows in
order, in constant memory beside one byte a row.

Defined results: a null conv_id is one conversation; null roles, texts and key parts read as one space; rows of equal turn
stand in order of role and text (nulls first among turns); a role that starts with none of s, u, a (or is empty) can only
be changed or deleted; rows repeated whole are duplicates; a conversation that loses all rows is empty; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tune

#: Costs of the edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, system, user, assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
#: Bytes of rows a piece aims at, and what a row counts beside its text.
PIECE, ROW_BYTES = 16 << 20, 32
#: A row's number is its piece and its place there.
_PLACE = 33
FAULTS = ("", "blank", "duplicate", "truncated")
ROLES = ("", "user", "assistant")
_ACTIONS = "KRD"


@lru_cache(maxsize=None)
def moves(cls: int, state: int) -> tuple[tuple[int, int, str, int], ...]:
    """(next state, cost, edits, role) of a row from a state; inserts before a row belong to its edits. A class is the state
    that a role starts with s, u or a stands for (0: none) times four, plus the fault. ``role`` is an index of ROLES where
    the row gets another role."""
    initial, fault = divmod(cls, 4)
    out = []
    for inserts in range(3):
        at = state
        for _ in range(inserts):
            at = ASSISTANT if at == USER else USER
        text, cost = "I" * inserts, INSERT * inserts
        out.append((at, cost + DELETE, text + "D", 0))
        if fault in (1, 2):
            continue
        stay = cost + (TRUNCATED if fault == 3 else 0)
        follows = ASSISTANT if at == USER else USER
        if initial == follows or (initial == SYSTEM and at == START):
            out.append((initial, stay, text + "K", 0))
        out.append((follows, stay + REROLE, text + "R", follows - 1))
    return tuple(out)


Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs, and ranks of the edit texts, by state


def unit(state: int) -> Vector:
    return tuple(0 if s == state else INF for s in range(4)), tuple(0 if s == state else 4 for s in range(4))


@lru_cache(maxsize=1 << 16)
def _stepped(vector: Vector, cls: int) -> Vector:
    costs, ranks = vector
    best: dict[int, tuple] = {}
    for state in range(4):
        if costs[state] >= INF:
            continue
        for to, cost, edits, _ in moves(cls, state):
            key = (costs[state] + cost, ranks[state], edits)
            if to not in best or key < best[to]:
                best[to] = key
    order = sorted(best, key=lambda s: best[s][1:])
    return tuple(best[s][0] if s in best else INF for s in range(4)), tuple(order.index(s) if s in best else 4 for s in range(4))


@lru_cache(maxsize=1 << 16)
def _back(costs: tuple[int, ...], cls: int) -> tuple[int, ...]:
    return tuple(min((cost + costs[to] for to, cost, _, _ in moves(cls, state) if costs[to] < INF), default=INF) for state in range(4))


def _shifted(costs: tuple[int, ...], by: int) -> tuple[int, ...]:
    return tuple(c + by if c < INF else INF for c in costs)


def forward(codes: bytes, vector: Vector) -> Vector:
    """The vector behind a run of rows."""
    base = 0
    for cls in codes:
        costs, ranks = _stepped(vector, cls)
        low = min(costs)
        base += low
        vector = _shifted(costs, -low), ranks
    return _shifted(vector[0], base), vector[1]


def backward(codes: bytes, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest cost from each state before a run of rows to its end, given the costs at the end."""
    base = 0
    for cls in reversed(codes):
        costs = _back(costs, cls)
        low = min(costs)
        base += low
        costs = _shifted(costs, -low)
    return _shifted(costs, base)


def ending(state: int) -> tuple[int, str]:
    """Cost and edits that make a conversation end behind ``state``."""
    return {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}[state]


FINAL = tuple(ending(s)[0] for s in range(4))


def crossing(vector: Vector, rest: tuple[int, ...]) -> int:
    """The state of a cheapest crossing, the one with the least edits before it."""
    costs, ranks = vector
    return min((s for s in range(4) if costs[s] < INF and rest[s] < INF), key=lambda s: (costs[s] + rest[s], ranks[s]))


def edits(codes: bytes, state: int, rest: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """(inserts, action, new role) of every row of a run from ``state`` to an end that costs ``rest``: halves meet in the
    middle."""
    out: list[tuple[int, str, int]] = []
    todo = [(0, len(codes), state, rest)]
    while todo:
        lo, hi, at, goal = todo.pop()
        if hi - lo == 1:
            to, _, text, role = min((m for m in moves(codes[lo], at) if goal[m[0]] < INF), key=lambda m: (m[1] + goal[m[0]], m[2]))
            out.append((len(text) - 1, text[-1], role))
        elif hi > lo:
            mid = (lo + hi) // 2
            cross = crossing(forward(codes[lo:mid], unit(at)), backward(codes[mid:hi], goal))
            todo.append((mid, hi, cross, goal))
            todo.append((lo, mid, at, tuple(0 if s == cross else INF for s in range(4))))
    return out


def summary(codes: bytes) -> list[Vector]:
    """The vector behind a run from each state."""
    return [forward(codes, unit(s)) for s in range(4)]


def joined(vector: Vector, piece: list[Vector]) -> Vector:
    """The vector behind a vector and a summed-up piece."""
    costs, ranks = vector
    best: dict[int, tuple] = {}
    for state in range(4):
        if costs[state] >= INF:
            continue
        for to in range(4):
            if piece[state][0][to] >= INF:
                continue
            key = (costs[state] + piece[state][0][to], ranks[state], piece[state][1][to])
            if to not in best or key < best[to]:
                best[to] = key
    order = sorted(best, key=lambda s: best[s][1:])
    return tuple(best[s][0] if s in best else INF for s in range(4)), tuple(order.index(s) if s in best else 4 for s in range(4))


def crossings(pieces: list[list[Vector]]) -> list[tuple[int, tuple[int, ...]]]:
    """(state before, costs behind) of every piece of a conversation: forward vectors meet backward ones between pieces."""
    rest = [FINAL]
    for piece in reversed(pieces):
        rest.append(tuple(min((piece[s][0][t] + rest[-1][t] for t in range(4) if piece[s][0][t] < INF and rest[-1][t] < INF), default=INF) for s in range(4)))
    rest.reverse()
    vectors = [unit(START)]
    for piece in pieces:
        vectors.append(joined(vectors[-1], piece))
    out, at = [], START
    for i, piece in enumerate(pieces):
        last = i == len(pieces) - 1
        to = crossing(joined(unit(at), piece), rest[i + 1])
        out.append((at, rest[i + 1] if last else tuple(0 if s == to else INF for s in range(4))))
        at = to
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults of the benchmark put in, by a checksum of conversation and turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("_harm")).where("_harm > 0")
    text = F.when(F.col("_harm") == 1, "").when(F.col("_harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hurt = rows.select("conv_id", "turn", F.when(F.col("_harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_harm") == 3, 2).otherwise(1).alias("_n"))
    return hurt.withColumn("_again", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n", "_again")


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``pos``, codes): rows ranged by conversation and turn into pieces, ``pos`` being their order, and the class
    of each by (conv_id, pos).

    The first of equal (role, text) in a conversation is found by an aggregation on their hashes, so a turn that a
    conversation repeats very often is combined where it is read, and the join back can be split.
    """
    spark = rows.sparkSession
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    size = turns.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // PIECE + 1)
    order = ["conv_id", "turn", "role", "text", "_tie"]
    ranged = turns.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.drop("_tie").withColumn("pos", F.monotonically_increasing_id()), "turns")
    name = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    slim = ranged.select(
        "conv_id", "role", *name, "pos", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("solid"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("closed"), F.substring("role", 1, 1).alias("initial")
    )
    again = slim.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = slim.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    fault = F.when(~F.col("solid"), 1).when(F.col("first") < F.col("pos"), 2).when(~F.col("closed"), 3).otherwise(0)
    code = F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 3).otherwise(0) * 4 + fault
    return ranged, marked.select("conv_id", "pos", code.cast("int").alias("code"))


_PIECE = "conv_id long, piece long, codes binary, summary binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [bytes(x) for x in batch.column("codes").to_pylist()]
        sums = [np.array([v for c in codes_summary for half in c for v in half], "<i8").tobytes() for codes_summary in map(summary, codes)]
        yield pa.record_batch([batch.column("conv_id"), batch.column("piece"), pa.array(codes, pa.binary()), pa.array(sums, pa.binary())], names=["conv_id", "piece", "codes", "summary"])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, pieces in zip(batch.column("conv_id").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            sums = [np.frombuffer(p["summary"], "<i8").reshape(4, 2, 4).tolist() for p in pieces]
            at = crossings([[(tuple(c), tuple(r)) for c, r in s] for s in sums])
            out += [(conv, p["piece"], a, list(rest)) for p, (a, rest) in zip(pieces, at, strict=True)]
        columns = zip(*out, strict=True) if out else ([],) * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["conv_id", "piece", "at", "rest"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte a row: action, new role, inserts before it, fault."""
    for batch in batches:
        steps = []
        for codes, at, rest in zip(*(batch.column(c).to_pylist() for c in ("codes", "at", "rest")), strict=True):
            done = edits(codes, at, tuple(rest))
            steps.append(bytes(_ACTIONS.index(a) | role << 2 | n << 4 | (c & 3) << 6 for (n, a, role), c in zip(done, codes, strict=True)))
        yield pa.record_batch([batch.column("conv_id"), batch.column("piece"), pa.array(steps, pa.binary())], names=["conv_id", "piece", "steps"])


def planned(codes: DataFrame) -> DataFrame:
    """(conv_id, piece, steps): the cheapest edits of every piece of every conversation, from (conv_id, pos, code)."""
    packed = codes.groupBy("conv_id", F.shiftright("pos", _PLACE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"))
    pieces = stored(packed.select(F.col("conv_id").cast("long").alias("conv_id"), "piece", F.transform("c", lambda x: x["code"]).alias("codes")).mapInArrow(_summed, _PIECE), "pieces")
    by_conv = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "summary"))).alias("pieces"))
    at = by_conv.mapInArrow(_crossed, "conv_id long, piece long, at int, rest array<long>")
    both = pieces.join(at.withColumnsRenamed({"conv_id": "_c", "piece": "_p"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p")))
    return both.select("conv_id", "piece", "codes", "at", "rest").mapInArrow(_solved, "conv_id long, piece long, steps binary")


class Reading:
    """One conversation read from first to last: edits come first, then the rows."""

    def __init__(self, conv):
        self.conv, self.steps, self.next, self.state = conv, bytearray(), 0, START
        self.counts, self.illegal, self.cost = [0, 0, 0, 0], 0, 0
        self.turns, self.low, self.high, self.last_turn, self.initial = 0, None, None, None, None
        self.audit = bytearray()

    def _insert(self, n: int) -> list[tuple]:
        out = []
        for _ in range(n):
            self.state = ASSISTANT if self.state == USER else USER
            out.append(("I", None, ROLES[self.state - 1], ""))
        self.audit += b"I" * n
        self.cost += INSERT * n
        return out

    def row(self, turn, role: str, text: str) -> list[tuple]:
        """(edit, turn, role, text) of what stands in the repaired conversation for a row."""
        step = self.steps[self.next]
        self.next += 1
        action, new, fault = _ACTIONS[step & 3], ROLES[step >> 2 & 3], step >> 6
        self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
        out = self._insert(step >> 4 & 3)
        self.audit += action.encode()
        if action == "D":
            self.cost += DELETE
            return out
        self.cost += (REROLE if action == "R" else 0) + (TRUNCATED if fault == 3 else 0)
        role = new or role
        self.state = "sua".index(role[0]) + 1
        return [*out, (action, turn, role, text)]

    def end(self) -> list[tuple]:
        return self._insert(len(ending(self.state)[1]))


_READ = "conv_id long, side int, pos long, steps binary, turn long, role string, text string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Reading, list[tuple], bool]]:
    """(reading, turns of the repaired conversation, whether it ended) row after row."""
    now = None
    for batch in batches:
        for conv, side, steps, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "side", "steps", "turn", "role", "text")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now, now.end(), True
                now = Reading(conv)
            if side == 1:
                now.steps += steps
            elif side == 2:
                yield now, now.row(turn, role, text), False
    if now is not None:
        yield now, now.end(), True


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_turns long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, rows = [c.split()[0] for c in _DIGEST.split(", ")], []
    types = [pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in names]

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    whole, n = hashlib.sha256(), 0
    for reading, turns, over in _read(batches):
        for _, _, role, text in turns:
            whole.update(("\n" if n else "").encode() + f"{role}:{text}".encode())
            n += 1
        if over:
            gaps = reading.high - reading.low + 1 - reading.turns if reading.turns else 0
            rows.append((reading.conv, gaps, *reading.counts[1:], reading.illegal, reading.cost, reading.audit.decode(), whole.hexdigest(), n))
            whole, n = hashlib.sha256(), 0
            if len(rows) == 1000:
                yield out()
                rows.clear()
    if rows:
        yield out()


_TURNS = "conv_id long, place long, edit string, turn long, role string, text string"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, rows, conv, place, size = [c.split()[0] for c in _TURNS.split(", ")], [], None, 0, 0
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for reading, turns, over in _read(batches):
        for edit, turn, role, text in turns:
            rows.append((reading.conv, place, edit, turn, role, text))
            place, size = place + 1, size + len(text)
        if over:
            place = 0
        if len(rows) >= 1000 or size > PIECE:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _in_order(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Edits, then rows, of each conversation, in one partition and in order."""
    tune(rows.sparkSession)
    ranged, codes = placed(rows)
    none = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _READ.split(", ")) if c in names]
    parts = planned(codes).select("conv_id", F.lit(1).alias("side"), F.shiftleft("piece", _PLACE).alias("pos"), "steps", *none("turn", "role", "text"))
    parts = parts.unionByName(ranged.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(2).alias("side"), "pos", *none("steps"), "turn", "role", "text"))
    if ids is not None:
        parts = parts.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.lit(0).alias("side"), *none("pos", "steps", "turn", "role", "text")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "side", "pos")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K kept, R another role, I inserted), turn, role, text of every turn of every conversation that
    has any after repair."""
    return _in_order(rows, None).mapInArrow(_turns, _TURNS)


def digests(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conv_id of ``ids``: gaps, faults, cost, audit and the hash of the repaired conversation."""
    return _in_order(rows, ids).mapInArrow(_digests, _DIGEST)


def query(spark, sf_dir):
    """op11: all ``conversations``, damaged and repaired."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digests(damaged(table), table)

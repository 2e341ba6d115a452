"""Change lists that compose: a run of changes becomes one list, so a long history folds in parallel.

Serially a state needs all events before it. But two change lists merge into one that does the same as both, and merging is
associative: runs of events merge on their own, runs of runs again, until one fold per entity is short. Going down again,
every run gets the state it starts from, and all runs are replayed side by side. No task sees more than one run of an
entity, however many events the entity has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histspark.functions import jsonvalue as J
from histspark.operators.asof import state_history
from histspark.operators.fold import sorted_fold
from histspark.schemas import CHANGES, KEY
from histspark.sources.tables import stored

#: Events of a run, and runs of a run of runs.
RUN = 1000


class _Known:
    """A value that is known whole; ``absent`` says that the base had none, ``old`` what it had."""

    def __init__(self, value, absent: bool = False, old: str | None = None):
        self.value, self.absent, self.old = value, absent, old


class _Gone:
    def __init__(self, old: str | None):
        self.old = old


class Patch:
    """What a run of changes does to an unknown value: what becomes of its keys, then changes that have to keep their order
    (those through array places, which move, and all behind them)."""

    def __init__(self):
        self.keys: dict[str, object] = {}
        self.then: list[dict] = []
        self._last: dict[str, int] = {}
        self._above: set[str] = set()

    def keep_order(self, change: dict) -> None:
        """Append a change; one that changes the same place as an earlier one, with nothing between that could move or hold
        it, takes that one's place."""
        path = change["path"]
        ends = [i for i, ch in enumerate(path) if ch in ".["]
        above = {path[:i] for i in ends}
        if change["op"] != "change" or path in self._above or not above.isdisjoint(self._last):
            self._last, self._above = {}, set()
        elif path in self._last:
            self.then[self._last[path]] = {**change, "old": self.then[self._last[path]]["old"]}
            return
        self.then.append(dict(change))
        if change["op"] == "change":
            self._last[path] = len(self.then) - 1
            self._above |= above


class Merge:
    """Changes merged so far, from the start of a run."""

    def __init__(self):
        self.root: Patch | _Known = Patch()

    def add(self, changes: list[dict] | None) -> None:
        for c in changes or []:
            self._one(c)

    def _one(self, c: dict) -> None:
        steps = J.segments(c["path"])
        if not steps:
            if c["op"] != "change":
                raise J.ApplyError("type_mismatch", c["path"])
            self.root = _Known(J.loads(c["new"]), old=c["old"] if isinstance(self.root, Patch) and not self.root.keys and not self.root.then else None)
            return
        node = self.root
        for i, step in enumerate(steps):
            if isinstance(node, _Known):
                J.change_in(node.value, steps[i:], c)
                return
            if node.then or step[0] != "key":
                node.keep_order(c)
                return
            name, held = step[1], node.keys.get(step[1])
            if i == len(steps) - 1:
                self._set(node, name, held, c)
                return
            if isinstance(held, _Gone):
                raise J.ApplyError("path_not_found", c["path"])
            if held is None:
                held = node.keys[name] = Patch()
            node = held

    @staticmethod
    def _set(node: Patch, name: str, held, c: dict) -> None:
        absent = held.absent if isinstance(held, _Known) else held is None and c["op"] == "add"
        old = held.old if isinstance(held, (_Known, _Gone)) else c["old"] if held is None else None
        if c["op"] != "remove":
            node.keys[name] = _Known(J.loads(c["new"]), absent, old)
        elif isinstance(held, _Gone):
            raise J.ApplyError("path_not_found", c["path"])
        elif absent:
            del node.keys[name]
        else:
            node.keys[name] = _Gone(old)

    def changes(self) -> list[dict]:
        """One change list that does the same."""
        out: list[dict] = []
        todo: list[tuple[str, object]] = [("", self.root)]
        while todo:
            path, node = todo.pop()
            if isinstance(node, dict):
                out.append(node)
            elif isinstance(node, _Known):
                out.append({"path": path, "op": "add" if node.absent else "change", "old": None if node.absent else node.old, "new": J.dumps(node.value)})
            elif isinstance(node, _Gone):
                out.append({"path": path, "op": "remove", "old": node.old, "new": None})
            else:
                todo += [("", c) for c in reversed(node.then)]
                todo += [(f"{path}.{k}" if path else k, v) for k, v in sorted(node.keys.items(), reverse=True)]
        return out


def merged(*lists: list[dict] | None) -> list[dict]:
    """One change list that does what the lists do one after another. Raises ApplyError where no document allows them."""
    merge = Merge()
    for changes in lists:
        merge.add(changes)
    return merge.changes()


_RESET = {"path": "", "op": "change", "old": None, "new": "{}"}
_EFFECT = f"tenant string, collection string, entity_id string, segment long, version long, ts timestamp, deleted boolean, work {CHANGES}, shown {CHANGES}"


class _Run:
    """The effect of a run: on the document that changes work on and, behind a delete, on the one that is shown."""

    def __init__(self):
        self.work, self.shown, self.row = Merge(), None, None


def _event(run: _Run, row: dict) -> list[dict]:
    run.row = row
    if row["op"] == "delete":
        run.shown = run.work.changes()
        run.work = Merge()
        run.work.add([_RESET])
    else:
        run.work.add(row["changes"])
        run.shown = None
    return []


def _effect(run: _Run, row: dict) -> list[dict]:
    run.row = row
    run.shown = None if row["shown"] is None else [*run.work.changes(), *row["shown"]]
    run.work.add(row["work"])
    return []


def _finished(run: _Run) -> list[dict]:
    row = run.row
    ts = row["ts_received"] if "ts_received" in row else row["ts"]
    shown = None if run.shown is None else merged(run.shown)
    return [{**{k: row[k] for k in KEY}, "segment": row["_run"], "version": row["version"], "ts": ts, "deleted": shown is not None, "work": run.work.changes(), "shown": shown}]


def run_effects(events: DataFrame, run: int = RUN) -> DataFrame:
    """The effect of every run of ``run`` versions: key, segment, last version and time, deleted, ``work`` (the changes to
    the live document) and ``shown`` (behind a delete, the changes that lead to the value kept)."""
    rows = events.select(*KEY, "version", "ts_received", "op", "changes", F.floor((F.col("version") - 1) / run).cast("long").alias("_run"))
    return sorted_fold(rows, [*KEY, "_run"], ["version"], _Run, _event, _EFFECT, _finished)


def _joined(effects: DataFrame, run: int) -> DataFrame:
    """Effects of runs of runs."""
    rows = effects.withColumn("_run", F.floor(F.col("segment") / run).cast("long"))
    return sorted_fold(rows, [*KEY, "_run"], ["segment"], _Run, _effect, _EFFECT, _finished)


_START = "tenant string, collection string, entity_id string, segment long, version long, ts timestamp, deleted boolean, state string"


class _Doc:
    def __init__(self):
        self.work = {}


def _start(doc: _Doc, row: dict) -> list[dict]:
    """The state behind every run; an opening row (side 0) has the state the first of them starts from."""
    if row["_side"] == 0:
        doc.work = {} if row["deleted"] else J.loads(row["state"])
        return []
    shown = None if row["shown"] is None else J.apply(doc.work, row["shown"])
    doc.work = J.apply(doc.work, row["work"], fresh=False)
    state = J.dumps(doc.work if shown is None else shown)
    return [{**{k: row[k] for k in (*KEY, "segment", "version", "ts", "deleted")}, "state": state}]


def _states(effects: DataFrame, above: DataFrame | None, run: int) -> DataFrame:
    """The state behind every run, from its effect and the states behind the runs of runs (None: one for each entity)."""
    rows = effects.select(*KEY, "segment", "version", "ts", "deleted", "work", "shown", F.lit(None).cast("string").alias("state"), F.lit(1).alias("_side"))
    group = F.lit(0).cast("long")
    if above is not None:
        blank = [F.lit(None).cast(CHANGES).alias(c) for c in ("work", "shown")]
        rows = rows.unionByName(above.select(*KEY, ((F.col("segment") + 1) * run).alias("segment"), "version", "ts", "deleted", *blank, "state", F.lit(0).alias("_side")))
        group = F.floor(F.col("segment") / run).cast("long")
    return sorted_fold(rows.withColumn("_group", group), [*KEY, "_group"], ["segment", "_side"], _Doc, _start, _START)


def run_snapshots(events: DataFrame, run: int = RUN) -> DataFrame:
    """Snapshot rows (key, version, ts, deleted, state) at every ``run``-th version, made from events alone and without a
    serial fold: effects of runs are merged upwards until every entity has one run, states go down again."""
    levels = [stored(run_effects(events, run), "run-effects")]
    while (levels[-1].agg(F.max("segment")).first()[0] or 0) >= run:
        levels.append(stored(_joined(levels[-1], run), "run-effects"))
    states = None
    for effects in reversed(levels):
        states = _states(effects, states, run)
    return states.where(F.col("version") % run == 0).select(*KEY, "version", "ts", "deleted", "state")


def parallel_history(events: DataFrame, run: int = RUN) -> DataFrame:
    """``state_history`` where one entity may have any share of the events: every run is replayed on its own."""
    return state_history(events, run_snapshots(events, run), run)

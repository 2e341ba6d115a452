"""What one task holds and how often the log is read, as the input grows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from histspark.operators import asof, flows, ingest, lifecycle
from histspark.plans import driver, registry
from histspark.schemas import KEY

from .conftest import SMALL
from .test_reads import commands

ROWS = [(e, kind, f'{{"d":{{"n":{i}}}}}' if kind == "state" else None) for i in range(6) for e in ("a", "b") for kind in (("state", "state", "delete") if i == 3 else ("state",))]


def counted(spark, rows):
    """The rows, and how often one of them was read."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    return rows.mapInArrow(count, rows.schema), reads


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_window_form_keeps_the_number_of_partitions_that_is_set(spark):
    """small tables are not put into one task either, so a task's part does not grow with the input."""
    out = ingest.ingest_states(commands(spark, ROWS))
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_retention_without_counted_versions_sorts_nothing(spark):
    """F1."""
    e = spark.createDataFrame([("t", "c", "e", v, datetime(2024, 1, v)) for v in range(1, 6)], "tenant string, collection string, entity_id string, version long, ts_received timestamp")
    for type_, value, kept in (("forever", None, 5), ("versions", 0, 5), ("versions", None, 5), ("days", 2, 3), ("versions", 2, 2)):
        cfg = spark.createDataFrame([("c", type_, value)], "name string, retention_type string, retention_value int")
        parts = lifecycle.apply_retention(e, cfg, datetime(2024, 1, 5))
        assert [p.count() for p in parts] == [kept, 5 - kept]
        assert ("Window" in plan(parts[0])) == (type_ == "versions" and value == 2)


def test_reads_of_leaves_and_between_read_the_log_once(spark):
    """the log may be costly to make."""
    e = ingest.ingest_states(commands(spark, ROWS)).where("code is null").select(*KEY, "version", "ts_received", "op", "changes").localCheckpoint()
    n = e.count()
    for read, rows in ((lambda x: asof.leaves_at(x, datetime(2025, 1, 1)), 2), (lambda x: asof.state_between(x, datetime(2023, 1, 1), datetime(2025, 1, 1)), 2)):
        log, reads = counted(spark, e)
        assert len(read(log).collect()) == rows
        assert reads.value == n


@pytest.mark.parametrize("lists, legal", [([["a"], ["b.c"], []], True), ([["a"], ["a.b"]], False), ([["a.b"], ["a.b.c"]], False), ([["a[0]"]], False), ([["1.a"]], False), ([[]], True)])
def test_flat_legal_in_one_pass(spark, lists, legal):
    """an entity without any change is legal too."""
    rows = [("t", "c", "e", i, [(p, "add", None, "1") for p in paths]) for i, paths in enumerate(lists)]
    e = spark.createDataFrame(rows, "tenant string, collection string, entity_id string, version long, changes array<struct<path:string,op:string,old:string,new:string>>")
    log, reads = counted(spark, e)
    assert [r["legal"] for r in asof.flat_legal(log).collect()] == [legal]
    assert reads.value == len(rows)


def test_the_fold_is_sent_only_what_it_reads(spark):
    """F14, F16."""
    cmds = commands(spark, ROWS).withColumn("flow", F.struct(F.lit("f").alias("id"))).withColumn("_other", F.lit("x"))
    sent = plan(ingest.ingest(cmds)).split("MapInArrow")[1].split("Sort")[0]
    assert "_other" not in sent and "flow#" not in sent
    assert ingest.ingest(cmds).where("code is null").count() == len(ROWS) - 2  # one state of each comes twice


def test_a_streams_parts_are_sets_of_files(spark, monkeypatch):
    """a micro-batch is a set of files, and versions are those of the batch."""
    monkeypatch.setattr(registry, "_FILE_ROWS", 60)
    rows = driver.table(spark, SMALL, "events")
    seen, folders, folder = [], [], registry._folder
    monkeypatch.setattr(registry, "_folder", lambda s, name: folders.append(folder(s, name)) or folders[-1])
    q = registry._by_time(spark, SMALL).writeStream.foreachBatch(lambda b, i: seen.append((b.count(), *b.agg(F.min("ts_received"), F.max("ts_received")).first())))
    q.option("checkpointLocation", registry._folder(spark, "check")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(s[0] for s in seen) == rows.count()
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))  # noqa: B905
    files = len(spark.read.parquet(folders[0]).inputFiles())
    assert files > 4 and files % 4 == 0


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(20)],  # a chain
    [(i, (i + 1) % 7) for i in range(7)] + [(10, 3), (11, 10)] + [(i, i + 1) for i in range(20, 33)],  # a ring with a tail, and a chain
    [(i, (i + 1) % 5) for i in range(5)] + [(9, 9)],  # a ring, and a node that is its own cause
    [(i, i + 1) for i in range(9)] + [(0, 4), (2, 7)],  # two causes
])
def test_closure_of_chains_rings_and_forks(spark, edges):
    """one cause a node takes the short way, a cycle and a second cause the whole one."""
    want = {}
    for start in {a for a, _ in edges}:
        level, n = {start}, 0
        while level:
            n, level = n + 1, {b for a, b in edges if a in level}
            level = {b for b in level if (start, b) not in want}
            want |= {(start, b): n for b in level}
    e = spark.createDataFrame([("t", str(a), str(b)) for a, b in edges], "tenant string, child string, cause string")
    got = flows.flow_closure(e).collect()
    assert len(got) == len(want) and {(int(r["node"]), int(r["ancestor"])): r["distance"] for r in got} == want
    assert all(r["cycle"] == (r["node"] == r["ancestor"]) for r in got)


def test_closure_of_chains_groups_no_pairs(spark, monkeypatch):
    """the pairs are neither grouped nor compared with the known ones, which shuffles them twice more."""
    monkeypatch.setattr(type(spark.range(1)), "join", lambda a, b, on=None, how=None, join=type(spark.range(1)).join: pytest.fail("compared") if how == "left_anti" else join(a, b, on, how))
    e = spark.createDataFrame([("t", str(i), str(i + 1)) for i in range(9)], "tenant string, child string, cause string")
    assert flows.flow_closure(e).count() == 45

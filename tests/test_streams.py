"""Streams with keyed state, the index of stored ids, and the checks of the sink, over several micro-batches."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from histspark.operators import chain, ingest
from histspark.operators.plugins import Registry
from histspark.schemas import KEY
from histspark.sources import ids
from histspark.streaming import stateful, stream

from .test_reads import T0, commands, history


def streamed(spark, batches, path):
    """A file stream of frames, one file and micro-batch each."""
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(rows, path):
    """Rows of every micro-batch with its number."""
    spark = rows.sparkSession

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    with stateful.rocksdb(spark):
        q = rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start()
        done = q.awaitTermination(120)
        q.stop()
    assert done
    return spark.read.parquet(path + "/out")


@pytest.fixture(scope="module")
def mixed(spark):
    import random

    rng = random.Random(21)
    rows = [r for e in range(3) for r in history(rng, str(e), 12)] + [("1", "state", "{bad"), ("2", "state", "1"), ("2", "state", None)]
    rng.shuffle(rows)
    return commands(spark, rows).withColumn("flow", F.lit(None).cast("struct<id:string,caused_by:array<struct<activity_id:string,collection:string,entity_id:string,version:bigint,event_id:string>>,step:string>")).cache()


def test_keyed_ingest_is_the_batch_form(spark, mixed, tmp_path):
    parts = [mixed.where(F.col("seq").between(a, a + 12)) for a in (0, 13, 26)]
    got = collected(stateful.keyed_ingest(streamed(spark, parts, str(tmp_path / "in"))), str(tmp_path / "s"))
    names = ["entity_id", "seq", "version", "op", "state", "deleted", "code"]
    pick = lambda df: sorted(map(str, df.select(*names, F.when(F.col("code").isNull(), F.col("changes").cast("string")).alias("c")).collect()))
    want = ingest.ingest(mixed)
    assert pick(got) == pick(want) and got.select("batch").distinct().count() == 3
    good = want.where("code is null").join(mixed.select("seq", "flow"), "seq")
    links = {(r["entity_id"], r["version"]): (r["hash"], r["prev_hash"]) for r in chain.build_chain(good).collect()}
    assert {(r["entity_id"], r["version"]): (r["hash"], r["prev_hash"]) for r in got.where("code is null").collect()} == links


def test_keyed_ingest_goes_on_from_stored_entities(spark, mixed, tmp_path):
    first = ingest.ingest(mixed.where("seq < 20")).where("code is null").join(mixed.select("seq", "flow"), "seq")
    tips = chain.build_chain(first)
    held = ingest.build_current(first).join(tips.select(*KEY, "version", "hash"), [*KEY, "version"])
    rest = collected(stateful.keyed_ingest(streamed(spark, [mixed.where("seq >= 20")], str(tmp_path / "in")), held), str(tmp_path / "s"))
    want = {(r["entity_id"], r["version"]): r["op"] for r in ingest.ingest(mixed).where("code is null and seq >= 20").collect()}
    assert {(r["entity_id"], r["version"]): r["op"] for r in rest.where("code is null").collect()} == want
    whole = ingest.ingest(mixed).where("code is null").join(mixed.select("seq", "flow"), "seq")
    links = {(r["entity_id"], r["version"]): r["hash"] for r in chain.build_chain(whole).collect()}
    assert all(r["hash"] == links[r["entity_id"], r["version"]] for r in rest.where("code is null").collect())


def test_tickets_expire(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    log = lambda *rows: spark.createDataFrame(rows, "ticket_id string, status string, at timestamp")
    batches = [log(("a", "accepted", at(0)), ("b", "processing", at(1)), ("a", "nonsense", at(1)), (None, "accepted", at(1))), log(("b", "failed", at(3)), ("b", "stored", at(2)), ("c", "accepted", at(60))), log(("d", "accepted", at(61))), log(("a", "processing", at(62)), ("c", "processing", at(61)))]
    out = collected(stateful.stream_tickets(streamed(spark, batches, str(tmp_path / "in"))), str(tmp_path / "s")).collect()
    last = {}
    for r in sorted(out, key=lambda r: r["batch"]):
        last[r["ticket_id"]] = (r["status"], r["entries"])
    # the earlier of two ends counts; the first entry of a was forgotten, that of c was not
    assert last == {"a": ("processing", 1), "b": ("stored", 3), "c": ("processing", 2), "d": ("accepted", 1), None: ("accepted", 1)}


def test_reorder_releases_by_window_and_timer(spark, tmp_path):
    row = lambda e, seq, arrived, source: ("t", "app.x", e, seq, T0 + timedelta(minutes=arrived), None if source is None else T0 + timedelta(minutes=source))
    frame = lambda *rows: spark.createDataFrame(rows, "tenant string, collection string, entity_id string, seq long, ts_received timestamp, ts_source timestamp")
    batches = [frame(row("a", 1, 0, 0), row("a", 2, 1, 9), row("a", 3, 2, 5), row("b", 4, 2, 2)), frame(row("a", 5, 11, 30), row("a", 6, 12, 4), row("b", 7, 12, None)), frame(row("z", 9, 10_000, 10_000))]
    out = collected(stateful.stream_reorder(streamed(spark, batches, str(tmp_path / "in")), "10 minutes", "60 minutes"), str(tmp_path / "s"))
    got = {r["seq"]: (r["late"], r["place"]) for r in out.collect()}
    assert {s: got[s] for s in (1, 2, 3, 4, 5, 6, 7)} == {1: (False, 1), 3: (False, 2), 2: (False, 3), 5: (False, 4), 6: (True, None), 7: (False, 1), 4: (False, 2)}
    rows, late = stream.reorder(batches[0].unionByName(batches[1]).where("entity_id = 'a'"), "10 minutes")
    assert {r["seq"]: r["place"] for r in rows.collect()} == {s: got[s][1] for s in (1, 2, 3, 5)} and [r["seq"] for r in late.collect()] == [6]


def test_stored_ids_are_found_exactly(spark, tmp_path):
    frame = lambda lo, hi: spark.range(lo, hi).select(F.lit("t").alias("tenant"), F.lit("app.x").alias("collection"), F.concat(F.lit("e"), "id").alias("event_id"))
    path = str(tmp_path)
    assert ids.known_ids(frame(0, 10), path, 0).isEmpty()
    ids.add_ids(frame(0, 500).unionByName(frame(0, 5)), path, 0)
    ids.add_ids(frame(500, 600).withColumn("event_id", F.when(F.col("event_id") != "e550", F.col("event_id"))), path, 1)
    asked = frame(400, 700).unionByName(frame(3, 4).withColumn("tenant", F.lit("u")))
    assert {r["event_id"] for r in ids.known_ids(asked, path, 2).collect()} == {f"e{i}" for i in range(400, 600)} - {"e550"}
    assert {r["event_id"] for r in ids.known_ids(asked, path, 1).collect()} == {f"e{i}" for i in range(400, 500)}  # a replay does not meet its own
    maybe = ids.maybe_stored(frame(1000, 4000), ids.filters(spark, path, 2))
    assert maybe.count() < 60
    ids.add_ids(frame(0, 0), path, 2)
    assert ids.known_ids(frame(7, 8), path, 3).count() == 1


def test_sink_runs_the_whole_write_path(spark, mixed, tmp_path):
    reg = Registry()
    reg.pre_store("no2", lambda df: df.withColumn("reject", F.when(F.col("entity_id") == "2", "not_two")))
    cfg = spark.createDataFrame([("app.x", "update", None, 3, 60)], "name string, first_event_op string, array_keys map<string,string>, snapshot_interval int, max_event_size_bytes long")
    more = mixed.limit(1).withColumns({"collection": F.lit("app.other"), "seq": F.lit(900).cast("long")})
    parts = [mixed.where("seq < 15").unionByName(more), mixed.where("seq >= 15").unionByName(mixed.where("seq in (1, 2)"))]
    path = str(tmp_path / "s")
    q = stream.run_stream(streamed(spark, parts, str(tmp_path / "in")), path, path + "/checkpoint", config=cfg, ids=True, plugins=reg, enabled={"app.x": ["no2"]})
    assert q.awaitTermination(120)
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    assert {r["seq"] for r in read("duplicates").collect()} == {1, 2}
    codes = {r["seq"]: r["code"] for r in read("rejects").collect()}
    sizes = {r["seq"]: r["n"] for r in mixed.select("seq", F.octet_length("state").alias("n")).collect()}
    assert codes[900] == "collection_not_found" and {s for s, c in codes.items() if c == "too_large"} == {s for s, n in sizes.items() if n and n > 60}
    assert {"invalid_payload", "not_two"} <= set(codes.values())
    events = read("events")
    assert "2" not in {r["entity_id"] for r in events.collect()} and events.where("version = 1 and op = 'create'").isEmpty()
    want = {(r["entity_id"], r["version"]) for r in events.where("version % 3 = 0").collect()}
    assert {(r["entity_id"], r["version"]) for r in read("snapshots").collect()} == want and want

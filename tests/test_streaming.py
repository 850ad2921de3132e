"""Streams against their batch twins and fixed results."""

import pytest
from pyspark.sql import functions as F

from recordlens.operators import timeline
from recordlens.streaming import segments as sg

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def files(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))


def seg(i, session, n, start=0.0, sha=None, text="hi"):
    return (i, "f", session, n, start, start + 5, sha, text)


def test_admission(rocks, tmp_path):
    rows = [seg("a", "s", 0, 0.0, "x"), seg("a", "s", 5), seg("b", "s", 0), seg("c", "s", 1, 0.0, "x"), seg("d", "s", 1, 9.0, "y"), seg("c", "s", 2, 20.0, "z"), seg("e", "s", 3), seg("g", "s", 4)]
    out = run(sg.admitted(files(rocks, tmp_path, [rows], sg.SEGMENT)), "admitted", rocks)
    assert {(r.segment_id, r.sequence_no) for r in out.where("not duplicate").collect()} == {("a", 0), ("d", 1), ("c", 2), ("e", 3), ("g", 4)}


def test_publication_in_order(rocks, tmp_path):
    batches = [[seg("seg-1", "s", 1)], [seg("seg-0", "s", 0), seg("t-0", "t", 0, text="")], [seg("seg-3", "s", 3), seg("t-1", "t", 1)]]
    out = run(sg.published(files(rocks, tmp_path, batches, sg.SEGMENT)), "published", rocks)
    got = [(r.session_id, r.sequence_no, r.published) for r in out.orderBy("session_id", "sequence_no").collect()]
    assert got == [("s", 0, True), ("s", 1, True), ("t", 0, False), ("t", 1, True)]
    last = rocks.createDataFrame([("f", 10)], "feed_id string, cursor long")
    assert sorted((r.segment_id, r.cursor) for r in sg.with_cursors(out, last).collect()) == [("seg-0", 11), ("seg-1", 12), ("t-1", 13)]


def test_live_sessions_match_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    out = run(sg.live_sessions(stream, "ts", "user_id"), "sessions", spark, "complete")
    batch = timeline.sessions(spark.read.parquet(f"{SF}/events.parquet"), ["user_id"], "ts", 5400, "event_id")
    want = sorted(tuple(r) for r in batch.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n")).select("user_id", "n").collect())
    assert sorted((r.user_id, r.turns) for r in out.collect()) == want

"""Feed states, gap reasons and labels against plain folds and fixed results."""

import random

from pyspark.sql import functions as F

from recordlens.functions import text as fx
from recordlens.operators import timeline as tl


def test_feed_states_follow_a_plain_fold(spark):
    dice = random.Random(7)
    rows = [(f"feed{k % 5}", k, dice.choice([*tl.EVENTS, "other"])) for k in range(400)] + [("hot", k, dice.choice([*tl.EVENTS, None])) for k in range(300)]
    want = {}
    for key, _, event in rows:
        state = want.get(key, "stopped")
        to, stay = tl.EVENTS.get(event, (state, []))
        want[key] = state if state in stay else to
    df = spark.createDataFrame(rows, "feed string, k int, event string")
    for at_once in (1, 7, 1000):
        assert {r.feed: r.state for r in tl.feed_states(df, "feed", ["k"], "event", at_once).collect()} == want
    assert tl.feed_states(df.where("false"), "feed", ["k"], "event").collect() == []


def test_gap_reasons(spark):
    rows = [("f", "s1", 1, 0.0), ("f", "s1", 2, 1.04), ("f", "s1", 3, 2.1), ("f", "s2", 4, 3.3), ("f", "s3", 5, 4.6), ("g", "s9", 6, 0.0)]
    df = spark.createDataFrame(rows, "feed string, session string, n int, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    got = tl.coverage_gaps(df, ["feed"], "session", "ts", F.col("ts") + F.make_dt_interval(secs=F.lit(1)), "n", F.lit("disconnect")).select("n", "reason").collect()
    assert {tuple(r) for r in got} == {(3, "disconnect"), (5, "worker_restart")}


def test_labels(spark):
    day = 86400
    ages = {None: "", -5.0: "today", 0.4 * day: "today", 0.5 * day: "yesterday", 2.0 * day: "2 days ago", 29.4 * day: "29 days ago", 29.5 * day: "1 mo ago", 200.0 * day: "7 mo ago", 365.0 * day: "1.0 yr ago", 1000.0 * day: "2.7 yr ago"}
    got = {r.s: r.a for r in spark.createDataFrame([(s,) for s in ages], "s double").withColumn("a", fx.relative_age(F.col("s"))).collect()}
    assert got == ages
    sizes = {None: "0", 0: "0", 1: "1 B", 1023: "1023 B", 1024: "1.0 KB", 10 * 1024: "10 KB", 1536: "1.5 KB", 1 << 20: "1.0 MB", 5 << 30: "5.0 GB", 1 << 52: "4096 TB"}
    got = {r.n: r.a for r in spark.createDataFrame([(s,) for s in sizes], "n long").withColumn("a", fx.byte_label(F.col("n"))).collect()}
    assert got == sizes

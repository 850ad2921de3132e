"""Capture of live feeds as a batch: admission by any of three keys, and cursors in order of publication.

Events are rows of feed_id, arrival (their order in the feed), kind, session_id, sequence_no, segment_id, audio_start,
audio_end, sha, text. Kinds: ``start`` and ``close`` of a session, ``segment``, and ``skip``, a number without speech.
``recordlens.streaming.capture`` does the same to a stream.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import written
from .components import connected

EVENT = "feed_id string, arrival long, kind string, session_id string, sequence_no long, segment_id string, audio_start double, audio_end double, sha string, text string"


def keyed(events: DataFrame) -> DataFrame:
    """Adds ``keys``: the segment's id, its place in the session, and its sound (feed, start, end, hash) if the hash is known."""
    part = lambda kind, *c: F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    keys = F.array(part("id", "segment_id"), part("place", "session_id", "sequence_no"), F.when(F.col("sha").isNotNull(), part("sound", "audio_start", "audio_end", "sha")))
    return events.withColumn("keys", F.filter(keys, lambda k: k.isNotNull()))


def duplicates(rows: DataFrame, whole: int = 200_000) -> DataFrame:
    """(feed_id, arrival, duplicate) of rows (feed_id, arrival, keys): a row is one if a row admitted before it, in its feed, has any of its keys.

    What is dropped stores nothing, so it blocks nothing after it: order decides. Feeds of at most ``whole`` rows are folded
    whole, each in one task. Of larger ones, rows that share keys, directly or over others, are found as components, and only
    they are folded, each component by itself.
    """
    rows = rows.select("feed_id", "arrival", "keys")
    large = written(rows.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select("feed_id"), "large-feeds")
    if large.isEmpty():
        return _folded(rows, "feed_id")
    return _folded(rows.join(large, "feed_id", "left_anti"), "feed_id").unionByName(_by_components(rows.join(large, "feed_id", "left_semi")))


def _by_components(rows: DataFrame) -> DataFrame:
    """``duplicates`` of large feeds. Rows with the same keys are duplicates of the first of them whatever became of it, so they never reach a component."""
    first = W.partitionBy("feed_id", "keys")
    rows = rows.withColumn("keys", F.array_sort(F.array_distinct("keys")))
    marked = rows.groupBy("feed_id", "keys").agg(F.min("arrival").alias("arrival"), F.count(F.lit(1)).alias("n"))
    distinct = written(marked.withColumn("row", F.xxhash64("feed_id", "arrival")), "distinct-keys")
    by_key = distinct.select("feed_id", "row", F.explode("keys").alias("key"))
    shared = by_key.groupBy("feed_id", "key").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    roots = connected(by_key.join(shared, ["feed_id", "key"]).select("a", F.col("row").alias("b")))
    linked = distinct.join(roots, distinct["row"] == roots["node"]).select("root", "feed_id", "arrival", "keys")
    dropped = _folded(linked, "root").where("duplicate").select("feed_id", "arrival", F.lit(True).alias("dropped"))
    # Rows without keys repeat nothing.
    every = rows.withColumn("repeated", (F.size("keys") > 0) & (F.col("arrival") > F.min("arrival").over(first)))
    return every.join(dropped, ["feed_id", "arrival"], "left").select("feed_id", "arrival", (F.col("repeated") | F.coalesce("dropped", F.lit(False))).alias("duplicate"))


def _folded(rows: DataFrame, group: str) -> DataFrame:
    """(feed_id, arrival, duplicate): the rows (feed_id, arrival, keys) of each ``group`` in order of arrival."""

    def fold(batches):
        root, seen = None, set()
        for b in batches:
            keys, end, out = b.column("keys").flatten().to_pylist(), 0, []
            for r, n in zip(b.column(group).to_pylist(), b.column("keys").value_lengths().to_pylist(), strict=True):
                if r != root:
                    root, seen = r, set()
                own, end = keys[end : end + (n or 0)], end + (n or 0)
                out.append(not seen.isdisjoint(own))
                if not out[-1]:
                    seen.update(own)
            yield pa.RecordBatch.from_arrays([b.column("feed_id"), b.column("arrival"), pa.array(out, pa.bool_())], ["feed_id", "arrival", "duplicate"])

    kind = dict(rows.dtypes)
    return rows.repartition(group).sortWithinPartitions(group, "arrival").mapInArrow(fold, f"feed_id {kind['feed_id']}, arrival {kind['arrival']}, duplicate boolean")


def numbered(rows: DataFrame, key: str, moment: str, order: list, width: int = 100_000) -> DataFrame:
    """Adds ``cursor``: the place of a row in its key's order by ``moment``, then ``order``.

    Rows are ranked inside stretches of ``width`` moments, and the stretches' sizes added up: a key is never sorted in one task.
    """
    cut = rows.withColumn("_cut", F.floor(F.col(moment) / width))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1))
    sizes = cut.groupBy(key, "_cut").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    rank = F.row_number().over(W.partitionBy(key, "_cut").orderBy(moment, *order))
    return cut.withColumn("_k", rank).join(sizes, [key, "_cut"]).withColumn("cursor", F.col("_before") + F.col("_k")).drop("_cut", "_k", "_before")


def published(events: DataFrame) -> DataFrame:
    """feed_id, cursor, session_id, sequence_no, segment_id, text, moment of what is published, in a feed's order of publication.

    A segment that is admitted waits until its session's numbers before it have come, as segments, duplicates or skips. What
    still waits is released when its session closes, by number, or when the feed starts a session, by the sound's
    start. ``moment`` is the arrival of the event that released it. A session that closes or starts counts its numbers anew.
    """
    segments = written(duplicates(keyed(events.where("kind = 'segment'")).select("feed_id", "arrival", "keys")), "duplicates")
    by_session, by_feed = W.partitionBy("feed_id", "session_id").orderBy("arrival"), W.partitionBy("feed_id").orderBy("arrival")
    ahead = (1, W.unboundedFollowing)
    e = events.join(segments, ["feed_id", "arrival"], "left")
    e = e.withColumns(
        {
            "life": F.count(F.when(F.col("kind").isin("close", "start"), 1)).over(by_session.rowsBetween(W.unboundedPreceding, 0)),
            "closed": F.min(F.when(F.col("kind") == "close", F.col("arrival"))).over(by_session.rowsBetween(*ahead)),
            "started": F.min(F.when(F.col("kind") == "start", F.col("arrival"))).over(by_feed.rowsBetween(*ahead)),
        }
    )
    e = written(e.where("kind in ('segment', 'skip')"), "numbers")
    session = ["feed_id", "session_id", "life"]
    slots = e.groupBy(*session, "sequence_no").agg(F.min("arrival").alias("ready"))
    w = W.partitionBy(*session).orderBy("sequence_no")
    slots = slots.withColumns({"whole": F.row_number().over(w) == F.col("sequence_no") + 1, "in_turn": F.max("ready").over(w)})
    # A number that was passed over before its segment came has no turn any more.
    turn = F.when(F.col("whole") & (F.col("arrival") <= F.col("in_turn")), F.col("in_turn"))
    rows = e.where("kind = 'segment' and not duplicate").join(slots, [*session, "sequence_no"]).withColumn("moment", F.least(turn, "closed", "started")).where("moment is not null")
    by_sound = F.when((F.col("moment") == F.col("started")) & ~F.coalesce(F.col("moment") == turn, F.lit(False)), F.col("audio_start")).otherwise(0.0)
    return numbered(rows.withColumn("_sound", by_sound), "feed_id", "moment", ["_sound", "sequence_no", "audio_start", "arrival"]).select("feed_id", "cursor", "session_id", "sequence_no", "segment_id", "text", "moment")


def session_states(events: DataFrame) -> DataFrame:
    """(feed_id, session_id, status): stopped by its close, recovered by the feed's next start without one, else active."""
    by_feed = W.partitionBy("feed_id").orderBy("arrival").rowsBetween(1, W.unboundedFollowing)
    starts = events.where("kind = 'start'").withColumn("next", F.min("arrival").over(by_feed)).groupBy("feed_id", "session_id").agg(F.max("arrival").alias("start"), F.max_by("next", "arrival").alias("next"))
    closes = events.where("kind = 'close'").groupBy("feed_id", "session_id").agg(F.max("arrival").alias("close"))
    status = F.when(F.col("close") > F.col("start"), "stopped").when(F.col("next").isNotNull(), "recovered").otherwise("active")
    return starts.join(closes, ["feed_id", "session_id"], "left").select("feed_id", "session_id", status.alias("status"))

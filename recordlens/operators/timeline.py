"""Sequences in time: sessions, forward fill, as-of and interval joins, gaps, retention, cursors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx


def sessions(rows: DataFrame, keys: list[str], ts: str, gap_seconds: float, order: str, inclusive: bool = True) -> DataFrame:
    """Adds session (0, 1, ...) within ``keys``: a new one where the gap exceeds ``gap_seconds`` (or reaches it, if not ``inclusive``)."""
    w = W.partitionBy(*keys).orderBy(ts, order)
    gap = fx.micros(F.col(ts)) - F.lag(fx.micros(F.col(ts))).over(w)
    limit = int(gap_seconds * 1_000_000)
    new = F.when(gap > limit if inclusive else gap >= limit, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def fill_forward(rows: DataFrame, keys: list[str], order: list[str], value: str, inside: Column) -> DataFrame:
    """Last known ``value`` while ``inside`` holds without a break; null elsewhere."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = rows.withColumns({"_in": inside, "_run": F.sum(F.when(inside, 0).otherwise(1)).over(w)})
    run = W.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn(value, F.when(F.col("_in"), F.last(F.when(F.col("_in"), F.col(value)), ignorenulls=True).over(run))).drop("_in", "_run")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, order: str) -> DataFrame:
    """Each left row with the ``value`` of the last right row of its keys at or before its time.

    A union and one window: one shuffle on the keys, no row pairs.
    """
    cols = [*keys, ts, order]
    both = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("_side")).unionByName(right.select(*cols, value, F.lit(0).alias("_side")))
    w = W.partitionBy(*keys).orderBy(ts, "_side", order).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def intervals(rows: DataFrame, keys: list[str], ts: str, order: str) -> DataFrame:
    """Adds upto, the time of the next row of the keys; null on the last, which is open."""
    return rows.withColumn("upto", F.lead(ts).over(W.partitionBy(*keys).orderBy(ts, order)))


def within(points: DataFrame, spans: DataFrame, keys: list[str], ts: str, start: str, end: str, width_seconds: int, closed: bool = False) -> DataFrame:
    """Points joined to the spans of their keys that hold them: start <= ts < end (or <= end, if ``closed``).

    Spans are cut into time buckets of ``width_seconds``, so the join has an equality on keys and bucket.
    Spans must have an end.
    """
    bucket = lambda c: F.floor(fx.micros(F.col(c)) / (width_seconds * 1_000_000))
    s = spans.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    p = points.withColumn("_b", bucket(ts))
    before = F.col(ts) <= F.col(end) if closed else F.col(ts) < F.col(end)
    return p.join(s, [*keys, "_b"]).where((F.col(start) <= F.col(ts)) & before).drop("_b")


def seconds_by(rows: DataFrame, keys: list[str], ts: str, order: str, role: str) -> DataFrame:
    """Seconds from each row to the next, by role; the last row of the keys adds none."""
    w = W.partitionBy(*keys).orderBy(ts, order)
    length = F.greatest(F.lead(fx.micros(F.col(ts))).over(w) - fx.micros(F.col(ts)), F.lit(0))
    return rows.withColumn("_s", length).groupBy(*keys, role).agg((F.coalesce(F.sum("_s"), F.lit(0)) / 1e6).alias("seconds"))


def gaps(rows: DataFrame, keys: list[str], start: str, end: Column, order: str, least_seconds: float) -> DataFrame:
    """Silence of more than ``least_seconds`` between the end of one row and the start of the next."""
    w = W.partitionBy(*keys).orderBy(start, order)
    out = rows.withColumn("gap_start", F.lag(end).over(w)).withColumn("gap_end", F.col(start))
    out = out.withColumn("seconds", (fx.micros(F.col("gap_end")) - fx.micros(F.col("gap_start"))) / 1e6)
    return out.where(F.col("seconds") > least_seconds)


def coverage_gaps(rows: DataFrame, keys: list[str], session: str, start: str, end: Column, order: str, cause: Column, restart_seconds: float = 0.25, break_seconds: float = 0.05) -> DataFrame:
    """Gaps with their reason: ``worker_restart`` where the session changes, if longer than ``restart_seconds``, else ``cause``, if longer than ``break_seconds``."""
    w = W.partitionBy(*keys).orderBy(start, order)
    restart = F.coalesce(F.col(session) != F.lag(session).over(w), F.lit(False))
    marked = rows.withColumn("reason", F.when(restart, "worker_restart").otherwise(cause))
    return gaps(marked, keys, start, end, order, break_seconds).where((F.col("reason") != "worker_restart") | (F.col("seconds") > restart_seconds))


# The states of a feed.
STATES = ["connecting", "receiving_audio", "no_speech_detected", "transcription_pending", "publishing", "upstream_unavailable", "asr_failure", "storage_failure", "stopped"]
FAULTS = ["upstream_unavailable", "asr_failure", "storage_failure"]
#: What an event leads to, and the states that it does not leave.
EVENTS = {
    "start": ("connecting", []), "connect": ("connecting", FAULTS), "audio": ("receiving_audio", [s for s in STATES if s not in ("connecting", "upstream_unavailable")]),
    "queued": ("transcription_pending", [s for s in STATES if s not in ("receiving_audio", "no_speech_detected")]), "taken": ("transcription_pending", ["storage_failure"]),
    "silence": ("no_speech_detected", ["upstream_unavailable"]), "published": ("publishing", []), "drained": ("receiving_audio", ["upstream_unavailable"]),
    "upstream": ("upstream_unavailable", []), "asr": ("asr_failure", []), "storage": ("storage_failure", []), "stop": ("stopped", []),
}


def feed_states(events: DataFrame, key: str, order: list[str], event: str, at_once: int = 1000) -> DataFrame:
    """(key, state): the state that a feed's events, in ``order``, lead to from ``stopped``; an event without a meaning changes nothing.

    An event is a mapping of states. Mappings compose, so a feed's events are folded ``at_once`` at a time, and then the results.
    """
    ints = lambda xs: F.array(*[F.lit(STATES.index(x)) for x in xs])
    same = ints(STATES)
    steps = F.create_map(*[x for e, (to, stay) in EVENTS.items() for x in (F.lit(e), ints([s if s in stay else to for s in STATES]))])
    rows = events.select(key, (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).alias("_k"), F.coalesce(steps[F.col(event)], same).alias("_step"))

    def folded(rows: DataFrame, keys: list[str]) -> DataFrame:
        run = F.array_sort(F.collect_list(F.struct("_k", "_step")))
        return rows.groupBy(*keys).agg(F.aggregate(run, same, lambda was, x: F.transform(was, lambda s: F.get(x["_step"], s))).alias("_step"))

    parts = folded(rows.withColumn("_part", F.floor(F.col("_k") / at_once)), [key, "_part"]).withColumnRenamed("_part", "_k")
    whole = folded(parts, [key])
    return whole.select(key, F.get(F.array(*map(F.lit, STATES)), F.get("_step", F.lit(STATES.index("stopped")))).alias("state"))


def retained(rows: DataFrame, end: str, as_of_ts: Column, audio_seconds: int, row_seconds: int, audio: list[str]) -> DataFrame:
    """Rows older than ``row_seconds`` go; of those at least ``audio_seconds`` old the ``audio`` columns are cleared and marked."""
    age = fx.micros(as_of_ts) - fx.micros(F.col(end))
    purge = age >= audio_seconds * 1_000_000
    cleared = {c: F.when(~purge, F.col(c)) for c in audio}
    return rows.where(age < row_seconds * 1_000_000).withColumns(cleared).withColumn("purged", purge)


def page_after(rows: DataFrame, cursor: str, after: int, limit: int) -> DataFrame:
    """The ``limit`` rows after a cursor, ascending, each with has_more."""
    found = rows.where(F.col(cursor) > after).orderBy(cursor).limit(limit + 1)
    n = F.count(F.lit(1)).over(W.partitionBy())  # of limit + 1 rows at most
    return found.withColumn("has_more", n > limit).orderBy(cursor).limit(limit)


def timeline(rows: DataFrame, ts: str) -> DataFrame:
    """Counts by month, week (from Sunday) and day."""
    day = F.to_date(ts)
    week = F.date_sub(day, F.dayofweek(day) - 1)
    kinds = F.array(*[F.struct(F.lit(k).alias("unit"), v.cast("string").alias("bucket")) for k, v in (("day", day), ("week", week), ("month", F.date_format(ts, "yyyy-MM")))])
    return rows.select(F.inline(kinds)).groupBy("unit", "bucket").agg(F.count(F.lit(1)).alias("n"))

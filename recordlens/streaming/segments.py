"""Live transcript segments: idempotent admission, ordered publication, sessions of turns.

State is per feed or per session and grows only with what is still out of order, plus the keys that
admission must remember; both can be bounded by a time to live. Without one, what follows a missing sequence
number is held without end.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEGMENT = "segment_id string, feed_id string, session_id string, sequence_no long, audio_start double, audio_end double, sha string, text string"
ADMITTED = SEGMENT + ", duplicate boolean"
PUBLISHED = "feed_id string, session_id string, sequence_no long, segment_id string, text string, published boolean"


class _Admission(StatefulProcessor):
    """A segment is a duplicate if its id, its (session, sequence number) or its (feed, start, end, hash) was stored.

    Only what is admitted is stored, so a dropped segment blocks nothing after it.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([T.StructField("k", T.StringType())])
        seen = T.StructType([T.StructField("v", T.BooleanType())])
        self.maps = [handle.getMapState(name, key, seen, self.ttl_ms) for name in ("ids", "slots", "audio")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            flags = []
            for r in part.itertuples(index=False):
                keys = [(r.segment_id,), (f"{r.session_id}\x1f{r.sequence_no}",), (f"{r.audio_start}\x1f{r.audio_end}\x1f{r.sha}",) if r.sha else None]
                known = any(k is not None and m.containsKey(k) for m, k in zip(self.maps, keys, strict=True))
                if not known:
                    for m, k in zip(self.maps, keys, strict=True):
                        if k is not None:
                            m.updateValue(k, (True,))
                flags.append(known)
            yield part.assign(duplicate=flags)

    def close(self) -> None:
        pass


class _Publication(StatefulProcessor):
    """Releases a session's segments in sequence; a segment without speech takes its place but is not published."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", T.StructType([T.StructField("n", T.LongType())]))
        pending = T.StructType([T.StructField(n, T.StringType()) for n in ("feed_id", "segment_id", "text")])
        self.pending = handle.getMapState("pending", T.StructType([T.StructField("n", T.LongType())]), pending)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples(index=False):
                self.pending.updateValue((int(r.sequence_no),), (r.feed_id, r.segment_id, r.text))
        n = self.expected.get()[0] if self.expected.exists() else 0
        out = []
        while self.pending.containsKey((n,)):
            feed, segment, text = self.pending.getValue((n,))
            out.append((feed, key[0], n, segment, text, bool(text)))
            self.pending.removeKey((n,))
            n += 1
        self.expected.update((n,))
        yield pd.DataFrame(out, columns=["feed_id", "session_id", "sequence_no", "segment_id", "text", "published"])

    def close(self) -> None:
        pass


def admitted(segments: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The stream with ``duplicate``; needs the RocksDB state store."""
    return segments.groupBy("feed_id").transformWithStateInPandas(_Admission(ttl_ms), ADMITTED, "Append", "None")


def published(segments: DataFrame) -> DataFrame:
    """Segments of each session in sequence, as far as no number is missing."""
    return segments.groupBy("session_id").transformWithStateInPandas(_Publication(), PUBLISHED, "Append", "None")


def with_cursors(batch: DataFrame, last: DataFrame) -> DataFrame:
    """Feed-wide cursors of a batch of published rows, behind ``last`` (feed_id, cursor): for one foreachBatch writer."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("feed_id").orderBy("session_id", "sequence_no"))
    return batch.where("published").withColumn("_k", k).join(last, "feed_id", "left").withColumn("cursor", F.col("_k") + F.coalesce("cursor", F.lit(0))).drop("_k")


def live_sessions(turns: DataFrame, ts: str, key: str, gap_minutes: int = 90, late: str = "1 day") -> DataFrame:
    """Session windows of turns. A gap of exactly ``gap_minutes`` stays in the session, so the window is a microsecond wider."""
    window = F.session_window(ts, f"{gap_minutes} minutes 1 microsecond")
    return turns.withWatermark(ts, late).groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("turns"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def chunks(events: DataFrame, ts: str, key: str, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """Fixed-length chunks of a stream, each with its rows and the span that they cover."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))

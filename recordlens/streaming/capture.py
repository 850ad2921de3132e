"""Capture of live feeds as a stream: the same events, keys, order and cursors as ``recordlens.operators.capture``.

A feed is a key of the state: what it has admitted, the segments that wait for a number before them, its sessions and its
last cursor. A query that starts again from its checkpoint goes on with them, so cursors stay unique. Where ``idle_ms``
is given, a timer recovers a feed of which nothing has come for so long: what waits is released by the sound's start, and
the active session is marked. ``ttl_ms`` bounds how long admission remembers. Needs the RocksDB state store.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CAPTURED = "feed_id string, kind string, session_id string, sequence_no long, segment_id string, text string, cursor long, status string"
_COLUMNS = [c.split()[0] for c in CAPTURED.split(", ")]


class _Feed(StatefulProcessor):
    def __init__(self, idle_ms: int | None, ttl_ms: int | None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.on = handle, {"segment": self.segment, "skip": self.skip, "start": self.start, "close": self.closed}
        self.seen = handle.getMapState("seen", "key string", "known boolean", self.ttl_ms)
        self.ready = handle.getMapState("ready", "session string, number long", "known boolean")
        self.waiting = handle.getMapState("waiting", "session string, number long", "arrival long, segment string, sound double, text string")
        self.sessions = handle.getMapState("sessions", "session string", "expected long, status string")
        self.feed = handle.getValueState("feed", "cursor long, active string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.begin(key)
        # Order decides, so a batch's events of the feed are sorted first.
        for r in pd.concat(list(rows)).sort_values("arrival", kind="stable").itertuples(index=False):
            self.on[r.kind](r)
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.end()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.begin(key)
        self.recover()
        yield self.end()

    def begin(self, key) -> None:
        self.name, self.out = key[0], []
        self.cursor, self.active = self.feed.get() if self.feed.exists() else (0, None)

    def end(self) -> pd.DataFrame:
        self.feed.update((self.cursor, self.active))
        out = pd.DataFrame(self.out, columns=_COLUMNS)
        return out.astype({"sequence_no": "Int64", "cursor": "Int64"})

    def segment(self, r) -> None:
        keys = [f"id\x1f{r.segment_id}", f"place\x1f{r.session_id}\x1f{int(r.sequence_no)}", *([f"sound\x1f{r.audio_start}\x1f{r.audio_end}\x1f{r.sha}"] if r.sha is not None else [])]
        place = (r.session_id, int(r.sequence_no))
        if any(self.seen.containsKey((k,)) for k in keys):
            self.out.append((self.name, "duplicate", *place, r.segment_id, r.text, None, None))
        else:
            for k in keys:
                self.seen.updateValue((k,), (True,))
            self.waiting.updateValue(place, (int(r.arrival), r.segment_id, float(r.audio_start), r.text))
        self.skip(r)

    def skip(self, r) -> None:
        """The number has come: release what it held up."""
        self.ready.updateValue((r.session_id, int(r.sequence_no)), (True,))
        n, status = self.session(r.session_id)
        while self.ready.containsKey((r.session_id, n)):
            self.ready.removeKey((r.session_id, n))
            if self.waiting.containsKey((r.session_id, n)):
                self.publish((r.session_id, n), self.waiting.getValue((r.session_id, n)))
            n += 1
        self.sessions.updateValue((r.session_id,), (n, status))

    def closed(self, r) -> None:
        self.flush(lambda place, x: (place[1], x[2], x[0]), r.session_id)
        self.forget(r.session_id)
        self.mark(r.session_id, 0, "stopped")

    def start(self, r) -> None:
        self.recover()
        self.forget(r.session_id)
        self.mark(r.session_id, 0, "active")
        self.active = r.session_id

    def recover(self) -> None:
        """Release all that waits in the feed, and mark a session that has not been closed."""
        if self.active is not None:
            expected, status = self.session(self.active)
            if status == "active":
                self.mark(self.active, expected, "recovered")
        self.flush(lambda place, x: (x[2], place[1], x[0]))

    def session(self, name: str) -> tuple:
        return self.sessions.getValue((name,)) if self.sessions.containsKey((name,)) else (0, None)

    def mark(self, name: str, expected: int, status: str) -> None:
        self.sessions.updateValue((name,), (expected, status))
        self.out.append((self.name, "session", name, None, None, None, None, status))

    def forget(self, name: str) -> None:
        for place in [k for k in self.ready.keys() if k[0] == name]:
            self.ready.removeKey(place)

    def flush(self, order, session: str | None = None) -> None:
        held = [(k, v) for k, v in self.waiting.iterator() if session is None or k[0] == session]
        for place, x in sorted(held, key=lambda kv: order(*kv)):
            self.publish(place, x)

    def publish(self, place: tuple, x: tuple) -> None:
        self.cursor += 1
        self.waiting.removeKey(place)
        self.out.append((self.name, "published", *place, x[1], x[3], self.cursor, None))

    def close(self) -> None:
        pass


def captured(events: DataFrame, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """A stream of events as a stream of what they lead to: segments published with their cursor, duplicates, and states of sessions."""
    return events.groupBy("feed_id").transformWithStateInPandas(_Feed(idle_ms, ttl_ms), CAPTURED, "Append", "ProcessingTime" if idle_ms else "None")

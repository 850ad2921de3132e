"""Capture of live feeds: the batch, the stream and a plain fold over the events agree."""

import itertools
import random
import time

import pytest

from recordlens.operators import capture
from recordlens.operators.components import connected
from recordlens.streaming import capture as live

COLUMNS = [c.split()[0] for c in capture.EVENT.split(", ")]


def event(feed, arrival, kind, session, number=None, ident=None, start=None, sha=None, text="hi"):
    return (feed, arrival, kind, session, number, ident, start, None if start is None else start + 5.0, sha, text if kind == "segment" else None)


def some_events(seed, feeds=3, n=160):
    rng, out = random.Random(seed), []
    for feed in "fgh"[:feeds]:
        session, number, held = -1, 0, []
        for k in range(n):
            x = rng.random()
            if session < 0 or x < 0.04:
                session, number = session + 1, 0
                out.append((feed, "start", f"s{session}", None, None, None, None))
            elif x < 0.07:
                out.append((feed, "close", f"s{rng.randint(0, session)}", None, None, None, None))
                number = 0
            elif x < 0.12:
                out.append((feed, "skip", f"s{session}", number + rng.randint(0, 2), None, None, None))
            else:
                s = (feed, "segment", f"s{session}", number, f"id{rng.randint(0, 2 * n)}", float(rng.randint(0, 400)), rng.choice([None, "x", "y", f"h{k}"]))
                number += 1
                if rng.random() < 0.15:
                    held.append(s)  # comes late, or never
                else:
                    out.append(s)
                if held and rng.random() < 0.2:
                    out.append(held.pop(rng.randrange(len(held))))
                if rng.random() < 0.1:
                    out.append(rng.choice([x for x in out if x[0] == feed]))
    return [event(f, k, kind, s, n, i, start, sha, f"t{k}") for k, (f, kind, s, n, i, start, sha) in enumerate(out)]


def folded(events):
    """What the events lead to, one by one: (feed, cursor, session, number, id, text), duplicates' arrivals, states of sessions."""
    shown, twice, states = [], [], {}
    for feed, rows in itertools.groupby(sorted(events), lambda e: e[0]):
        stored, ready, expected, rows_waiting, active, cursor = set(), set(), {}, [], None, 0

        def publish(rows, feed=feed):
            nonlocal cursor
            for r in rows:
                cursor += 1
                shown.append((feed, cursor, r[3], r[4], r[5], r[9]))

        for e in rows:
            _, arrival, kind, session, number, ident, start, end, sha, _ = e
            if kind == "start":
                if active and states[feed, active] == "active":
                    states[feed, active] = "recovered"
                publish(sorted(rows_waiting, key=lambda r: (r[6], r[4], r[1])))
                rows_waiting, active, states[feed, session] = [], session, "active"
            if kind == "close":
                publish(sorted((r for r in rows_waiting if r[3] == session), key=lambda r: (r[4], r[6], r[1])))
                rows_waiting, states[feed, session] = [r for r in rows_waiting if r[3] != session], "stopped"
            if kind in ("start", "close"):
                expected[session], ready = 0, {x for x in ready if x[0] != session}
                continue
            if kind == "segment":
                keys = {("id", ident), ("place", session, number)} | ({("sound", start, end, sha)} if sha else set())
                if keys & stored:
                    twice.append((feed, arrival))
                else:
                    stored |= keys
                    rows_waiting.append(e)
            ready.add((session, number))
            while (session, expected.setdefault(session, 0)) in ready:
                at = (session, expected[session])
                publish([r for r in rows_waiting if (r[3], r[4]) == at])
                rows_waiting = [r for r in rows_waiting if (r[3], r[4]) != at]
                expected[session] += 1
    return shown, twice, states


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_is_the_fold(spark, seed):
    events = some_events(seed)
    shown, twice, states = folded(events)
    rows = spark.createDataFrame(random.Random(seed).sample(events, len(events)), capture.EVENT)
    marked = capture.duplicates(capture.keyed(rows.where("kind = 'segment'"))).where("duplicate")
    assert sorted((r.feed_id, r.arrival) for r in marked.collect()) == sorted(twice) and len(twice) > 20
    got = capture.published(rows).select("feed_id", "cursor", "session_id", "sequence_no", "segment_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(shown) and len(shown) > 150
    assert {(r.feed_id, r.session_id): r.status for r in capture.session_states(rows).collect()} == {k: v for k, v in states.items()}
    assert set(states.values()) == {"active", "stopped", "recovered"}


@pytest.mark.parametrize("whole", [200_000, 60, 0])
def test_duplicates_of_small_and_large_feeds(spark, monkeypatch, whole):
    """Small feeds are folded whole, without components; large ones by components, with the same result. Rows without keys are no duplicates."""
    found = []
    monkeypatch.setattr(capture, "connected", lambda edges: found.append(1) or connected(edges))
    rng = random.Random(9)
    rows = [(feed, k, [f"{kind}{rng.randrange(n)}" for kind, n in (("a", 40), ("b", 25), ("c", 60)) if rng.random() < 0.7]) for feed, size in ((1, 90), (2, 50), (3, 1), (4, 120)) for k in range(size)]
    want, seen = set(), {}
    for feed, k, keys in rows:
        stored = seen.setdefault(feed, set())
        twice = bool(stored & set(keys))
        want.add((feed, k, twice))
        if not twice:
            stored |= set(keys)
    assert sum(not keys for _, _, keys in rows) > 3 and 0.2 < sum(d for _, _, d in want) / len(rows) < 0.95
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "feed_id long, arrival long, keys array<string>").repartition(3)
    got = (capture.duplicates(frame) if whole == 200_000 else capture.duplicates(frame, whole)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert bool(found) == (whole < 200_000)


def test_cursors_over_stretches(spark):
    rows = spark.createDataFrame([(k % 2, k, k % 7) for k in range(500)], "feed int, moment long, n long")
    got = capture.numbered(rows, "feed", "moment", ["n"], width=13).collect()
    assert sorted((r.feed, r.moment, r.cursor) for r in got) == [(f, k, i) for f in (0, 1) for i, k in enumerate(range(f, 500, 2), 1)]


def test_connected(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(55)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(None, 3), (7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root[x] for a, b in edges if a is not None and a != b for x in (a, b)}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, batches, until=(), **more):
    """Each batch by a query of its own that goes on from the checkpoint of the one before; with timers, until so many rows are published."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, capture.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        out = live.captured(spark.readStream.schema(capture.EVENT).json(str(tmp_path / "in")), **more)
        w = out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at"))
        if more:  # timers need batches that go on without data
            q = w.trigger(processingTime="1 second").start()
            end = time.time() + 90
            while time.time() < end and q.isActive and len([x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines() if '"published"' in x]) < until[k]:
                time.sleep(0.5)
            q.stop()
        else:
            q = w.trigger(availableNow=True).start()
            q.awaitTermination(180)
        assert q.exception() is None
    return spark.read.schema(live.CAPTURED).json(str(tmp_path / "out"))


def test_stream_is_the_fold_over_restarts(rocks, tmp_path):
    events = some_events(3, feeds=2, n=110)
    third = len(events) // 3
    # The feeds' events come in their order from batch to batch, in any order within one.
    by_feed = {f: [e for e in events if e[0] == f] for f in "fg"}
    cuts = [[e for f in "fg" for e in by_feed[f][k * third // 2 : (k + 1) * third // 2 if k < 2 else None]] for k in range(3)]
    out = streamed(rocks, tmp_path, [random.Random(k).sample(c, len(c)) for k, c in enumerate(cuts)])
    shown, twice, states = folded(events)
    got = out.where("kind = 'published'").select("feed_id", "cursor", "session_id", "sequence_no", "segment_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(shown)
    assert out.where("kind = 'duplicate'").count() == len(twice)
    last = {}
    for r in out.where("kind = 'session'").collect():
        last.setdefault((r.feed_id, r.session_id), set()).add(r.status)
    assert all(v in last[k] for k, v in states.items())
    batch = capture.published(rocks.createDataFrame(events, capture.EVENT)).select("feed_id", "cursor", "segment_id")
    assert sorted(map(tuple, batch.collect())) == sorted((r.feed_id, r.cursor, r.segment_id) for r in got)


def test_idle_feed_is_recovered(rocks, tmp_path):
    first = [event("f", 1, "start", "s"), event("f", 3, "segment", "s", 2, "c", 20.0), event("f", 4, "segment", "s", 1, "b", 30.0), event("f", 5, "segment", "s", 4, "e", 10.0)]
    out = streamed(rocks, tmp_path, [first, [event("f", 9, "segment", "s", 0, "a", 0.0)]], until=(3, 4), idle_ms=3000)
    rows = [(r.segment_id, r.cursor) for r in out.where("kind = 'published' and feed_id = 'f'").orderBy("cursor").collect()]
    assert rows == [("e", 1), ("c", 2), ("b", 3), ("a", 4)]
    assert {r.status for r in out.where("kind = 'session' and feed_id = 'f'").collect()} == {"active", "recovered"}

"""Queries of live capture: events stand for what feeds send."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx
from ..operators import capture
from .base import query

#: Admission in order, one event of every feed a step: what a feed has stored is a list that grows.
_FOLD = """
f as (select feed, 0::bigint as i, []::varchar[] as seen, null::bigint as arrival, true as dup from (select distinct feed from k)
  union all select k.feed, k.i, case when list_has_any(f.seen, k.keys) then f.seen else list_concat(f.seen, k.keys) end, k.arrival, list_has_any(f.seen, k.keys) from f join k on k.feed = f.feed and k.i = f.i + 1)"""


@query(f"""
with recursive k as (select user_id as feed, event_id as arrival, row_number() over (partition by user_id order by event_id) as i,
  list_filter([props, event_type || hour(ts), case when event_type <> 'view' then 'v' || floor(value)::int end], lambda x: x is not null) as keys from events), {_FOLD}
select feed, arrival, dup as duplicate from f where i > 0""")
def w01_three_keys(t):
    sound = F.when(F.col("event_type") != "view", F.concat(F.lit("v"), F.floor("value").cast("string")))
    keys = F.filter(F.array("props", F.concat("event_type", F.hour("ts").cast("string")), sound), lambda x: x.isNotNull())
    rows = t.events.select(F.col("user_id").alias("feed_id"), F.col("event_id").alias("arrival"), keys.alias("keys"))
    return capture.duplicates(rows).select(F.col("feed_id").alias("feed"), "arrival", "duplicate")


_CAPTURE = f"""
with recursive e as (select user_id::varchar as feed, 'w' || ((day(ts) - 1) // 7) as session, event_id, ts, value, event_type, json_extract_string(props, '$.k') as k from events),
v as (select *, row_number() over (partition by feed, session order by value, event_id) - 1 as n from e where event_type <> 'signup'),
ev as (select feed, session, 2 * event_id + 1 as arrival, case event_type when 'error' then 'skip' else 'segment' end as kind, n, 'e' || k as id, epoch(ts) as sound from v where k::int % 10 <> 3
  union all select feed, session, 2 * event_id + 1, 'close', null, null, null from e where event_type = 'signup' and value < 20
  union all select feed, session, 2 * min(event_id), 'start', null, null, null from e group by all),
k as (select feed, arrival, row_number() over (partition by feed order by arrival) as i, ['id' || id, 'place' || session || ':' || n] as keys from ev where kind = 'segment'), {_FOLD},
ends as (select feed, session, arrival, kind from ev where kind in ('close', 'start')),
num as (select x.feed, x.session, x.arrival, any_value(x.kind) as kind, any_value(x.n) as n, any_value(x.id) as id, any_value(x.sound) as sound, count(y.arrival) as life
  from ev x left join ends y on y.feed = x.feed and y.session = x.session and y.arrival < x.arrival where x.kind in ('segment', 'skip') group by x.feed, x.session, x.arrival),
slot as (select feed, session, life, n, min(arrival) as ready from num group by all),
row_ as (select num.* from num join f using (feed, arrival) where num.kind = 'segment' and not f.dup),
turn as (select r.feed, r.arrival, count(*) as numbers, max(s.ready) as ready from row_ r join slot s on s.feed = r.feed and s.session = r.session and s.life = r.life and s.n <= r.n group by all),
flush as (select r.feed, r.arrival, min(y.arrival) filter (y.kind = 'close' and y.session = r.session) as closed, min(y.arrival) filter (y.kind = 'start') as started
  from row_ r left join ends y on y.feed = r.feed and y.arrival > r.arrival group by all),
due as (select row_.*, case when numbers = n + 1 and row_.arrival <= ready then ready end as turn, closed, started from row_ join turn using (feed, arrival) join flush using (feed, arrival)),
moment as (select *, list_min(list_filter([turn, closed, started], lambda x: x is not null)) as moment from due)"""


def _events(t):
    week = F.concat(F.lit("w"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string"))
    e = t.events.select(F.col("user_id").cast("string").alias("feed_id"), week.alias("session_id"), "event_id", "value", "event_type", (fx.micros(F.col("ts")) / 1e6).alias("audio_start"), F.get_json_object("props", "$.k").alias("k"))
    n = F.row_number().over(W.partitionBy("feed_id", "session_id").orderBy("value", "event_id")) - 1
    numbers = e.where("event_type <> 'signup'").withColumn("sequence_no", n.cast("long")).where("cast(k as int) % 10 <> 3")
    kind = F.when(F.col("event_type") == "error", "skip").otherwise("segment")
    numbers = numbers.select("feed_id", (2 * F.col("event_id") + 1).alias("arrival"), kind.alias("kind"), "session_id", "sequence_no", F.concat(F.lit("e"), "k").alias("segment_id"), "audio_start", (F.col("audio_start") + 5).alias("audio_end"), F.col("event_type").alias("text"))
    closes = e.where("event_type = 'signup' and value < 20").select("feed_id", (2 * F.col("event_id") + 1).alias("arrival"), F.lit("close").alias("kind"), "session_id")
    starts = e.groupBy("feed_id", "session_id").agg((2 * F.min("event_id")).alias("arrival")).withColumn("kind", F.lit("start"))
    return numbers.unionByName(closes, True).unionByName(starts, True).withColumn("sha", F.lit(None).cast("string"))


@query(f"""{_CAPTURE}
select feed, row_number() over (partition by feed order by moment, case when moment = started and moment is distinct from turn then sound else 0 end, n, sound, arrival) as cursor, session, n, id as segment, moment
from moment where moment is not null""")
def w03_captured(t):
    p = capture.published(_events(t))
    return p.select(F.col("feed_id").alias("feed"), "cursor", F.col("session_id").alias("session"), F.col("sequence_no").alias("n"), F.col("segment_id").alias("segment"), "moment")


@query("""
with e as (select user_id::varchar as feed, 'w' || ((day(ts) - 1) // 7) as session, event_id, event_type, value from events),
s as (select feed, session, 2 * min(event_id) as start, max(2 * event_id + 1) filter (event_type = 'signup' and value < 20) as close from e group by all)
select feed, session, case when close > start then 'stopped' when lead(start) over (partition by feed order by start) is not null then 'recovered' else 'active' end as status from s""")
def w03_sessions(t):
    return capture.session_states(_events(t)).select(F.col("feed_id").alias("feed"), F.col("session_id").alias("session"), "status")

"""Queries over events, orders and line items: sessions, joins in time, votes, rollups, streams' batch twins."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx
from ..operators import acoustics, records
from ..operators import timeline as tl
from ..operators import votes as vt
from .base import query

END = "timestamp '2024-02-01 00:00:00'"


def _end():
    return F.expr("timestamp_ntz'2024-02-01 00:00:00'")


def _gap_sql(keys: str, new: str) -> str:
    return f"""
with g as (select *, {new} as new from (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by {keys} order by ts, event_id) as gap from events)),
s as (select event_id, user_id, event_type, ts, cast(sum(case when new then 1 else 0 end) over (partition by {keys} order by ts, event_id) as bigint) as session from g)"""


@query(_gap_sql("user_id", "gap > 5400000000") + " select event_id, session from s")
def g10_sessions(t):
    return tl.sessions(t.events, ["user_id"], "ts", 5400, "event_id").select("event_id", "session")


@query(_gap_sql("event_type", "gap >= 10800000000") + " select event_type, session, count(*) as n, min(event_id) as first_id from s group by all")
def g12_import_sessions(t):
    s = tl.sessions(t.events, ["event_type"], "ts", 10800, "event_id", inclusive=False)
    return s.groupBy("event_type", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("select event_id, lag(event_id) over w as prev_id, lead(event_id) over w as next_id, row_number() over w as idx from events window w as (partition by user_id order by ts, event_id)")
def g15_pointers(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("event_id").over(w).alias("prev_id"), F.lead("event_id").over(w).alias("next_id"), F.row_number().over(w).cast("long").alias("idx"))


@query("""
select e.event_id, v.value from (select * from events where event_type <> 'view') e asof left join (select user_id, ts, value from events where event_type = 'view') v on e.user_id = v.user_id and e.ts >= v.ts""")
def j06_as_of(t):
    e = t.events
    return tl.as_of(e.where("event_type <> 'view'").drop("value"), e.where("event_type = 'view'"), ["user_id"], "ts", "value", "event_id").select("event_id", "value")


@query(f"""
with s as (select event_id as span, user_id, ts as start, coalesce(lead(ts) over (partition by user_id order by ts, event_id), {END}) as upto from events where event_type = 'error')
select p.event_id, s.span from events p join s on p.user_id = s.user_id and p.ts >= s.start and p.ts < s.upto where p.event_type = 'click'""")
def j07_in_item(t):
    e = t.events
    s = tl.intervals(e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("span")), ["user_id"], "ts", "span")
    s = s.select("user_id", "span", F.col("ts").alias("start"), F.coalesce("upto", _end()).alias("upto"))
    return tl.within(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), s, ["user_id"], "ts", "start", "upto", 86400).select("event_id", "span")


@query("""
with s as (select event_id as passage, user_id, ts as start, ts + interval 3601 second as upto from events where event_type = 'view')
select passage, count(p.event_id) as n, count(*) filter (p.event_type = 'error') as errors, round(sum(p.value), 4) as value
from s join events p on p.user_id = s.user_id and p.ts >= s.start and p.ts <= s.upto group by passage""")
def j08_passage_segments(t):
    e = t.events
    s = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("passage"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 3601 seconds")).alias("upto"))
    j = tl.within(e.select("user_id", "ts", "event_type", "value"), s, ["user_id"], "ts", "start", "upto", 3600, closed=True)
    return j.groupBy("passage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("value"))


@query("""
select user_id, event_type, round(coalesce(sum(s), 0) / 1e6, 3) as seconds from (
  select *, greatest(lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) - epoch_us(ts), 0) as s from events) group by all""")
def a08_seconds_by_role(t):
    s = tl.seconds_by(t.events, ["user_id"], "ts", "event_id", "event_type")
    return s.withColumn("seconds", F.round("seconds", 3))


@query("""
select 'day' as unit, strftime(ts, '%Y-%m-%d') as bucket, count(*) as n from events group by all union all
select 'week', strftime(date_trunc('day', ts) - to_days(cast(dayofweek(ts) as int)), '%Y-%m-%d'), count(*) from events group by all union all
select 'month', strftime(ts, '%Y-%m'), count(*) from events group by all""")
def a26_timeline(t):
    return tl.timeline(t.events, "ts")


@query("""
select user_id, round(sum(value * d) / sum(d), 6) as mean_logprob, max(value) as max_no_speech from (select user_id, value, event_id % 10 + 1 as d from events) group by user_id""")
def a39_weighted_mean(t):
    d = F.col("event_id") % 10 + 1
    return t.events.groupBy("user_id").agg(F.round(F.sum(F.col("value") * d) / F.sum(d), 6).alias("mean_logprob"), F.max("value").alias("max_no_speech"))


_SOUND = """
with v as (select vec_id as id, list_transform(embedding, lambda x: floor(x * 6000)::int / 32768.0::double) as x from embeddings),
f as (select id, x, list_transform(range(0, len(x) // 8), lambda k: 20 * log10(sqrt(list_sum(list_transform(x[k * 8 + 1 : k * 8 + 8], lambda y: y * y)) / 8 + 1e-12))) as frames from v),
l as (select id, round(len(x) / 400.0::double, 3) as duration_seconds, round(20 * log10(sqrt(list_sum(list_transform(x, lambda y: y * y)) / len(x) + 1e-12)), 2) as rms_dbfs, round(20 * log10(list_max(list_transform(x, lambda y: abs(y))) + 1e-12), 2) as peak_dbfs,
  round(len(list_filter(frames, lambda d: d > -33)) / len(frames)::double, 4) as speech_frame_ratio from f)"""


def _levels(t):
    """Vectors as sound: 400 samples a second."""
    half = lambda x: F.lpad(F.hex(F.floor(x.cast("double") * 6000).cast("long") + 65536), 5, "0")
    swapped = F.array_join(F.transform("embedding", lambda x: F.concat(F.substring(half(x), 4, 2), F.substring(half(x), 2, 2))), "")
    chunks = t.embeddings.select(F.col("vec_id").alias("id"), F.unhex(swapped).alias("pcm"), F.lit(400).alias("rate"), F.lit(1).alias("channels"))
    return acoustics.levels(chunks, loud=-33.0)


@query(f"""{_SOUND},
p as (select conv_id as id, turn, trim(text) as text, (length(text) % 10) / 10.0::double as no_speech, -(length(text) % 13) / 10.0::double as logprob from conversations),
k as (select id, string_agg(text, ' ' order by turn) as text from p where text <> '' and not (no_speech >= 0.6 and logprob < -1.1) and not (lower(text) in ('thank you.', 'you', '.', '...') and (no_speech > 0.45 or logprob < -1.0)) group by id),
g as (select id, case when rms_dbfs < -40 or speech_frame_ratio < 0.5 then 'acoustic_silence' when k.text is null then 'vad_or_nonspeech_filtered' end as gate_reason, text from l left join k using (id))
select id, case when gate_reason is null then 'speech' else 'no_speech' end as kind, case when gate_reason is null then md5(text) else md5('') end as text, gate_reason from g""")
def f11_speech_gate(t):
    n = F.length("text")
    pieces = t.conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), "text", ((n % 10) / 10).alias("no_speech"), (-(n % 13) / 10).alias("logprob"))
    return acoustics.heard(acoustics.gated(_levels(t), -40.0, 0.5), pieces, 0.6).withColumn("text", F.md5("text"))


@query("""
with o as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as cursor from events where event_type in ('view', 'click')),
f as (select event_id, user_id, ts from events where event_type = 'error')
select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) + coalesce((select max(cursor) from o where o.user_id = f.user_id), 0) as cursor from f""")
def w03_recovered_cursors(t):
    e = t.events
    published = e.where("event_type in ('view', 'click')").groupBy("user_id").agg(F.count(F.lit(1)).alias("last"))
    stranded = e.where("event_type = 'error'").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return stranded.join(published, "user_id", "left").select("user_id", "event_id", (F.col("k") + F.coalesce("last", F.lit(0))).alias("cursor"))


@query("""
select user_id, event_id, seconds from (
  select user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts) + 1000000 * cast(event_id % 60 as bigint)) over (partition by user_id order by ts, event_id)) / 1e6 as seconds from events) where seconds > 36000""")
def w04_gaps(t):
    end = F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 60)
    return tl.gaps(t.events, ["user_id"], "ts", end, "event_id", 36000).select("user_id", "event_id", "seconds")


@query("""
select user_id, event_id, seconds, rank from (
  select *, row_number() over (partition by user_id order by event_id desc) as rank from (
    select user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6 as seconds from events) where seconds > 3600) where rank <= 3""")
def w11_recent_gaps(t):
    g = tl.gaps(t.events, ["user_id"], "ts", F.col("ts"), "event_id", 3600)
    return g.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id"))).cast("long")).where("rank <= 3").select("user_id", "event_id", "seconds", "rank")


@query("""
select user_id, start, n, last - first >= 600000 or n > 1 as published from (
  select user_id, strftime(time_bucket(interval 10 second, ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, min(epoch_us(ts)) as first, max(epoch_us(ts)) as last from events group by all)""")
def w05_chunks(t):
    c = t.events.groupBy("user_id", F.window("ts", "10 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(fx.micros(F.col("ts"))).alias("first"), F.max(fx.micros(F.col("ts"))).alias("last"))
    return c.select("user_id", F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("start"), "n", ((F.col("last") - F.col("first") >= 600000) | (F.col("n") > 1)).alias("published"))


@query("select event_id, greatest(0, cast(event_id % 7 as bigint) * 400 - 500) as lag_ms from events")
def w06_lag(t):
    published = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 7) * 0.4 - 0.5)
    return t.events.select("event_id", F.greatest(F.lit(0), F.round((fx.micros(published) - fx.micros(F.col("ts"))) / 1000)).cast("long").alias("lag_ms"))


@query("select event_id, (select count(*) > 25 from events where event_id > 400) as has_more from events where event_id > 400 order by event_id limit 25")
def w07_cursor_page(t):
    return tl.page_after(t.events, "event_id", 400, 25).select("event_id", "has_more")


@query(f"""
select event_id, case when ts > {END} - interval 10 day then props end as props, ts <= {END} - interval 10 day as purged from events where ts > {END} - interval 20 day""")
def w08_retention(t):
    return tl.retained(t.events, "ts", _end(), 10 * 86400, 20 * 86400, ["props"]).select("event_id", "props", "purged")


@query(f"""
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events),
h as (select user_id, max(epoch_us(ts)) as last, avg(value) filter (k <= 20) as mean20, max(value) filter (k = 1) as last_lag, count(*) filter (event_type = 'error') as backlog from r group by user_id)
select user_id, (epoch_us({END}) - last) / 1e6 as staleness, backlog, round(backlog * mean20 + last_lag, 6) as lag_estimate, (epoch_us({END}) - last) / 1e6 <= 86400 and backlog < 20 as healthy from h""")
def w09_health(t):
    r = t.events.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    h = r.groupBy("user_id").agg(
        F.max(fx.micros(F.col("ts"))).alias("last"),
        F.avg(F.when(F.col("k") <= 20, F.col("value"))).alias("mean20"),
        F.max(F.when(F.col("k") == 1, F.col("value"))).alias("last_lag"),
        F.count_if(F.col("event_type") == "error").alias("backlog"),
    )
    stale = (fx.micros(_end()) - F.col("last")) / 1e6
    return h.select("user_id", stale.alias("staleness"), "backlog", F.round(F.col("backlog") * F.col("mean20") + F.col("last_lag"), 6).alias("lag_estimate"), ((stale <= 86400) & (F.col("backlog") < 20)).alias("healthy"))


_HAPPENED = {"error": ["upstream", "asr", "storage"], "view": ["audio", "queued", "taken"], "click": ["silence", "published", "drained"], "signup": ["connect", "start", "stop"]}


@query(f"""
with e as (select user_id, ts, event_id, case event_type {" ".join(f"when '{k}' then {v}[event_id % 3 + 1]" for k, v in _HAPPENED.items())} else 'other' end as e from events),
l as (select user_id, list(e order by ts, event_id) as l from e group by user_id)
select user_id, list_reduce(list_prepend('stopped', l), lambda s, e: case
  when e = 'start' then 'connecting' when e = 'published' then 'publishing' when e = 'upstream' then 'upstream_unavailable' when e = 'asr' then 'asr_failure' when e = 'storage' then 'storage_failure' when e = 'stop' then 'stopped'
  when e = 'connect' and s not in ('upstream_unavailable', 'asr_failure', 'storage_failure') then 'connecting' when e = 'audio' and s in ('connecting', 'upstream_unavailable') then 'receiving_audio'
  when e = 'queued' and s in ('receiving_audio', 'no_speech_detected') then 'transcription_pending' when e = 'taken' and s <> 'storage_failure' then 'transcription_pending'
  when e = 'silence' and s <> 'upstream_unavailable' then 'no_speech_detected' when e = 'drained' and s <> 'upstream_unavailable' then 'receiving_audio' else s end) as state from l""")
def w10_state(t):
    which = (F.col("event_id") % 3).cast("int")
    happened = F.lit("other")
    for k, v in _HAPPENED.items():
        happened = F.when(F.col("event_type") == k, F.get(F.array(*map(F.lit, v)), which)).otherwise(happened)
    return tl.feed_states(t.events.withColumn("happened", happened), "user_id", ["ts", "event_id"], "happened")


@query("""
with e as (select *, ts::date as session, epoch_us(ts) as us from events),
l as (select user_id, event_id, (us - lag(us + 1000000 * cast(event_id % 60 as bigint)) over w) / 1e6 as seconds,
  case when session <> lag(session) over w then 'worker_restart' when event_type = 'error' then 'read_timeout' else 'disconnect' end as reason from e window w as (partition by user_id order by ts, event_id))
select * from l where seconds > 1800 and (reason <> 'worker_restart' or seconds > 36000)""")
def w04_gap_reasons(t):
    e = t.events.withColumn("session", F.to_date("ts"))
    cause = F.when(F.col("event_type") == "error", "read_timeout").otherwise("disconnect")
    end = F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 60)
    return tl.coverage_gaps(e, ["user_id"], "session", "ts", end, "event_id", cause, 36000, 1800).select("user_id", "event_id", "seconds", "reason")


@query(f"""
select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) as segment_id
from (select event_id, sha1(unhex('{records.NAMESPACE_OID}') || encode(user_id || ':' || event_id || ':' || props)) as h from events)""")
def w12_segment_ids(t):
    return t.events.select("event_id", records.name_id(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"), "props")).alias("segment_id"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, user_id || chr(10) || chr(10) || json_extract_string(props, '$.k') as text from events")
def s07_flattened(t):
    e = t.events.withColumn("attributes", F.from_json("props", "k long"))
    return e.select("event_id", "attributes.k", F.concat_ws("\n\n", F.col("user_id").cast("string"), F.col("attributes.k").cast("string")).alias("text"))


_VOTES = "(select l_orderkey as vote, l_suppkey as member, case l_returnflag when 'A' then 'no' when 'N' then 'yes' else 'absent' end as cast_ from lineitem)"


def _votes(t):
    flag = F.col("l_returnflag")
    return t.lineitem.select(F.col("l_orderkey").alias("vote"), F.col("l_suppkey").alias("member"), F.when(flag == "A", "no").when(flag == "N", "yes").otherwise("absent").alias("cast"))


@query(f"""
with v as (select * from {_VOTES}), c as (select vote, count(*) filter (cast_ = 'yes') as yes, count(*) filter (cast_ = 'no') as no from v group by vote),
j as (select v.member, v.cast_, c.yes > 0 and c.no > 0 as contested, case when c.yes = 0 or c.no = 0 then null when c.yes < c.no then 'yes' when c.no < c.yes then 'no' end as losing from v join c using (vote)),
g as (select member, count(*) filter (cast_ <> 'absent') as votes, count(*) filter (cast_ = 'no') as no_votes, count(*) filter (cast_ <> 'absent' and contested) as contested,
  count(*) filter (cast_ = losing) as minority, count(*) filter (cast_ = 'absent') as not_voting from j group by member)
select *, case when votes > 0 then round(no_votes / votes, 6) end as no_rate, case when contested > 0 then round(minority / contested, 6) end as minority_rate from g""")
def a05_voting_record(t):
    return vt.record(_votes(t))


@query(f"""
select vote, count(*) filter (cast_ = 'yes') as yes, count(*) filter (cast_ = 'no') as no, abs(count(*) filter (cast_ = 'yes') - count(*) filter (cast_ = 'no')) as margin
from {_VOTES} group by vote having yes > 0 and no > 0""")
def a05_contested(t):
    return vt.contested(_votes(t))


@query(f"""
with c as (select vote from {_VOTES} group by vote having count(*) filter (cast_ = 'yes') > 0 and count(*) filter (cast_ = 'no') > 0),
v as (select vote, member, max(cast_) as cast_ from {_VOTES} where cast_ <> 'absent' and vote in (select vote from c) group by all)
select x.member as a, y.member as b, count(*) as n, count(*) filter (x.cast_ = y.cast_) as same, round(count(*) filter (x.cast_ = y.cast_) / count(*), 6) as agreement
from v x join v y on x.vote = y.vote and x.member < y.member group by all having count(*) >= 5""")
def a06_agreement(t):
    return vt.agreement(_votes(t))


@query("""
select l_returnflag, count(*) as n, case when count(*) > 3 and count(distinct l_quantity) > 1 and count(distinct l_extendedprice) > 1 then round(corr(l_quantity, l_extendedprice), 6) end as r from lineitem group by 1""")
def a12_correlation(t):
    ok = (F.count(F.lit(1)) > 3) & (F.min("l_quantity") < F.max("l_quantity")) & (F.min("l_extendedprice") < F.max("l_extendedprice"))
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.when(ok, F.round(F.corr("l_quantity", "l_extendedprice"), 6)).alias("r"))


@query("""
with i as (select l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) as k from lineitem)
select o_orderkey, count(l_orderkey) as items, round(coalesce(sum(l_quantity), 0), 2) as duration, coalesce(array_to_string(list(l_linenumber order by k) filter (k <= 3), ','), '') as longest
from orders left join i on o_orderkey = l_orderkey group by o_orderkey""")
def a10_meeting_rollup(t):
    i = t.lineitem.withColumn("k", F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "l_linenumber")))), lambda x: x["l_linenumber"].cast("string"))
    g = i.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("l_quantity"), 2).alias("duration"), F.array_join(top, ",").alias("longest"))
    return t.orders.select("o_orderkey").join(g, "o_orderkey", "left").select("o_orderkey", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("duration", F.lit(0.0)).alias("duration"), F.coalesce("longest", F.lit("")).alias("longest"))


@query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, coalesce(array_to_string(list(l_linenumber || ':' || l_partkey order by l_linenumber, l_partkey), chr(12)), '') as items
from orders left join lineitem on l_orderkey = o_orderkey where o_orderdate >= timestamp '1998-01-01' group by all""")
def s09_nested_meetings(t):
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    o = t.orders.where(F.col("o_orderdate") >= F.expr("timestamp_ntz'1998-01-01 00:00:00'")).join(items, "o_orderkey", "left")
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), "\f")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.coalesce(text, F.lit("")).alias("items"))


@query("""
select o_orderkey, count(l_orderkey) as lines, count(l_orderkey) <> 4 as exception from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def d12_integrity(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    o = t.orders.select("o_orderkey").join(n, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    return o.withColumn("exception", F.col("lines") != 4)


_AS_OF = "timestamp '1999-06-15 00:00:00'"


@query(f"""
select o_orderkey, case when o_orderpriority = '5-LOW' then 'cancelled' when o_orderpriority = '4-NOT SPECIFIED' then 'postponed' when o_orderstatus = 'F' and o_orderdate < {_AS_OF} then 'minutes available'
  when date_trunc('day', o_orderdate) = {_AS_OF} then 'today' when o_orderdate < {_AS_OF} then 'past' else 'upcoming' end as status from orders""")
def t36_meeting_status(t):
    as_of, d, p = F.expr("timestamp_ntz'1999-06-15 00:00:00'"), F.col("o_orderdate"), F.col("o_orderpriority")
    status = F.when(p == "5-LOW", "cancelled").when(p == "4-NOT SPECIFIED", "postponed").when((F.col("o_orderstatus") == "F") & (d < as_of), "minutes available")
    return t.orders.select("o_orderkey", status.when(F.date_trunc("day", d) == as_of, "today").when(d < as_of, "past").otherwise("upcoming").alias("status"))


@query("select strftime(max(o_orderdate), '%Y-%m-%d') as freshest, count(*) as entries, count(*) filter (o_orderdate > timestamp '2000-01-01') as late, max(o_orderdate) >= timestamp '1999-01-01' as fresh from orders")
def a34_freshness(t):
    late = F.count_if(F.col("o_orderdate") > F.expr("timestamp_ntz'2000-01-01 00:00:00'"))
    return t.orders.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("freshest"), F.count(F.lit(1)).alias("entries"), late.alias("late"), (F.max("o_orderdate") >= F.expr("timestamp_ntz'1999-01-01 00:00:00'")).alias("fresh"))


@query("select o_orderpriority as body, count(*) as meetings, array_to_string(list_sort(list(distinct strftime(o_orderdate, '%Y-%m-%d'))), ',') as dates from orders group by 1")
def a27_by_body(t):
    g = t.orders.groupBy(F.col("o_orderpriority").alias("body")).agg(F.count(F.lit(1)).alias("meetings"), F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("d"))
    return g.select("body", "meetings", F.array_join("d", ",").alias("dates"))


@query(f"{_SOUND} select * from l")
def a38_acoustic_metrics(t):
    return _levels(t)


@query("select user_id as service, max_by(value, event_id) as items, max(event_id) as last_id from events group by 1")
def a37_inventory(t):
    return t.events.groupBy(F.col("user_id").alias("service")).agg(F.max_by("value", "event_id").alias("items"), F.max("event_id").alias("last_id"))

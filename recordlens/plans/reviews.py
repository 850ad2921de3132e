"""Queries for checks of records against each other, item numbers and sessions."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx
from ..operators import alignment, checks
from ..operators import timeline as tl
from ..streaming import segments
from .base import query


@query("""
with a as (select o_custkey as c, o_orderpriority as p, cast(o_orderdate as date) as d from orders),
x as (select o_orderkey as id, o_custkey as c, o_orderpriority as p, cast(o_orderdate as date) + 14 as "to" from orders where o_orderstatus = 'P'),
f as (select id, min(d) as found from x join a using (c, p) where d between "to" and "to" + 60 group by id),
s as (select id, "to", found, case when found = "to" then 'honored' when "to" > (select max(d) from a) then 'target not in record' when found is not null then 'reappeared later'
  when "to" not in (select d from a) then 'no meeting' else 'not found' end as status from x left join f using (id))
select id, strftime("to", '%Y-%m-%d') as "to", status, status in ('no meeting', 'not found') as exception from s""")
def d09_postponements(t):
    day = F.to_date("o_orderdate")
    # Two tokens, one of them within the other: an order is found again only by both.
    tokens = F.array(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")), F.concat_ws(" ", F.lit("customer"), F.col("o_custkey").cast("string"), "o_orderpriority"))
    postponed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.date_add(day, 14).alias("to"), tokens.alias("tokens"))
    out = checks.postponements(postponed, t.orders.select(day.alias("date"), tokens.alias("tokens")), t.orders.select(day.alias("date")))
    return out.withColumn("to", F.col("to").cast("string"))


@query("""
with r as (select l_orderkey as grp, cast(l_shipdate as date) as d, l_linenumber % 3 + 1 as reading, case l_returnflag when 'R' then 'postponed' when 'A' then 'failed' else 'carried' end as result,
  l_partkey as number, l_linestatus = 'F' as substitute from lineitem),
g as (select grp, min(d) as first, max(d) as last, max(reading) as highest, count(distinct reading) as n, count(*) filter (result = 'postponed') as postponements,
  bool_or(reading = 3 and substitute) as late, bool_or(result = 'failed') as failed, bool_or(reading = 3 and result = 'carried') as adopted, max(number) as number from r group by grp),
f as (select *, concat_ws(',', case when n < highest then 'missing predecessor' end, case when postponements >= 2 then 'postponed repeatedly' end, case when late then 'substitute at third reading' end,
  case when failed then 'failed' end, case when not adopted and not failed and (select max(last) from g) - last > 120 then 'pending' end) as flags from g)
select grp, last - first as days, highest, postponements, adopted, number, flags, flags <> '' as exception from f""")
def d10_lifecycle(t):
    flag = F.col("l_returnflag")
    r = t.lineitem.select(
        F.col("l_orderkey").alias("grp"), F.to_date("l_shipdate").alias("date"), (F.col("l_linenumber") % 3 + 1).alias("reading"), F.when(flag == "R", "postponed").when(flag == "A", "failed").otherwise("carried").alias("result"),
        F.col("l_partkey").alias("number"), (F.col("l_linestatus") == "F").alias("substitute"),
    )
    return checks.lifecycle(r).select("grp", "days", "highest", "postponements", "adopted", "number", F.array_join("flags", ",").alias("flags"), "exception")


@query("""
with p as (select distinct l_orderkey as doc, l_partkey % 12 as m from lineitem where l_returnflag <> 'A'), h as (select distinct l_orderkey as doc, l_partkey % 12 as m from lineitem where l_linestatus = 'O'),
a as (select doc, string_agg(m, ',' order by m) as only_recorded from p where not exists (select 1 from h where h.doc = p.doc and h.m = p.m) group by doc),
b as (select doc, string_agg(m, ',' order by m) as only_heard from h where not exists (select 1 from p where h.doc = p.doc and h.m = p.m) group by doc)
select d.doc, coalesce(only_recorded, '') as only_recorded, coalesce(only_heard, '') as only_heard,
  d.doc in (select doc from h) and (only_recorded is not null or only_heard is not null) as exception
from (select distinct doc from p) d left join a using (doc) left join b using (doc)""")
def d14_attendance(t):
    line = t.lineitem.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 12).alias("m"), "l_returnflag", "l_linestatus")
    members = lambda rows, name: rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_set("m")), lambda m: m.cast("string")).alias(name))
    out = checks.attendance(members(line.where("l_returnflag <> 'A'"), "present"), members(line.where("l_linestatus = 'O'"), "heard"))
    return out.select("doc", F.array_join("only_recorded", ",").alias("only_recorded"), F.array_join("only_heard", ",").alias("only_heard"), "exception")


#: The matching-blocks ratio of sections, which have two to four digits: the longest common block, then what stands on its sides.
_RATIO = """
k as (select *, len(s) + len(o) as chars,
  list_filter(range(1, len(s) - 1), lambda i: contains(o, substr(s, i, 3))) as three, list_filter(range(1, len(s)), lambda i: contains(o, substr(s, i, 2)))[1] as two, list_filter(range(1, len(s) + 1), lambda i: contains(o, substr(s, i, 1)))[1] as one from p),
k2 as (select *, strpos(o, substr(s, two, 2)) as at2, substr(s, one + 1) as s1, substr(o, strpos(o, substr(s, one, 1)) + 1) as o1 from k),
k3 as (select *, list_filter(range(1, len(s1) + 1), lambda i: contains(o1, substr(s1, i, 1)))[1] as next from k2),
k4 as (select *, case when s = o then len(s) when len(three) > 0 then 3
  when two is not null then 2 + (list_has_any(string_split(substr(s, 1, two - 1), ''), list_filter(string_split(substr(o, 1, at2 - 1), ''), lambda c: c <> '')))::int
    + (list_has_any(string_split(substr(s, two + 2), ''), list_filter(string_split(substr(o, at2 + 2), ''), lambda c: c <> '')))::int
  when next is not null then 2 + (list_has_any(string_split(substr(s1, next + 1), ''), list_filter(string_split(substr(o1, strpos(o1, substr(s1, next, 1)) + 1), ''), lambda c: c <> '')))::int
  when one is not null then 1 else 0 end as matched from k3)"""


@query(f"""
with l as (select l_suppkey as doc, l_orderkey * 8 + l_linenumber as ord, l_returnflag as role, l_linenumber || '-' || (1 + l_partkey % 2) as ch, (10 + floor(l_extendedprice)::bigint % 1300)::varchar as s from lineitem),
f as (select * from (select *, row_number() over (partition by doc, ch, s, role order by ord) as k from l where role <> 'N') where k = 1),
o as (select distinct doc, ch, s as o from l where role = 'N'),
p as (select f.doc, f.ord, f.role, f.ch, f.s, o.o from f join o on f.doc = o.doc and f.ch = o.ch), {_RATIO},
n as (select doc, ord, role, ch, s, min((case when o = s then 0 when starts_with(o, s) then 1 when replace(o, '0', '') = replace(s, '0', '') then 2 else 3 end, ch || '-' || o)) as best
  from k4 where starts_with(o, s) or replace(o, '0', '') = replace(s, '0', '') or 2.0 * matched / chars >= 0.75 group by all)
select f.doc, f.ord, f.role, f.ch || '-' || f.s as citation, case when best is null then 'ungrounded' when best[1] = 0 then 'exact' else 'close' end as status, best[2] as official, best is null as exception
from f left join n using (doc, ord, role, ch, s)""")
def d15_grounded_citations(t):
    section = (F.floor("l_extendedprice") % 1300 + 10).cast("string")
    citation = F.concat_ws("-", F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 2 + 1).cast("string"), section)
    c = t.lineitem.select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("role"), citation.alias("citation"))
    return checks.grounded_citations(c.where("role <> 'N'"), c.where("role = 'N'"))


_BARE = "l_returnflag = 'R' and l_quantity < 5"


@query(f"""
with s as (select l_orderkey as doc, list_sort(list_distinct(list(l_linenumber) filter (l_returnflag = 'A'))) as a, list_sort(list_distinct(list(l_linenumber) filter (l_returnflag = 'N'))) as m,
  list_sort(list_distinct(list(l_linenumber) filter (l_returnflag = 'R' and not ({_BARE})))) as v, coalesce(bool_or({_BARE}), false) as cited_without_subsection, coalesce(bool_or(l_returnflag = 'R' and l_linenumber = 3), false) as litigation from lineitem group by l_orderkey),
c as (select *, len(list_filter([a, m, v], lambda x: len(x) > 0)) as n, len(list_distinct(list_filter([a, m, v], lambda x: len(x) > 0))) = 1 as alike from s)
select doc, n > 0 and alike as consistent, concat_ws(',', case when n = 0 then 'no basis cited' end, case when coalesce(len(a), 0) = 0 then 'none on the agenda' end, case when coalesce(len(m), 0) = 0 then 'none in the minutes' end, case when n > 1 and not alike then 'bases differ' end) as notes,
  not alike as exception, cited_without_subsection, case when litigation then '3' else '' end as purposes from c""")
def d16_session_basis(t):
    n = F.col("l_linenumber").cast("string")
    roman = F.get(F.array(*map(F.lit, checks.ROMAN)), F.col("l_linenumber") - 1)
    said = F.when(F.expr(_BARE), F.lit("under 16-4-405 as noted")).otherwise(F.concat(F.when(F.col("l_partkey") % 2 == 0, "pursuant to 164405A").otherwise(">> [music] 16 4 405 a "), n))
    said = F.concat(said, F.when(F.col("l_linenumber") == 3, " on litigation").otherwise(" to discuss"))
    listed = lambda flag, c: F.array_join(F.collect_list(F.when(F.col("l_returnflag") == flag, c)), "; ")
    texts = t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(
        listed("A", F.concat(F.lit("W.S. 16-4- 405(a)("), roman, F.lit(")"))).alias("agenda"), listed("N", F.concat(F.lit("closed under 16-4-405(A)("), n, F.lit(")"))).alias("minutes"), listed("R", said).alias("speech")
    )
    out = checks.sessions_of(texts)
    return out.select("doc", "consistent", F.array_join("notes", ",").alias("notes"), "exception", "cited_without_subsection", F.array_join(F.transform("purposes", lambda p: p.cast("string")), ",").alias("purposes"))


@query()
def g11_threads(t):
    s = tl.sessions(t.events, ["user_id"], "ts", 6 * 3600, "event_id")
    of = ["user_id", "session"]
    ends = s.groupBy(*of).agg(F.min(fx.micros(F.col("ts"))).alias("a"), F.max(fx.micros(F.col("ts"))).alias("b"))
    words = s.select(*of, F.concat_ws(" ", "event_type", (F.get_json_object("props", "$.k").cast("int") % 10).cast("string")).alias("term")).groupBy(*of, "term").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counts = words.groupBy(*of).agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("counts"))
    second = lambda c: F.floor(F.col(c) / 1_000_000).alias({"a": "start", "b": "end"}[c])
    return alignment.merged_threads(ends.join(counts, of).select(F.col("user_id").alias("owner"), F.col("session").cast("int").alias("session"), second("a"), second("b"), "counts"))


_UNITS, _TENS = list(alignment.UNITS), list(alignment.TENS)


@query(f"""
with s as (select 'order' as kind, o_orderkey as id, 0 as turn, o_orderpriority as said from orders union all select 'turn', conv_id, turn, text from conversations),
w as (select kind, id, turn, string_split(trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')), ' ') as w from s),
n as (select *, 10 + 10 * nullif(list_position({_TENS}, w[1]), 0) as ten, nullif(list_position({_UNITS}, w[1]), 0) as unit, nullif(list_position({_UNITS}, w[2]), 0) as behind from w),
v as (select *, coalesce(behind < 10, false) and ten is not null as pair from n),
x as (select kind, id, turn, case when regexp_matches(w[1], '^[0-9]+[a-z]?$') then upper(w[1]) when pair then cast(ten + behind as varchar) when ten is not null then cast(ten as varchar) else cast(unit as varchar) end as value,
  coalesce(case when regexp_matches(w[1], '^[0-9]+[a-z]$') then '' when pair then w[3] else w[2] end, '') as after from v)
select kind, id, turn, case when regexp_matches(after, '^[b-z]$') then value || upper(after) else value end as number from x""")
def t25_item_numbers(t):
    s = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("turn"), F.col("o_orderpriority").alias("said"))
    s = s.unionByName(t.conversations.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", F.col("text").alias("said")))
    return s.select("kind", "id", "turn", alignment.item_number(F.col("said")).alias("number"))


@query("""
with g as (select user_id, epoch_us(ts) as us, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) > 5400000000 as new from events),
s as (select user_id, us, sum(case when new then 1 else 0 end) over (partition by user_id order by us) as k from g)
select user_id, count(*) as turns, min(us) as first, max(us) as last from s group by user_id, k""")
def w13_live_sessions(t):
    s = segments.live_sessions(t.events, "ts", "user_id")
    return s.select("user_id", "turns", fx.micros(F.col("first_ts")).alias("first"), fx.micros(F.col("last_ts")).alias("last"))


_WINDOWS = """
with e as (select user_id, event_id, ts, event_type, value, json_extract_string(props, '$.k')::int as k from events),
i as (select user_id as doc, event_id as item, ts as start, coalesce(lead(ts) over (partition by user_id order by ts, event_id), timestamp '2024-02-02') as upto, k,
  [('t' || (k % 11)), ('u' || (k % 3)), ('v' || (event_id % 2))] as tokens, case when k % 3 = 0 then [] else list_transform(range(0, k % 4 + 1), lambda j: 'Ann Speak' || chr((97 + (k + j) % 100 % 26)::int) || chr((97 + (k + j) % 100 // 26)::int) || ', of Town') end as listed from e where event_type = 'signup'),
s as (select user_id as doc, ts, event_type || ' by speak' || chr(97 + k % 26) || chr(97 + k // 26) || ' said' as text, event_type = 'click' as intro from e where event_type <> 'signup'),
w as (select i.doc, i.item, s.text, s.intro from i join s on s.doc = i.doc and s.ts >= i.start and s.ts < i.upto),
n as (select doc, item, unnest(listed) as name, generate_subscripts(listed, 1) as p from i),
h as (select doc, item, count(distinct p) as heard from n join w using (doc, item) where contains(w.text, lower(regexp_extract(name, '^Ann ([A-Za-z]+)', 1))) group by all),
r as (select a.doc, a.item, arg_min(b.item, (-round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))), 6), b.item)) as related
  from i a join i b on a.doc = b.doc where len(a.listed) = 0 and len(b.listed) > 0 and round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))), 6) >= 0.3 group by all),
j as (select i.doc, i.item, len(i.listed) as listed, count(w.intro) filter (w.intro) as introduced from i left join w using (doc, item) group by i.doc, i.item, i.listed)"""


@query(f"""{_WINDOWS}
select doc, item, listed, introduced, coalesce(heard, 0) as heard, related, ((listed >= 2 and introduced = 0) or (listed = 0 and introduced >= 2) or abs(listed - introduced) >= 4) and related is null as exception
from j left join h using (doc, item) left join r using (doc, item) where listed > 0 or introduced > 0""")
def d13_commenters_in_window(t):
    k = F.get_json_object("props", "$.k").cast("int")
    text = lambda c: c.cast("string")
    spoken = lambda x: F.concat(F.char((97 + x % 26).cast("long")), F.char((97 + F.floor(x / 26)).cast("long")))
    e = t.events.withColumn("k", k)
    until = F.coalesce(F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")), F.expr("timestamp_ntz'2024-02-02'"))
    names = F.transform(F.sequence(F.lit(0), F.col("k") % 4), lambda j: F.concat(F.lit("Ann Speak"), spoken((F.col("k") + j) % 100), F.lit(", of Town")))
    tokens = F.array(F.concat(F.lit("t"), text(F.col("k") % 11)), F.concat(F.lit("u"), text(F.col("k") % 3)), F.concat(F.lit("v"), text(F.col("event_id") % 2)))
    listed = F.when(F.col("k") % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(names)
    items = e.where("event_type = 'signup'").select(F.col("user_id").alias("doc"), F.col("event_id").alias("item"), F.col("ts").alias("start"), until.alias("end"), tokens.alias("tokens"), listed.alias("listed"))
    segments = e.where("event_type <> 'signup'").select(F.col("user_id").alias("doc"), "ts", F.concat("event_type", F.lit(" by speak"), spoken(F.col("k")), F.lit(" said")).alias("text"), (F.col("event_type") == "click").alias("intro"))
    out = checks.commenters_in_window(items, segments, items.select("doc", F.col("item").alias("ord"), "tokens", "listed"))
    return out.select("doc", "item", F.col("listed").cast("long"), "introduced", "heard", "related", "exception")

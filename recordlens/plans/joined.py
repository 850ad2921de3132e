"""Queries for entities, dated matches, outcomes, names of threads and report tables."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import shared
from ..functions import text as fx
from ..operators import checks
from ..operators import lexicon as lx
from ..operators import similarity as sm
from ..operators import threads
from ..sources import files, sinks
from .base import query

_TYPES = {"illegal": "the ", "unfair": "of "}
_SENT = r"""
with s as (select doc_id, unnest(string_split_regex(regexp_replace(text, '([.?!])\s+', '\1>>', 'g'), '>>')) as s from documents),
c as (select doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) as s from s where true),
f as (select doc_id, s from c where length(s) >= 13 and (regexp_matches(s, '(?i)the ') or regexp_matches(s, '(?i)of ')))"""


@query(r"""
with e as (select doc_id, 'official' as kind, unnest(regexp_extract_all(text, '(?:Of|The|Is) [a-z]+ing')) as value from documents union all
  select doc_id, 'statute', unnest(regexp_extract_all(text, '[a-z]+tion, [a-z]+')) from documents)
select doc_id, kind, value, count(*) as n from e group by all""")
def t04_entities(t):
    return lx.entities(t.documents, {"official": "(?:Of|The|Is) [a-z]+ing", "statute": "[a-z]+tion, [a-z]+"})


@query(f"{_SENT} select doc_id, s as sentence, count(*) as n from f where contains(lower(s), 'tion') and length(s) <= 120 group by all")
def f03_claim_filter(t):
    c = lx.claims(t.documents, _TYPES, "(?i)(in|on) ").where(F.lower("sentence").contains("tion") & (F.length("sentence") <= 120))
    return c.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id from documents where not regexp_matches(text, '(?i)^(the|of|and|la|de) ') and length(text) > 60")
def f09_substantive_items(t):
    return t.documents.where(~F.col("text").rlike("(?i)^(the|of|and|la|de) ") & (F.length("text") > 60)).select("doc_id")


_TOK = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4))"


@query(f"""
with d as (select doc_id, cast(doc_id % 40 as int) as day, {_TOK} as t from documents), x as (select doc_id, day, len(t) as n, unnest(t) as w from d),
c as (select a.doc_id as id, b.doc_id as other, a.day, b.day as other_day, a.n as an, b.n as bn, count(*) as c from x a join x b on a.w = b.w and b.day between a.day + 1 and a.day + 10 group by all),
s as (select id, other, other_day, round(c / (an + bn - c), 6) as similarity from c)
select id, other, similarity, rank from (select *, row_number() over (partition by id order by other_day, similarity desc, other) as rank from s where similarity >= 0.4) where rank <= 2""")
def j05_dated_titles(t):
    d = t.documents.select("doc_id", (F.col("doc_id") % 40).cast("int").alias("day"), F.array_distinct(fx.tokens(F.col("text"), 4)).alias("tokens"))
    return sm.dated_matches(d.withColumnRenamed("doc_id", "id"), 1, 10, 0.4, 2)


@query("""
select o.o_orderkey, l.l_linenumber, l.l_suppkey, case o.o_orderstatus when 'F' then 'carried' when 'O' then 'pending' else 'failed' end as outcome, c.c_mktsegment as body
from lineitem l left join orders o on o.o_orderkey = l.l_orderkey left join customer c on c.c_custkey = o.o_custkey where l.l_returnflag = 'A'""")
def j10_claim_outcomes(t):
    outcome = F.when(F.col("o_orderstatus") == "F", "carried").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    j = t.lineitem.where("l_returnflag = 'A'").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("o_orderkey", "l_linenumber", "l_suppkey", outcome.alias("outcome"), F.col("c_mktsegment").alias("body"))


@query(r"""
with n as (select distinct source, lower(split_part(text, ' ', 1)) as w from documents where length(split_part(text, ' ', 1)) > 3),
h as (select distinct source, unnest(string_split(lower(text), ' ')[2:]) as w from documents)
select n.source, count(*) as listed, count(h.w) as heard_names from n left join h using (source, w) group by n.source""")
def j15_roster_heard(t):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    listed = t.documents.where(F.length(first) > 3).select("source", F.lower(first).alias("w")).distinct()
    words = t.documents.select("source", F.explode(F.slice(F.split(F.lower("text"), " "), 2, 1 << 30)).alias("w"))
    return checks.roster_heard(listed, words, ["source", "w"]).groupBy("source").agg(F.count(F.lit(1)).alias("listed"), F.count_if("heard").alias("heard_names"))


@query("select event_type as role, case when value < 5 then 'ungrounded' when value < 15 then 'close' else 'exact' end as status, count(*) as n from events group by all")
def a15_status_tallies(t):
    status = F.when(F.col("value") < 5, "ungrounded").when(F.col("value") < 15, "close").otherwise("exact")
    return t.events.groupBy(F.col("event_type").alias("role"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


_LABELS = [("thth|shth", "Twin sounds"), ("onsh", "On"), ("wh (?:an|in)|handsh", "Two words"), ("tion", "Actions")]
_BROAD = {"Actions", "On"}
_NAME_STOP = ["the", "and", "that", "with", "was", "for"]
_QUOTED = ", ".join(f"'{w}'" for w in _NAME_STOP)
_VOTES = " union all ".join(
    f"select thread, {k} as k, '{label}' as label, sum(len(regexp_extract_all(text, '(?i){p}')) * times) * {(2.0 if ' ' in p or '|' in p else 1.0) * (0.35 if label in _BROAD else 1.0)} as v from anchor group by thread" for k, (p, label) in enumerate(_LABELS)
)


@query(rf"""
with t as (select conv_id as thread, turn, text, row_number() over (partition by conv_id order by turn) as a, row_number() over (partition by conv_id order by turn desc) as z from conversations),
anchor as (select *, (a <= 8)::int + (z <= 4)::int as times from t where a <= 8 or z <= 4),
v as (select thread, arg_max((label, round(v, 6)), (round(v, 6), -k)) as best from ({_VOTES}) where v > 0 group by thread),
s as (select thread, a, times, unnest(l) as sentence, generate_subscripts(l, 1) as s from (select *, string_split_regex(text, '[.!?\n]') as l from anchor)),
w as (select *, list_filter(regexp_extract_all(sentence, '[\pL\pN_]+'), lambda y: regexp_matches(y, '^[A-Z][a-zA-Z]{{2,}}$')) as w from s),
i as (select thread, a, s, times, unnest(l) as word, generate_subscripts(l, 1) as k from (select *, case when starts_with(trim(sentence), coalesce(w[1], chr(1))) then w[2:] else w end as l from w)),
p as (select thread, word, sum(times) as n, min((a, s, k)) as at_ from i where lower(word) not in ({_QUOTED}) group by all having sum(times) >= 2),
pn as (select thread, string_agg(word, ' / ' order by r) as nouns from (select *, row_number() over (partition by thread order by n desc, at_) as r from p) where r <= 2 group by thread),
x as (select thread, text, list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]+'), lambda x: len(x) > 2 and x not in ({_QUOTED})) as w from t),
m as (select thread, unnest(w) as term, 1.0 as n from x union all select thread, unnest(list_transform(w[1:len(w) - 1], lambda y, i: y || ' ' || w[i + 1])), 1.0 from x
  union all select thread, unnest(list_filter(list_transform(list_filter(regexp_extract_all(text, '[\pL\pN_]+'), lambda y: regexp_matches(y, '^[A-Z][a-z]{{3,}}$')), lambda y: lower(y)), lambda y: y not in ({_QUOTED}))), 1.5 from x),
c as (select thread, term, sum(n) as n from m group by all),
b as (select *, row_number() over (partition by thread order by n desc, term) as k, sum(n) over (partition by thread) as total from c),
f as (select thread, arg_min((term, n / total), k) filter (contains(term, ' ')) as pair, string_agg(term, ' / ' order by k) filter (k <= 2) as words from b where k <= 12 group by thread),
up as (select thread, case when pair[2] >= 0.02 then pair[1] else words end as salient from f),
cap as (select thread, string_agg(upper(y[1]) || y[2:], ' ' order by o) as salient from (select thread, unnest(string_split(salient, ' ')) as y, generate_subscripts(string_split(salient, ' '), 1) as o from up) group by thread)
select d.thread as conv_id, coalesce(case when v.best[1] not in ('Actions', 'On') or v.best[2] >= 4 then v.best[1] end, pn.nouns, cap.salient, 'Untitled thread') as name
from (select distinct thread from t) d left join v using (thread) left join pn using (thread) left join cap using (thread)""")
def a19_thread_names(t):
    turns = t.conversations.select(F.col("conv_id").alias("thread"), F.col("turn").alias("ord"), "text")
    return threads.thread_names(turns, _LABELS, _BROAD, _NAME_STOP).withColumnRenamed("thread", "conv_id")


@query("select doc_id, upper(left(text, 5)) = upper(left(lang, 5)) as pdf, starts_with(text, 'The') as supported from documents")
def t37_signatures(t):
    return t.documents.select("doc_id", (F.upper(F.left("text", F.lit(5))) == F.upper(F.left("lang", F.lit(5)))).alias("pdf"), F.col("text").startswith("The").alias("supported"))


@query("""
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, null as line from events where event_id % 10 <> 0
union all select event_id, null, '{broken ' || props || event_id from events where event_id % 10 = 0""")
def s20_dead_letters(t):
    # Each line has its event's number behind it where it is broken, and in it where it is not.
    whole = F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
    broken = F.concat(F.lit("{broken "), "props", F.col("event_id").cast("string"))
    lines = t.events.select(F.when(F.col("event_id") % 10 == 0, broken).otherwise(whole).alias("value"))
    good, bad = shared.scratch(t.spark, "records"), shared.scratch(t.spark, "dead-letters")
    sinks.write_dead_letters(lines, "event_id long, k long", good, bad)
    records = files.read_json_lines(t.spark, good, "event_id long, k long").select("event_id", "k", F.lit(None).cast("string").alias("line"))
    dead = files.read_json_lines(t.spark, bad, "line string, error string")
    return records.unionByName(dead.select(F.regexp_extract("line", r"(\d+)$", 1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("k"), "line"))


@query("select doc_id, lang, source, md5(replace(text, chr(10), ' ')) as text from documents")
def s02_csv_round_trip(t):
    path = shared.scratch(t.spark, "csv")
    sinks.write_csv(t.documents.select("doc_id", "text", "lang", "source"), path)
    return files.read_csv(t.spark, path).select(F.col("doc_id").cast("long"), "lang", "source", F.md5("text").alias("text"))


@query("select doc_id, md5(text) as text, n_chars, false as corrupt from documents union all select doc_id, null, null, true from documents where n_chars % 7 = 0")
def s03_json_round_trip(t):
    path = shared.scratch(t.spark, "lines")
    whole = t.documents.select(F.to_json(F.struct("doc_id", "text", "n_chars")).alias("value"))
    cut = t.documents.where("n_chars % 7 = 0").select(F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string")).alias("value"))
    whole.unionByName(cut).write.text(path)
    back = files.read_json_lines(t.spark, path, "doc_id long, text string, n_chars long")
    corrupt = F.col("_corrupt_record").isNotNull()
    number = F.when(corrupt, F.regexp_extract("_corrupt_record", r"(\d+)", 1).cast("long")).otherwise(F.col("doc_id"))
    return back.select(number.alias("doc_id"), F.when(~corrupt, F.md5("text")).alias("text"), F.when(~corrupt, F.col("n_chars")).alias("n_chars"), corrupt.alias("corrupt"))


@query("""
with f as (select conv_id, arg_min(role, turn) as opened from conversations group by 1)
select conv_id, opened, string_agg(role || ': ' || text, chr(10) order by turn) as transcript, count(*) as turns from conversations join f using (conv_id) group by all""")
def s23_thread_files(t):
    path = shared.scratch(t.spark, "threads")
    opened = t.conversations.groupBy("conv_id").agg(F.min_by("role", "turn").alias("opened"))
    turns = t.conversations.join(opened, "conv_id").select(F.col("conv_id").alias("thread"), F.col("turn").alias("ord"), "role", "text", "opened")
    sinks.write_threads(turns, path, "opened")
    return t.spark.read.schema("thread long, transcript string, turns long, opened string").json(path).select(F.col("thread").alias("conv_id"), "opened", "transcript", "turns")


@query(r"""
select rank, doc_id, n_chars, regexp_replace(substr(text, 1, 100), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g') as extract from (
  select row_number() over (order by n_chars desc, doc_id) as rank, * from documents) where rank <= 40""")
def s24_report_extracts(t):
    top = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(40)
    rank = F.row_number().over(W.partitionBy().orderBy(F.desc("n_chars"), "doc_id")).cast("long")  # of 40 rows
    return top.select(rank.alias("rank"), "doc_id", "n_chars", F.regexp_replace(F.col("text").substr(1, 100), fx.EMAIL, "[email]").alias("extract"))


@query("""
with v as (select l_orderkey as entry, l_linenumber as k, l_suppkey, l_partkey, l_returnflag from lineitem)
select entry, max_by(case l_returnflag when 'A' then 'failed' else 'carried' end, (k, l_suppkey, l_partkey, l_returnflag)) as final, count(*) as votes from v group by entry""")
def d18_final_votes(t):
    result = F.when(F.col("l_returnflag") == "A", "failed").otherwise("carried")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("entry")).agg(F.max_by(result, F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")).alias("final"), F.count(F.lit(1)).alias("votes"))


@query(f"""
with a as (select item_id as id, length(text) % 7 as meeting, {_TOK} as t from benchmark), m as (select doc_id as id, length(text) % 7 as meeting, length(text) as chars, {_TOK} as t from documents),
h as (select meeting from m group by meeting having sum(chars) >= 400),
x as (select id, meeting, len(t) as n, unnest(t) as w from a), y as (select id, meeting, len(t) as n, unnest(t) as w from m),
s as (select x.id, y.id as other, count(*) as c, x.n, y.n as m from x join y using (meeting, w) group by x.id, y.id, x.n, y.n),
b as (select id, max(round(c / (n + m - c), 6)) filter (round(c / (n + m - c), 6) >= 0.34) as similarity, max(round(c / n, 6)) filter (round(c / n, 6) >= 0.6) as share from s group by id)
select a.id as left_id, similarity, share, similarity is null and share is null as exception from a join h using (meeting) left join b using (id)""")
def d11_agenda_coverage(t):
    tok, meeting = F.array_distinct(fx.tokens(F.col("text"), 4)), (F.length("text") % 7).alias("meeting")
    a = t.benchmark.select(F.col("item_id").alias("id"), meeting, tok.alias("tokens"))
    # Here the title is the whole text; it is cut into tokens once.
    m = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), meeting, tok.alias("tokens"), F.length("text").alias("chars")).withColumn("raw", F.col("tokens"))
    return checks.coverage(a, m).select("left_id", "similarity", "share", "exception")


@query("select doc_id, md5(text) as text from documents where length(trim(text)) > 0")
def s19_rebuilt(t):
    # A sink of other records is replaced, by records some of which come twice.
    path = shared.scratch(t.spark, "sink")
    t.documents.where("n_chars % 2 = 0").select("doc_id", F.lit("old").alias("text")).write.json(path)
    records = t.documents.select("doc_id", "text")
    sinks.rebuild(records.unionByName(records.where("doc_id % 3 = 0")), path, "doc_id", "text")
    return files.read_json_lines(t.spark, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("text"))

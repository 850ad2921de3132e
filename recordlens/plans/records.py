"""Queries for folds over documents, claims, checks and segment admission."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx
from ..operators import folds, minutes, names, records
from ..operators import lexicon as lx
from .base import query


def _lines(t):
    return t.documents.select("doc_id", F.split("text", "\n").alias("l"))


@query(r"""
with l as (select doc_id, string_split(text, chr(10)) as l from documents),
c as (select doc_id, unnest(range(1, len(l))) as i, l from l),
e as (select doc_id, i, case
    when i = 1 then l[1:2] when l[i - 1] = l[i] and l[i] = l[i + 1] then [] else [l[i + 1]] end as new from c)
select doc_id, cast(i as integer) as ord, cast(len(new) as integer) as added, array_to_string(new, '|') as lines from e where len(new) > 0""")
def g01_caption_lines(t):
    cues = _lines(t).where(F.size("l") > 1).select(F.col("doc_id").alias("doc"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.slice("l", i, 2))).alias("k", "lines"))
    out = folds.caption_lines(cues.select("doc", (F.col("k") + 1).alias("ord"), F.lit(0.0).alias("start"), "lines"))
    g = out.groupBy("doc", "ord").agg(F.count(F.lit(1)).cast("int").alias("added"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "|").alias("lines"))
    return g.select(F.col("doc").alias("doc_id"), "ord", "added", "lines")


@query()
def g02_packed_paragraphs(t):
    return folds.packed_words(t.documents.select(F.col("doc_id").alias("doc"), "text"), 40).withColumnRenamed("doc", "doc_id")


@query(r"""
with s as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents),
c as (select doc_id, k, trim(regexp_replace(s, '\s+', ' ', 'g')) as s from s)
select doc_id, count(*) filter (s <> '') as segments, coalesce(max(length(s)) filter (s <> ''), 0) as longest from c group by doc_id""")
def g03_timestamped_segments(t):
    stamped = F.concat(F.lit("# head\n---\n[00:00:00] "), F.regexp_replace("text", "\n", "\n[00:00:05] "))
    s = t.documents.select("doc_id", folds.timestamped_segments(stamped).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("segments"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x["text"]))), F.lit(0)).cast("long").alias("longest"))


@query()
def g05_passages(t):
    stamped = F.concat(F.lit("---\n[00:00:00] "), F.regexp_replace("text", "\n", "\n[00:00:05] "))
    return folds.passages(t.documents.select(F.col("doc_id").alias("doc"), stamped.alias("text")))


@query("""
with c as (select conv_id, turn, strpos(lower(text), 'thing') as a, strpos(lower(text), 'ation') as z, role = 'system' as anchor from conversations),
s as (select *, case when a > 0 and a > z then 1 when z > 0 then 0 end as after from c),
b as (select *, coalesce(last_value(after ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) = 1 as before from s)
select conv_id, turn, case when anchor then 'agenda_reading' when a > 0 then 'public_comment' when z > 0 and z <= 80 then 'official' when before then 'public_comment' else 'official' end as role from b""")
def g07_roles(t):
    s = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), "text", (F.col("role") == "system").alias("anchor"))
    return folds.roles(s, "(?i)thing", "(?i)ation").select(F.col("doc").alias("conv_id"), F.col("seq").alias("turn"), "role")


@query()
def g13_alignment_chain(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    c = t.events.select(F.col("user_id").alias("doc"), F.row_number().over(w).alias("seq"), (F.col("event_id") * 7 % 50).cast("int").alias("item"), F.col("value").alias("score"))
    return folds.chain(c)


@query()
def g14_lifecycle_groups(t):
    tok = F.array_distinct(fx.tokens(F.col("text"), 4))
    rows = t.documents.select(F.concat_ws("/", "lang", "source").alias("block"), F.col("doc_id").cast("int").alias("ord"), (F.col("doc_id") / 10).cast("int").alias("day"), tok.alias("tokens"))
    return folds.greedy_groups(rows, 0.2, 200)


@query("""
with e as (select event_id, user_id, ts, event_id - event_id % 3 as sid, row_number() over (order by event_id) as arrival from events)
select event_id from (select event_id, row_number() over (partition by sid order by arrival) as k from e) where k = 1""")
def w01_admission(t):
    e = t.events.select("event_id", F.col("user_id").alias("feed"), (F.col("event_id") - F.col("event_id") % 3).alias("sid"))
    return records.first_arrivals(e, ["sid"], "event_id").select("event_id")


@query("select event_id, user_id, row_number() over (partition by user_id order by event_id) as cursor from events")
def w02_publication(t):
    numbered = t.events.select("event_id", "user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("sequence_no"))
    return records.contiguous(numbered, "user_id", "sequence_no").select("event_id", "user_id", (F.col("sequence_no") + 1).alias("cursor"))


_AUTH = r"'[A-Z][a-z]+tion'"


@query(rf"""
with s as (select conv_id, turn, text, lag(text) over w as p, lead(text) over w as n from conversations window w as (partition by conv_id order by turn)),
j as (select conv_id, turn, concat_ws(' ', p, text, n) as t, contains(text, ' the ') and contains(text, ' of ') as strong from s)
select conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(t, {_AUTH}))), ',') as authorities, case when strong or len(regexp_extract_all(t, {_AUTH})) > 0 then 'strong' else 'weak' end as strength from j""")
def d07_authorities(t):
    a = records.authorities(t.conversations, ["conv_id"], "turn", "text", {"instrument": "[A-Z][a-z]+tion"})
    strong = (F.col("text").contains(" the ") & F.col("text").contains(" of ")) | (F.size("authorities") > 0)
    return a.select("conv_id", "turn", F.array_join(F.transform("authorities", lambda x: x["value"]), ",").alias("authorities"), F.when(strong, "strong").otherwise("weak").alias("strength"))


_CLAIMS = r"""
with s as (select doc_id, unnest(string_split_regex(regexp_replace(text, '([.?!])\s+', '\1>>', 'g'), '>>')) as s from documents),
c as (select doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) as s from s),
k as (select doc_id, regexp_matches(s, '(?i)the ') as illegal, regexp_matches(s, '(?i)of ') as unfair from c where length(s) >= 13),
f as (select * from k where illegal or unfair)"""


@query(f"""{_CLAIMS}, u as (select 'illegal' as type, source from f join documents using (doc_id) where illegal union all select 'unfair', source from f join documents using (doc_id) where unfair)
select * from (select type, source, claims, row_number() over (partition by type order by claims desc, source) as rank from (select type, source, count(*) as claims from u group by all)) where rank <= 12""")
def a14_claims_by_type(t):
    c = lx.claims(t.documents, {"illegal": "the ", "unfair": "of "}, "(?i)(in|on) ").join(t.documents.select("doc_id", "source"), "doc_id")
    one = F.filter(F.array(F.when(F.col("illegal"), F.lit("illegal")), F.when(F.col("unfair"), F.lit("unfair"))), lambda x: x.isNotNull())
    g = c.select("source", F.explode(one).alias("type")).groupBy("type", "source").agg(F.count(F.lit(1)).alias("claims"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("type").orderBy(F.desc("claims"), "source")).cast("long")).where("rank <= 12")


@query(f"""{_CLAIMS}
select count(*) as claims, count(*) filter (illegal) as illegal, count(*) filter (unfair) as unfair, count(*) filter (illegal and unfair) as both_, count(distinct doc_id) as documents, round(count(*) filter (illegal) / count(*), 6) as illegal_rate from f""")
def a11_headline_summary(t):
    c = lx.claims(t.documents, {"illegal": "the ", "unfair": "of "}, "(?i)(in|on) ")
    return c.agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("illegal").alias("illegal"), F.count_if("unfair").alias("unfair"), F.count_if(F.col("illegal") & F.col("unfair")).alias("both_"),
        F.countDistinct("doc_id").alias("documents"), F.round(F.count_if("illegal") / F.count(F.lit(1)), 6).alias("illegal_rate"),
    )


@query("""
select doc_id, score, round(greatest(0, score - 0.5 * (n_chars % 3)) * case when doc_id % 4 = 0 then 0.25 else 1 end + 3 * (doc_id % 2) + doc_id % 3, 6) as rescored,
  case when score > 3 and greatest(0, score - 0.5 * (n_chars % 3)) * case when doc_id % 4 = 0 then 0.25 else 1 end + 3 * (doc_id % 2) + doc_id % 3 > 3 then 'kept' when score > 3 then 'dropped'
    when greatest(0, score - 0.5 * (n_chars % 3)) * case when doc_id % 4 = 0 then 0.25 else 1 end + 3 * (doc_id % 2) + doc_id % 3 > 3 then 'raised' else 'clear' end as transition
from (select *, cast(n_chars % 8 as double) as score from documents)""")
def d17_rescored(t):
    d = t.documents.withColumns({"score": (F.col("n_chars") % 8).cast("double"), "topical": F.col("n_chars") % 3, "reading": (F.col("doc_id") % 4 == 0).cast("int").cast("double"), "strong": F.col("doc_id") % 2, "weak": F.col("doc_id") % 3})
    return records.rescored(d).select("doc_id", "score", "rescored", "transition")


_CLEAN = r"""
with q as (select doc_id, translate(text, '’‘“”–—', concat(chr(39), chr(39), '""--')) as s from documents),
a as (select doc_id, regexp_replace(s, '(^|[^\pL\pN_])(Dr|Mr|Mrs|Ms|St|No|Ave|Blvd|Inc|Co|Corp|Jr|Sr|U\.S|W\.S|Ltd|LLC)\.(\s)', '\1\2\3', 'g') as s from q),
h as (select doc_id, regexp_replace(regexp_replace(s, '([0-9])-\s+([0-9])', '\1-\2', 'g'), '([\pL\pN_]) -([\pL\pN_])', '\1-\2', 'g') as s from a)
select doc_id, replace(replace(regexp_replace(s, '[ \t]+,', ',', 'g'), '"no."', '"no".'), '"yes."', '"yes".') as text from h"""


@query(_CLEAN)
def t20_clean_minutes(t):
    return t.documents.select("doc_id", records.clean_minutes(F.col("text")).alias("text"))


@query("select doc_id, strftime(make_date(2000 + cast(doc_id % 26 as int), cast(1 + doc_id % 12 as int), cast(1 + doc_id % 28 as int)), '%Y-%m-%d') as printed from documents")
def t10_printed_date(t):
    d = F.make_date(2000 + F.col("doc_id") % 26, 1 + F.col("doc_id") % 12, 1 + F.col("doc_id") % 28)
    return t.documents.select("doc_id", records.long_date(F.concat(F.lit("Minutes of "), F.date_format(d, "MMMM d, yyyy"), F.lit("\n"), "text"), 600).alias("printed"))


@query("""
with n as (select user_id, event_type, count(*) as n from events group by all)
select user_id, coalesce(max(n) filter (event_type = 'view'), 0) as heard, coalesce(max(n) filter (event_type = 'click'), 0) as written,
  (heard >= 2 and written = 0) or (heard = 0 and written >= 2) or abs(heard - written) >= 4 as exception from n group by user_id""")
def d13_commenter_counts(t):
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("heard"), F.count_if(F.col("event_type") == "click").alias("written"))
    return records.commenter_check(g, "heard", "written")


@query("""
select doc_id, case when lang is null then 'missing lang' when length(text) < 30 then 'short text' end as reason, lang is null or length(text) < 30 as quarantined from documents""")
def d19_quarantine(t):
    return records.quarantine(t.documents, {"missing lang": F.col("lang").isNull(), "short text": F.length("text") < 30}).select("doc_id", "reason", "quarantined")


_CODES = "case substr(n, {0}, 1) when 'b' then '1' when 'f' then '1' when 'p' then '1' when 'v' then '1' when 'c' then '2' when 'g' then '2' when 'j' then '2' when 'k' then '2' when 'q' then '2' when 's' then '2' when 'x' then '2' when 'z' then '2' when 'd' then '3' when 't' then '3' when 'l' then '4' when 'm' then '5' when 'n' then '5' when 'r' then '6' else '' end"


@query("""
with w as (select distinct split_part(p_name, ' ', 2) as n from part),
c as (select n, list_transform(range(1, length(n) + 1), lambda i: """ + _CODES.format("i") + """) as c, list_transform(range(1, length(n) + 1), lambda i: substr(n, i, 1)) as l from w),
k as (select n, list_filter(list_transform(range(2, length(n) + 1), lambda i: case when c[i] = '' then '' when c[i - 1] = c[i] then '' when i > 2 and l[i - 1] in ('h', 'w') and c[i - 2] = c[i] then '' else c[i] end), lambda x: x <> '') as d from c)
select n as name, upper(substr(n, 1, 1)) || rpad(substr(array_to_string(d, ''), 1, 3), 3, '0') as code from k""")
def t26_soundex(t):
    return t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).distinct().select("name", F.soundex("name").alias("code"))


@query()
def j12_resolved_names(t):
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    titled = F.when(F.col("p_size") % 9 == 0, "Dr").when(F.col("p_size") % 9 == 1, "Mr.")
    members = t.part.groupBy(F.col("p_brand").alias("body"), word(2).alias("member")).agg(F.min(titled).alias("title"))
    spoken = t.part.groupBy(F.col("p_brand").alias("body"), titled.alias("title"), F.concat(F.substring("p_name", 1, 3), word(2)).alias("name")).agg(F.count(F.lit(1)).alias("mentions"))
    return names.resolve(spoken, members)


@query()
def a07_alias_table(t):
    return names.alias_table(j12_resolved_names(t))


@query("""
with p as (select s_suppkey, s_nationkey, 'Mr' || s_nationkey % 3 as title from supplier)
select s_nationkey as member, count(distinct s_suppkey) as meetings, arg_min(title, s_suppkey) as title from p group by 1""")
def a04_roster(t):
    m = t.supplier.select(F.col("s_suppkey").alias("ord"), F.array(F.struct(F.col("s_nationkey").alias("name"), F.concat(F.lit("Mr"), (F.col("s_nationkey") % 3).cast("string")).alias("title"))).alias("present"))
    return names.roster(m.withColumn("absent", F.slice("present", 1, 0)))


def _minutes_sql() -> tuple[str, str]:
    """Descriptions of entries, and repaired texts, from the same fixed values."""
    kind = "case " + " ".join(f"when regexp_matches(substr(body, 1, 220), '{p}') then '{k}'" for k, p in minutes.KINDS) + " else 'other' end"
    reading = "case said " + " ".join(f"when '{w}' then {n}" for w, n in minutes.READINGS.items()) + " end"
    end = minutes.TITLE_END
    described = rf"""
with b as (select doc_id, text, regexp_replace(text, '^\[CA\]\s*', '') as body, lower(regexp_extract(substr(text, 1, 120), '(1st|2nd|3rd|first|second|third) READING', 1, 'i')) as said from documents)
select doc_id, {kind} as kind, cast({reading} as integer) as reading, starts_with(text, '[CA]') or contains(text, 'per Consent Agenda') as consent,
  regexp_replace(trim(regexp_replace(case when regexp_matches(body, '{end}') then regexp_extract(body, '(?s)^(.*?)(?:{end})', 1) else substr(body, 1, 400) end, '\s+', ' ', 'g')), '[ .]+$', '') as title from b"""
    text = r"regexp_replace(text, '\bD r\b', 'Dr', 'g')"
    for w in sorted({*minutes.VOCABULARY, *_SPLIT}, key=lambda w: (-len(w), w)):
        text = rf"regexp_replace({text}, '\b{(chr(92) + 's?').join(w)}\b', '{w}', 'g')"
    return described, f"select doc_id, md5({text}) as repaired from documents"


_SPLIT = ["thing", "tion", "haben"]
_DESCRIBED, _REPAIRED = _minutes_sql()


@query(_DESCRIBED)
def d04_described(t):
    return minutes.described(t.documents).select("doc_id", "kind", "reading", "consent", "title")


@query(_REPAIRED)
def t21_repaired(t):
    return t.documents.select("doc_id", F.md5(minutes.repaired(F.col("text"), [*minutes.VOCABULARY, *_SPLIT])).alias("repaired"))


@query(rf"""
with f as (select item_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.+$', '') as flat from benchmark),
p as (select item_id, list_filter(list_transform(string_split_regex(flat, ',\s*|\s+and\s+'), lambda x: trim(x)), lambda x: x <> '') as p from f),
u as (select item_id, unnest(p) as p, generate_subscripts(p, 1) as k from p),
g as (select *, sum(case when k > 1 and (regexp_matches(p, '{minutes.GLUED}') or len(string_split(p, ' ')) > 4) then 0 else 1 end) over (partition by item_id order by k) as person from u)
select item_id, cast(person - 1 as integer) as ord, string_agg(p, ', ' order by k) as person from g group by item_id, g.person""")
def t22_people(t):
    return t.benchmark.select("item_id", F.posexplode(minutes.people(F.col("text"))).alias("ord", "person"))


@query()
def g09_entries(t):
    return minutes.entries(t.documents.withColumnRenamed("doc_id", "doc")).withColumnRenamed("doc", "doc_id")


@query()
def d05_parsed(t):
    return minutes.parsed(t.documents.select(F.col("doc_id").alias("doc"), "text")).select(F.col("doc").alias("doc_id"), "seq", "kind", "reading", "consent", "title")

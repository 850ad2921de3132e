"""Queries over conversations and documents: threads, joins, coverage, sinks."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx
from ..operators import lexicon as lx
from ..operators import similarity as sm
from ..operators import threads as th
from ..sources import files, sinks
from .base import query

_CLEAN = """
with f as (select conv_id, turn, role, text, lag(role) over w as pr, lag(text) over w as pt from conversations where length(text) >= 8 window w as (partition by conv_id order by turn)),
t as (select conv_id, turn, role, text from f where not (role is not distinct from pr and text is not distinct from pt)),
n as (select *, lag(role) over w as prev, lead(role) over w as next, lead(text) over w as answer from t window w as (partition by conv_id order by turn))"""


@query(f"""{_CLEAN}
select conv_id, turn, text as prompt, case when next = 'assistant' then answer end as output from n where role = 'user' union all
select conv_id, turn, null, text from n where role = 'assistant' and (prev is null or prev <> 'user')""")
def s12_paired_turns(t):
    return th.paired(t.conversations)


@query("""
select c.conv_id, c.turn, (select min(r.turn) from conversations r where r.conv_id = c.conv_id and r.turn > c.turn and r.role = 'assistant' and contains(r.text, 'the')) as response
from conversations c where c.role = 'user' and contains(c.text, 'ing')""")
def j09_first_response(t):
    c = t.conversations
    return th.first_response(c.where("role = 'user' and contains(text, 'ing')"), c, (F.col("role") == "assistant") & F.col("text").contains("the"))


@query("""
with h as (select *, case when role = 'user' then regexp_extract(text, '^(\\S+)', 1) end as h, sum(case when role = 'system' then 1 else 0 end) over (partition by conv_id order by turn) as run from conversations)
select conv_id, turn, case when role <> 'system' then (select arg_max(i.h, i.turn) from h i where i.conv_id = h.conv_id and i.run = h.run and i.turn <= h.turn and i.h is not null) end as hint from h""")
def g08_hint_fill(t):
    from ..operators.timeline import fill_forward

    c = t.conversations.withColumn("hint", F.when(F.col("role") == "user", F.regexp_extract("text", r"^(\S+)", 1)))
    return fill_forward(c, ["conv_id"], ["turn"], "hint", F.col("role") != "system").select("conv_id", "turn", "hint")


_MARKERS = {"has_thing": ("thing", 10), "has_tion": ("tion", 5), "ends_short": (r"\. [A-Z][a-z]*\.$", -10)}
_SCORE = """
with x as (select *, lead(text) over (partition by conv_id order by turn) as after from conversations),
s as (select conv_id, turn, role, text, greatest(0, least(100, 40 + case when length(text) >= 1200 then 30 when length(text) >= 400 then 22 when length(text) >= 120 then 14 else 6 end
  + case when contains(text, 'thing') then 10 else 0 end + case when contains(text, 'tion') then 5 else 0 end + case when regexp_matches(text, '\\. [A-Z][a-z]*\\.$') then -10 else 0 end
  + case when regexp_matches(after, '^The') then 15 else 0 end + case when regexp_matches(after, '^An') then -20 else 0 end)) as score,
  concat_ws(',', case when contains(text, 'thing') then 'has_thing' end, case when contains(text, 'tion') then 'has_tion' end, case when regexp_matches(text, '\\. [A-Z][a-z]*\\.$') then 'ends_short' end,
    case when regexp_matches(after, '^The') then 'confirmed' end, case when regexp_matches(after, '^An') then 'rejected' end) as reasons from x)"""


def _scores(t):
    return th.turn_scores(t.conversations, _MARKERS, "^The", "^An")


@query(f"{_SCORE} select conv_id, turn, cast(score as integer) as score, reasons from s")
def a20_turn_scores(t):
    return _scores(t).select("conv_id", "turn", "score", F.array_join("reasons", ",").alias("reasons"))


def _progress_sql() -> str:
    """Scores of paired turns, from the same fixed values."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    points = lambda of, marks: " + ".join(f"case when regexp_matches({of}, {q('(?im)' + p)}) then {n} else 0 end" for p, n, _ in marks)
    length = "case " + " ".join([f"when length(o) > {n} then {d}" for n, d, _ in th.LONGER] + [f"when length(o) < {n} then {d}" for n, d, _ in th.SHORTER]) + " else 0 end"
    starts = lambda words: "(" + " or ".join(f"starts_with(nxt, {q(x)})" for x in words) + ")"
    return f"""
with f as (select *, lag(role) over w as r0, lag(text) over w as t0 from conversations where length(text) >= 8 window w as (partition by conv_id order by turn)),
t as (select conv_id, turn, role, text, lag(role) over w as prev, lead(role) over w as next, lead(text) over w as answer from f
  where not (role is not distinct from r0 and text is not distinct from t0) window w as (partition by conv_id order by turn)),
p as (select conv_id, turn, text as prompt, case when next = 'assistant' then answer end as output from t where role = 'user'
  union all select conv_id, turn, null, text from t where role = 'assistant' and (prev is null or prev <> 'user')),
n as (select conv_id, turn, coalesce(output, '') as o, lower(coalesce(output, '')) as lo, trim(lower(coalesce(lead(prompt) over w, ''))) as nxt, lead(turn) over w is null as last from p window w as (partition by conv_id order by turn)),
s as (select *, {length} as len, {points("o", th.RICHNESS)} as rich, {points("o", th.DELIVERED)} as done, {points("lo", th.OPEN + th.FAILED)} as bad from n),
c as (select *, case when not last and {starts(th.CONFIRMS)} then {th.CONFIRMED} else 0 end + case when not last and {starts(th.REJECTS)} then {th.REJECTED} else 0 end
  + case when last and (contains(right(o, 400), '?') or regexp_matches(right(o, 600), '(?i){th.AWAITS}')) then {th.AWAITING} else 0 end + case when last and done >= {th.DELIVERY} then {th.LANDED} else 0 end as course from s)
select conv_id, turn, cast(greatest(0, least(100, {th.START} + len + rich + done + bad + course + greatest(0, least({th.LARGEST_RELIEF}, -bad - {th.MOST_NEGATIVE})))) as integer) as score from c"""


@query(_progress_sql())
def a20_progress_scores(t):
    return th.progress_scores(th.paired(t.conversations)).select("conv_id", "turn", "score")


_DONE = f"""{_SCORE},
i as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from s),
w as (select *, 1 + 0.6 * case when n > 1 then i / (n - 1) else 0 end as w from i),
g as (select conv_id, sum(score * w) / sum(w) as mean, max_by(score, i) as last, count(*) as turns from w group by conv_id),
c as (select conv_id, turns, least(100.0, round(cast(0.68 * mean + 0.32 * last + least(turns, 5) as double), 4)) as completeness from g)"""


@query(f"{_DONE} select conv_id, turns, cast(completeness as double) as completeness, case when completeness >= 75 then 'complete' when completeness >= 50 then 'mostly' when completeness >= 25 then 'partial' else 'open' end as label from c")
def a21_completeness(t):
    return th.completeness(_scores(t))


@query("""
with t as (select *, substr(lower(text), 1, 2) as theme from conversations),
v as (select conv_id, theme, count(*) as v, min(turn) as f from t group by all),
b as (select conv_id, arg_min(theme, (-v, f)) as theme from v group by conv_id)
select conv_id, count(*) as turns, cast(sum(length(text)) as bigint) as chars, min(turn) as first_turn, max(turn) as last_turn, any_value(b.theme) as theme from t join b using (conv_id) group by conv_id""")
def a22_thread_rollup(t):
    return th.rollup(t.conversations, F.lower("text").substr(1, 2))


@query("select count(*) as turns, count(*) filter (role = 'user') as prompts, count(distinct conv_id) as threads, cast(sum(length(text)) as bigint) as chars, min(turn) as first_turn, max(turn) as last_turn from conversations")
def a25_corpus_counts(t):
    c = t.conversations
    return c.agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("prompts"), F.countDistinct("conv_id").alias("threads"), F.sum(F.length("text")).alias("chars"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("""
with c as (select conv_id, substr(min(lower(text)), 1, 1) as theme, count(*) as turns, sum(length(text)) as chars from conversations group by conv_id),
g as (select theme, count(*) as threads, sum(turns) as turns, sum(chars) as chars from c group by theme)
select theme, threads, cast(turns as bigint) as turns, round(turns / sum(turns) over (), 6) as share, round(sqrt(turns), 6) as weight, round(sqrt(chars / 500), 6) as text_weight from g""")
def a28_theme_tree(t):
    c = t.conversations.groupBy("conv_id").agg(F.min(F.lower("text")).substr(1, 1).alias("theme"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
    g = c.groupBy("theme").agg(F.count(F.lit(1)).alias("threads"), F.sum("turns").alias("turns"), F.sum("chars").alias("chars"))
    all_turns = F.sum("turns").over(W.partitionBy())  # themes are few: they are the first letters
    return g.select("theme", "threads", "turns", F.round(F.col("turns") / all_turns, 6).alias("share"), F.round(F.sqrt("turns"), 6).alias("weight"), F.round(F.sqrt(F.col("chars") / 500), 6).alias("text_weight"))


@query("select conv_id, turn, greatest(20, least(90, 40 + cast(round(least(30, length(text) / 900)) as integer))) as estimate from conversations")
def a40_import_estimate(t):
    est = F.greatest(F.lit(20), F.least(F.lit(90), 40 + F.round(F.least(F.lit(30.0), F.length("text") / 900)).cast("int")))
    return t.conversations.select("conv_id", "turn", est.alias("estimate"))


@query("""
select conv_id, 'opened with ' || arg_min(substr(text, 1, 30), turn) || '; ' || count(*) || ' turns; stopped at ' || arg_max(role, turn) || '; last ask ' || coalesce(arg_max(substr(text, 1, 30), turn) filter (role = 'user'), '-') as summary
from conversations group by conv_id""")
def a41_thread_summary(t):
    cut = F.col("text").substr(1, 30)
    g = t.conversations.groupBy("conv_id").agg(F.min_by(cut, "turn").alias("opened"), F.count(F.lit(1)).alias("n"), F.max_by("role", "turn").alias("stop"), F.max_by(F.when(F.col("role") == "user", cut), F.when(F.col("role") == "user", F.col("turn"))).alias("ask"))
    return g.select("conv_id", F.concat(F.lit("opened with "), "opened", F.lit("; "), F.col("n").cast("string"), F.lit(" turns; stopped at "), "stop", F.lit("; last ask "), F.coalesce("ask", F.lit("-"))).alias("summary"))


@query("select conv_id, count(*) filter (role = 'assistant') as segments, cast(sum(case when role = 'assistant' then len(regexp_extract_all(text, 'the ')) else 0 end) as bigint) as introductions from conversations group by conv_id")
def a09_introductions(t):
    said = F.when(F.col("role") == "assistant", F.regexp_count("text", F.lit("the "))).otherwise(0)
    return t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("segments"), F.sum(said).alias("introductions"))


@query("""
select conv_id, turn from conversations c where role = 'user' and length(text) between 40 and 400 and contains(lower(text), 'the') and turn between 1 and 30""")
def f04_turn_filter(t):
    return t.conversations.where((F.col("role") == "user") & F.length("text").between(40, 400) & F.lower("text").contains("the") & F.col("turn").between(1, 30)).select("conv_id", "turn")


@query("""
select conv_id from conversations c group by conv_id having min(turn) <= 3 and max(turn) >= 2
  and exists (select 1 from conversations x where x.conv_id = c.conv_id and x.role = 'user' and contains(lower(x.text), 'ing') and length(x.text) <= 200)""")
def f05_thread_filter(t):
    c = t.conversations
    surviving = c.where((F.col("role") == "user") & F.lower("text").contains("ing") & (F.length("text") <= 200)).select("conv_id")
    return c.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("z")).where("a <= 3 and z >= 2").join(surviving, "conv_id", "left_semi").select("conv_id")


@query(f"""{_DONE},
b as (select conv_id, 100 - completeness + turns as resume_score from c order by resume_score desc, conv_id limit 12)
select conv_id, cast(round(resume_score, 4) as double) as resume_score, string_agg(substr(text, 1, 80), chr(10) order by turn) as packet from conversations join b using (conv_id) group by all""")
def s25_packets(t):
    s = _scores(t)
    threads = th.completeness(s).withColumn("resume_score", 100 - F.col("completeness") + F.col("turns"))
    return th.packets(s, threads, 12, 80).select("conv_id", F.round("resume_score", 4).alias("resume_score"), "packet")


@query(r"""
with t as (select conv_id, turn, case when role = 'user' then text end as prompt, case when role <> 'user' then text end as output, row_number() over (partition by conv_id order by turn desc) as back from conversations),
l as (select *, regexp_extract_all(coalesce(prompt, ''), '(?im)^(?:the|in|que|is)\b[:\- ]*(.{6,160})', 1) as a, regexp_extract_all(coalesce(output, ''), '(?im)^(?:the|in|que|is)\b[:\- ]*(.{6,160})', 1) as b,
  list_filter(string_split(regexp_replace(trim(coalesce(prompt, '')), '[?]\s+', '?' || chr(1), 'g'), chr(1)), lambda s: ends_with(trim(s), '?') and len(s) > 15) as q from t where back <= 14),
x as (select conv_id, turn, 0 as part, unnest(list_concat(a, b)) as ask, generate_subscripts(list_concat(a, b), 1) as place from l union all select conv_id, turn, 1, unnest(q), generate_subscripts(q, 1) from l where back = 1
  union all select conv_id, turn, 2, 'Assistant ended by asking which direction to take — answer it to continue.', 1 from l where back = 1 and regexp_matches(output, '(?i)\bwould you like me to\b|\bwhich (?:would you|do you) prefer\b')),
y as (select conv_id, turn, part, place, trim(regexp_replace(ask, '\s+', ' ', 'g')) as ask from x),
f as (select conv_id, substr(lower(ask), 1, 60) as head, arg_min(ask, (turn, part, place)) as ask, min((turn, part, place)) as at_ from y where len(ask) > 8 group by all)
select conv_id, ask, rank from (select *, row_number() over (partition by conv_id order by at_) as rank from f) where rank <= 6""")
def t35_open_asks(t):
    c = t.conversations
    user = F.col("role") == "user"
    turns = c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("ord"), F.when(user, F.col("text")).alias("prompt"), F.when(~user, F.col("text")).alias("output"))
    return th.open_asks(turns, ["the", "in", "que", "is"]).withColumnRenamed("thread", "conv_id")


_TOK = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4))"


@query(f"""
with d as (select doc_id, {_TOK} as t from documents), b as (select item_id, {_TOK} as t from benchmark),
x as (select item_id, len(t) as n, unnest(t) as w from b), y as (select doc_id, len(t) as n, unnest(t) as w from d),
c as (select item_id, doc_id, x.n as ln, y.n as rn, count(*) as c from x join y using (w) group by all),
s as (select item_id, doc_id, round(c / (ln + rn - c), 6) as similarity from c)
select item_id as left_id, doc_id as right_id, similarity from (select *, row_number() over (partition by item_id order by similarity desc, doc_id) as k from s where similarity >= 0.2) where k = 1""")
def j04_best_match(t):
    tok = F.array_distinct(fx.tokens(F.col("text"), 4))
    left = t.benchmark.select(F.col("item_id").alias("id"), tok.alias("tokens"))
    right = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), tok.alias("tokens"))
    return sm.best_match(left, right, 0.2, "ord")


@query(f"""
with d as (select doc_id, {_TOK} as t from documents)
select a.doc_id, round(len(list_intersect(a.t, b.t)) / greatest(len(list_distinct(list_concat(a.t, b.t))), 1), 6) as similarity from d a join d b on b.doc_id = a.doc_id + 1""")
def t28_title_similarity(t):
    # The same title at two readings: the prefix tells nothing.
    title = lambda n: F.concat(F.lit(f"[CA] ORDINANCE - {n} READING - "), "text")
    d = t.documents.select("doc_id", fx.title_key(title("1st")).alias("t"))
    nxt = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), fx.title_key(title("3rd")).alias("u"))
    return d.join(nxt, "doc_id").select("doc_id", F.round(fx.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


_PROFILE = """
with t as (select source, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3) as t from documents),
w as (select source, unnest(list_concat(t, list_transform(t[1:len(t) - 1], lambda a, i: a || ' ' || t[i + 1]))) as term from t),
n as (select source, term, count(*) as n from w group by all),
p as (select source, term, n / total as weight from (select *, sum(n) over (partition by source) as total, row_number() over (partition by source order by n desc, term) as k from n) where k <= 40)"""


def _profiles(t):
    return sm.profiles(t.documents, "source", fx.tokens(F.col("text"), 3), 40)


@query(f"{_PROFILE} select source, term, round(cast(weight as double), 9) as weight from p")
def a18_salient_profile(t):
    return _profiles(t).withColumn("weight", F.round("weight", 9))


@query(f"""{_PROFILE}, s as (select source, sum(weight) as whole from p group by source)
select x.source as a, y.source as b, round(cast(2 * sum(least(x.weight, y.weight)) / (any_value(sa.whole) + any_value(sb.whole)) as double), 6) as overlap
from p x join p y on x.term = y.term and x.source < y.source join s sa on sa.source = x.source join s sb on sb.source = y.source group by all""")
def t29_profile_overlap(t):
    return sm.profile_overlap(_profiles(t), "source")


@query("""
select source, count(*) as entries, count(distinct sha256(text)) as distinct_contents, count(*) filter (length(text) > 0) as stored, count(l.doc_id) as searchable, count(*) filter (l.doc_id is null) as missing, count(*) filter (l.auto) as auto_captioned
from documents d left join (select doc_id, max(quality) = 0 as auto from labels group by doc_id) l using (doc_id) group by source""")
def a33_coverage(t):
    known = t.labels.groupBy("doc_id").agg((F.max("quality") == 0).alias("auto")).withColumn("known", F.lit(True))
    d = t.documents.join(known, "doc_id", "left")
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct(F.sha2("text", 256)).alias("distinct_contents"), F.count_if(F.length("text") > 0).alias("stored"), F.count_if("known").alias("searchable"),
        F.count_if(F.col("known").isNull()).alias("missing"), F.count_if("auto").alias("auto_captioned"),
    )


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def j01_missing_files(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("""
with o as (select *, strftime(o_orderdate, '%Y-%m') as month, row_number() over (partition by o_custkey, strftime(o_orderdate, '%Y-%m'), o_orderpriority order by o_orderkey) as k from orders)
select c_custkey, month, o_orderpriority as kind, o_orderkey from customer left join o on o_custkey = c_custkey and k = 1""")
def j02_first_match(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("kind"), "o_orderkey")
    first = o.groupBy("c_custkey", "month", "kind").agg(F.min("o_orderkey").alias("o_orderkey"))
    return t.customer.select("c_custkey").join(first, "c_custkey", "left")


@query("select c_custkey, (select max(o_orderkey) from orders where o_custkey = c_custkey) as o_orderkey from customer")
def j03_last_wins(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left")


@query("""
with h as (select doc_id, unnest([('with', contains(text, ' with ')), ('from', contains(text, ' from ')), ('that', contains(text, ' that '))]) as x from documents),
f as (select doc_id, x[1] as term from h where x[2]), r(rule, term) as (values ('open-meetings', 'with'), ('open-meetings', 'that'), ('records', 'from'))
select doc_id, rule, string_agg(term, ',' order by term) as triggers from f join r using (term) group by all""")
def j11_remediation(t):
    terms = F.array(*[F.when(F.col("text").contains(f" {w} "), F.lit(w)) for w in ("with", "from", "that")])
    fired = t.documents.select("doc_id", F.explode(F.filter(terms, lambda x: x.isNotNull())).alias("term"))
    rules = t.spark.createDataFrame([("open-meetings", "with"), ("open-meetings", "that"), ("records", "from")], "rule string, term string")
    return fired.join(F.broadcast(rules), "term").groupBy("doc_id", "rule").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("triggers"))


@query("select c_custkey, case when c_custkey % 10 = 0 then 'named ' || c_custkey else c_name end as name from customer")
def j19_curated_names(t):
    curated = t.customer.where("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("named "), F.col("c_custkey").cast("string")).alias("curated"))
    return t.customer.join(curated, "c_custkey", "left").select("c_custkey", F.coalesce("curated", "c_name").alias("name"))


@query("""
select id, arg_min(origin, pri) as origin from (select doc_id as id, 'documents' as origin, 1 as pri from documents union all select doc_id, 'labels', 2 from labels union all select item_id * 3, 'benchmark', 3 from benchmark) group by id""")
def x01_first_source_wins(t):
    parts = [(t.documents, "doc_id", "documents"), (t.labels, "doc_id", "labels"), (t.benchmark, F.col("item_id") * 3, "benchmark")]
    rows = [d.select((F.col(c) if isinstance(c, str) else c).alias("id"), F.lit(name).alias("origin"), F.lit(k).alias("pri")) for k, (d, c, name) in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("id").agg(F.min_by("origin", "pri").alias("origin"))


@query("""
select 'short' as check_, doc_id, length(text) as n, null as lang, length(text) < 60 as exception from documents union all select 'lang', doc_id, null, lang, lang not in ('en', 'de') from documents""")
def x02_union_of_checks(t):
    d = t.documents
    short = d.select(F.lit("short").alias("check_"), "doc_id", F.length("text").cast("long").alias("n"), (F.length("text") < 60).alias("exception"))
    lang = d.select(F.lit("lang").alias("check_"), "doc_id", "lang", (~F.col("lang").isin("en", "de")).alias("exception"))
    return short.unionByName(lang, allowMissingColumns=True)


@query("select lang, count(*) as items, round(avg(n_chars), 6) as mean_chars, count(distinct source) as sources from documents group by lang")
def a13_review_summary(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.countDistinct("source").alias("sources"))


@query("""
select count(*) as seen, count(*) filter (d.doc_id % 4 <> 0 and length(trim(text)) > 40) as written, count(*) filter (length(trim(text)) <= 40) as empty, count(*) filter (d.doc_id % 4 = 0 and length(trim(text)) > 40) as duplicate from documents d""")
def s21_manifest(t):
    known = t.documents.where("doc_id % 4 = 0").select("doc_id")
    return sinks.manifest(t.documents, known, "doc_id", "text", 40)


@query("select doc_id from documents where doc_id % 4 <> 0 and length(trim(text)) > 40")
def s19_append_new(t):
    return sinks.new_records(t.documents, t.documents.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "text", 40).select("doc_id")


@query("select doc_id, replace(text, chr(10), ' ') as text, lang || ' | ' || source as tags from documents where lang = 'fr'")
def s22_export_view(t):
    return sinks.export_rows(t.documents.where("lang = 'fr'").select("doc_id", "text", F.array("lang", "source").alias("tags")))


@query(r"select doc_id, split_part(text, chr(10), 1) as title, length(text) as n from documents where length(trim(text)) >= 120")
def s15_document_turns(t):
    return t.documents.where(F.length(F.trim("text")) >= 120).select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.length("text").cast("long").alias("n"))


@query("""
with s as (select event_id, unnest([user_id || '', nullif(trim(event_type), ''), nullif(trim(props), '')]) as v, generate_subscripts([1, 2, 3], 1) as k from events)
select event_id, string_agg(v, chr(10) || chr(10) order by k) as text from s where v is not null group by event_id""")
def s08_extracted_text(t):
    from ..sources.files import extract_text

    rec = t.events.select("event_id", F.struct(F.struct(F.col("user_id").alias("b")).alias("a"), F.col("event_type").alias("c"), F.col("props").alias("d")).alias("r"))
    return rec.select("event_id", extract_text("r", "a.b,c,d").alias("text"))


@query(r"""
with p as (select doc_id, regexp_extract_all(text, '[A-Za-z]+tion[ ,.]') as a from documents)
select doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:12], '|') as artifacts from p where len(a) > 0""")
def t34_artifacts(t):
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]+tion[ ,.]"), 0)
    return t.documents.withColumn("a", found).where(F.size("a") > 0).select("doc_id", F.array_join(F.slice(F.array_distinct("a"), 1, 12), "|").alias("artifacts"))


@query("""
select doc_id, n from (select doc_id, len(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_])', '\\1\\1', 'g'), '(?i)(^|[^A-Za-z0-9_])with(s|es)?([^A-Za-z0-9_]|$)')) as n from documents) where n > 0""")
def f01_plain_terms(t):
    return t.documents.select("doc_id", lx.term_count(F.col("text"), "with").cast("long").alias("n")).where("n > 0")


@query(r"""
with r as (select *, row_number() over (partition by conv_id order by turn) - 1 as k, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from conversations)
select conv_id, cast(k as integer) as k, role as product, case when role = 'user' and flat <> '' then 'prompt' else 'event' end as kind, case when role = 'user' then flat else '' end as prompt, case when role = 'user' then '' else text end as output from r""")
def s11_activity_items(t):
    text, none = F.array("text"), F.expr("cast(array() as array<string>)")
    item = F.struct("turn", F.col("role").alias("header"), F.when(F.col("role") == "user", text).otherwise(none).alias("subtitles"), F.when(F.col("role") == "user", none).otherwise(text).alias("details"))
    exports = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("text"))
    return files.activity_items(exports.select(F.col("conv_id").alias("path"), "text")).select(F.col("path").alias("conv_id"), "k", "product", "kind", "prompt", "output")


@query("select event_id, '/' || event_type as url, props as title, ts from events")
def s17_browser_visits(t):
    visit = F.struct(F.concat(F.lit("/"), "event_type").alias("url"), F.col("props").alias("title"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_usec"))
    exports = t.events.select(F.col("event_id").alias("path"), F.to_json(F.struct(F.array(visit).alias("history"))).alias("text"))
    v = files.browser_visits(exports)
    return v.select(F.col("path").alias("event_id"), "url", "title", F.col("ts").cast(dict(t.events.dtypes)["ts"]).alias("ts"))

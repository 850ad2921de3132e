"""Text scalars and lexicon classification over documents and conversations."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx
from ..operators import lexicon as lx
from .base import query

#: Stands in for the lexicon on invented prose: frequent words of the tables.
LEXICON = lx.Lexicon(
    deviation=["with", "from", "only", "das", "les"],
    statutory=["this", "are", "und"],
    enforcement=["by", "was", "que"],
    rhetoric={"objective": ["the", "der"], "subjective": ["that", "la"], "deferral": ["not", "por"], "authority": ["when", "dans"]},
)
STOP = ["this", "that", "with", "from"]


def _count(term: str) -> str:
    """DuckDB: occurrences of a term; separators are doubled because matches may not share one."""
    plural = "(s|es)?" if term[-1].isalpha() and not fx.case_sensitive(term) else ""
    flag = "" if fx.case_sensitive(term) else "(?i)"
    return f"len(regexp_extract_all(regexp_replace(text, '([^\\pL\\pN_])', '\\1\\1', 'g'), '{flag}(^|[^\\pL\\pN_]){term}{plural}([^\\pL\\pN_]|$)'))"


_HITS = " union all ".join(
    f"select doc_id, source, '{category}' as category, '{term}' as term, {_count(term)} as n from documents" for category, terms in LEXICON.categories().items() for term in terms
)


@query(f"select doc_id, category, term, n from ({_HITS}) where n > 0")
def a01_lexicon_hits(t):
    return lx.hits(t.documents, LEXICON).select("doc_id", "category", "term", "n")


_SCORES = f"""
select doc_id, source, count(*) filter (category = 'deviation' and n > 0) as deviations, count(*) filter (category = 'statutory' and n > 0) as statutes
from ({_HITS}) group by all"""


@query(f"""
select doc_id, 1.5 * deviations + 2.0 * statutes as score, 1.5 * deviations + 2.0 * statutes > 3.0 as flagged from ({_SCORES})""")
def a02_friction_score(t):
    return lx.scored(t.documents, LEXICON).select("doc_id", "score", "flagged")


@query(f"""
select source, count(*) as documents, count(*) filter (1.5 * deviations + 2.0 * statutes > 3.0) as flagged, round(avg(1.5 * deviations + 2.0 * statutes), 6) as mean_score
from ({_SCORES}) group by source""")
def a02_flagged_by_source(t):
    s = lx.scored(t.documents, LEXICON)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.avg("score"), 6).alias("mean_score"))


_MODE = {m: " + ".join(_count(x) for x in terms) for m, terms in LEXICON.rhetoric.items()}


@query(f"""
with c as (select doc_id, {', '.join(f'{e} as {m}' for m, e in _MODE.items())} from documents)
select doc_id, objective, subjective, deferral, authority,
  case when objective + subjective = 0 then null else round(objective / (objective + subjective), 6) end as objectivity,
  case when greatest(objective, subjective, deferral, authority) = 0 then 'none'
       when objective = greatest(objective, subjective, deferral, authority) then 'objective'
       when subjective = greatest(objective, subjective, deferral, authority) then 'subjective'
       when deferral = greatest(objective, subjective, deferral, authority) then 'deferral' else 'authority' end as dominant
from c""")
def a03_rhetoric_profile(t):
    return lx.rhetoric(t.documents, LEXICON).select("doc_id", *LEXICON.rhetoric, "objectivity", "dominant")


@query(r"""
with m as (select doc_id, text, regexp_extract(text, '(?is)^(.*?(?:^|[^\pL\pN_]))(this(?:s|es)?)(?:[^\pL\pN_]|$)', ['pre', 'hit']) as g from documents),
p as (select doc_id, text, length(g.pre) + 1 as a, length(g.pre) + length(g.hit) as z, g.hit from m),
q as (select doc_id, text, greatest(a - 90, 1) as f, least(z + 90, length(text)) as l from p where hit <> '')
select doc_id, (case when f > 1 then '…' else '' end) || trim(regexp_replace(substr(text, f, l - f + 1), '\s+', ' ', 'g')) || (case when l < length(text) then '…' else '' end) as snippet from q""")
def t02_snippet(t):
    return t.documents.select("doc_id", fx.snippet(F.col("text"), fx.term_pattern("this")).alias("snippet")).where("snippet is not null")


@query(r"""
with w as (select doc_id, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as l from documents),
p as (select doc_id, unnest(l) as w, generate_subscripts(l, 1) as k from w),
f as (select doc_id, min(k) as k, arg_min(w, k) as w from p group by doc_id, lower(w))
select doc_id, string_agg(w, ' ' order by k) as words from f group by doc_id""")
def t03_distinct_words(t):
    return lx.distinct_words(t.documents).select("doc_id", "words")


@query("select doc_id, substr(sha256(source || chr(31) || text), 1, 16) as record_id, substr(sha1(source || '|' || lang || '|' || cast(doc_id as varchar)), 1, 16) as entry_id from documents")
def t05_record_ids(t):
    return t.documents.select("doc_id", fx.record_id(F.col("source"), F.col("text")).alias("record_id"), fx.stable_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("entry_id"))


@query("""
with s as (select event_id, cast(floor(epoch(ts)) as bigint) % 86400 as s from events)
select event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) as clock, cast(s as double) as seconds from s""")
def t07_clock(t):
    s = t.events.select("event_id", F.pmod(F.floor(fx.micros(F.col("ts")) / 1000000), F.lit(86400)).alias("s")).select("event_id", fx.to_clock(F.col("s")).alias("clock"))
    return s.withColumn("seconds", fx.from_clock(F.col("clock")))


@query("""
select event_id, strftime(ts, '%Y-%m-%d') as found from events""")
def t09_first_date(t):
    ts, k = F.col("ts"), F.col("event_id") % 4
    written = F.when(k == 0, F.date_format(ts, "'agenda-'yyyy-MM-dd'.pdf'")).when(k == 1, F.date_format(ts, "'held on 'MMMM d, yyyy' at noon'")).when(k == 2, F.date_format(ts, "'of 'M/d/yyyy' again'")).otherwise(F.date_format(ts, "'minutes_'yyyyMMdd'.txt'"))
    return t.events.select("event_id", fx.first_date(written).alias("found"))


_STOPS = ", ".join(f"'{w}'" for w in STOP)


@query(f"""
with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4 and x not in ({_STOPS})) as l from documents)
select doc_id, len(list_distinct(l)) as n, coalesce(array_to_string(list_sort(list_distinct(l)), ' '), '') as words from w""")
def t23_token_set(t):
    s = fx.token_set(F.col("text"), STOP)
    return t.documents.select("doc_id", F.size(s).alias("n"), F.array_join(s, " ").alias("words"))


@query(f"""
with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 and x not in ({_STOPS})) as l from documents)
select doc_id, len(l) as n, coalesce(array_to_string(l, ' '), '') as words from w""")
def t24_token_list(t):
    s = fx.token_list(F.col("text"), STOP)
    return t.documents.select("doc_id", F.size(s).alias("n"), F.array_join(s, " ").alias("words"))


@query(r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '[0-9]{3}-[0-9]{2}-[0-9]{4}', '[ssn]', 'g'), '\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}', '[phone]', 'g') as text from documents""")
def t30_redacted(t):
    return t.documents.select("doc_id", fx.redact(F.col("text")).alias("text"))


@query(r"""
with f as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from documents),
c as (select doc_id, flat, regexp_extract(substr(flat, 1, 140), '^(.*)\s\S*$', 1) as cut from f)
select doc_id, case when length(flat) <= 140 then flat else (case when cut = '' then substr(flat, 1, 140) else cut end) || '…' end as excerpt,
  regexp_replace(substr(regexp_replace(lower(flat), '[^a-z0-9]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g') as slug from c""")
def t32_excerpt(t):
    return t.documents.select("doc_id", fx.excerpt(F.col("text"), 140).alias("excerpt"), fx.slug(fx.collapse(F.col("text"))).alias("slug"))


@query("select conv_id, turn, regexp_replace(text, '(?i)(there|the|on)', '<mark>\\1</mark>', 'g') as marked from conversations")
def t33_highlight(t):
    return t.conversations.select("conv_id", "turn", fx.highlight(F.col("text"), ["the", "there", "on"]).alias("marked"))


@query("""
with a as (select event_id, cast(floor((epoch_us(timestamp '2026-06-01') - epoch_us(ts)) / 86400e6 - event_id % 900 + 0.5) as bigint) as d from events)
select event_id, case when d <= 0 then 'today' when d = 1 then 'yesterday' when d < 30 then d || ' days ago' when d < 365 then cast(floor(d / 30 + 0.5) as bigint) || ' mo ago'
  else cast(cast(floor(d / 365 * 10 + 0.5) / 10 as decimal(10, 1)) as varchar) || ' yr ago' end as age from a""")
def t38_relative_age(t):
    age = (F.lit(1780272000000000) - fx.micros(F.col("ts"))) / 1e6 - (F.col("event_id") % 900) * 86400
    return t.events.select("event_id", fx.relative_age(age).alias("age"))


_LABEL = """case when n = 0 then '0' when n < 1024 then n || ' B' when u < 10 then cast(cast(floor(u * 10 + 0.5) / 10 as decimal(20, 1)) as varchar) || unit else cast(floor(u + 0.5) as bigint) || unit end"""


@query(f"""
with b as (select 'document' as kind, cast(doc_id as varchar) as id, strlen(text) as n from documents union all select 'source', source, sum(strlen(text)) from documents group by source
  union all select 'page', cast(page_id as varchar), strlen(html) from pages),
u as (select *, case when n < 1048576 then n / 1024.0::double when n < 1073741824 then n / 1048576.0::double else n / 1073741824.0::double end as u,
  case when n < 1048576 then ' KB' when n < 1073741824 then ' MB' else ' GB' end as unit from b)
select kind, id, {_LABEL} as size from u""")
def t38_byte_size(t):
    d = t.documents.select("doc_id", "source", F.octet_length("text").cast("long").alias("n"))
    b = d.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "n")
    b = b.unionByName(d.groupBy(F.col("source").alias("id")).agg(F.sum("n").alias("n")).withColumn("kind", F.lit("source")))
    b = b.unionByName(t.pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("id"), F.octet_length("html").cast("long").alias("n")))
    return b.select("kind", "id", fx.byte_label(F.col("n")).alias("size"))


@query(r"""
with s as (select doc_id, unnest(string_split_regex(regexp_replace(text, '([.?!])\s+', '\1>>', 'g'), '>>')) as s from documents),
c as (select doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) as s from s)
select doc_id, s as sentence, count(*) as n from c where length(s) >= 13 group by all""")
def g06_sentences(t):
    s = t.documents.select("doc_id", F.explode(fx.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))




@query(r"""
with s as (select doc_id, unnest(string_split_regex(regexp_replace(text, '([.?!])\s+', '\1>>', 'g'), '>>')) as s from documents),
c as (select doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) as s from s),
k as (select doc_id, s,
  regexp_extract(s, '(?i)^(.*?)the ', 1) as b1, regexp_matches(s, '(?i)the ') as h1, regexp_extract(s, '(?i)^(.*?)of ', 1) as b2, regexp_matches(s, '(?i)of ') as h2 from c where length(s) >= 13),
p as (select doc_id, s, h1, h2, regexp_matches(substr(b1, greatest(length(b1) - 39, 1)), '(?i)(in|on) ') as n1, regexp_matches(substr(b2, greatest(length(b2) - 39, 1)), '(?i)(in|on) ') as n2 from k where h1 or h2)
select doc_id, h1 as illegal, h2 as unfair, case when (not h1 or n1) and (not h2 or n2) then 'deny' else 'assert' end as polarity, count(*) as n from p group by all""")
def d06_claims(t):
    claims = lx.claims(t.documents, {"illegal": "the ", "unfair": "of "}, negation="(?i)(in|on) ")
    return claims.groupBy("doc_id", "illegal", "unfair", "polarity").agg(F.count(F.lit(1)).alias("n"))


_KEYWORDS = [("en", "the", 2), ("en", "and", 1), ("de", "der", 2), ("de", "und", 1), ("fr", "les", 2), ("fr", "la", 1), ("es", "los", 2), ("es", "que", 1)]
_KW = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _KEYWORDS)


_THEME_SQL = f"""
with k(theme, kw, w) as (values {_KW}),
h as (select doc_id, theme, kw, w, len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9_])', '\\1\\1', 'g'), '(^|[^a-z0-9_])' || kw || '[a-z0-9_]*')) as n from documents, k),
s as (select doc_id, theme, sum(w * least(n, 3) + case when n >= 3 then w else 0 end) as score from h where n > 0 group by all)"""


@query(f"{_THEME_SQL} select doc_id, theme, cast(score as bigint) as score from s")
def a16_theme_scores(t):
    return lx.theme_scores(t.documents, _KEYWORDS)


@query(f"""{_THEME_SQL},
r as (select *, row_number() over (partition by doc_id order by score desc, theme) as k, max(score) over (partition by doc_id) as top from s),
t as (select doc_id, max(theme) filter (k = 1) as primary_theme, coalesce(array_to_string(list(theme order by k) filter (k between 2 and 3 and score >= greatest(2, 0.45 * top)), ','), '') as secondary from r group by doc_id)
select d.doc_id, coalesce(primary_theme, 'general') as primary_theme, coalesce(secondary, '') as secondary from documents d left join t using (doc_id)""")
def a17_primary_theme(t):
    return lx.primary_theme(t.documents, _KEYWORDS)


@query(f"""
with w as (select lang, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 and x not in ({_STOPS}))[1:60]) as term from documents),
c as (select lang, term, count(*) as n from w group by all)
select lang, term, n, rank from (select *, row_number() over (partition by lang order by n desc, term) as rank from c) where rank <= 18""")
def a23_top_terms(t):
    w = t.documents.select("lang", F.explode(F.slice(fx.token_list(F.col("text"), STOP), 1, 60)).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("rank <= 18")


@query("""
select doc_id, cast(sum(case when strpos(lower(text), q) = 0 then 0 when starts_with(lower(text), q) then 6 when regexp_matches(lower(text), '[ \\n]' || q) then 3 else 1 end) as bigint) as score
from documents, (values ('in'), ('th')) v(q) group by doc_id having min(strpos(lower(text), q)) > 0""")
def f06_all_terms_search(t):
    return lx.search(t.documents, ["in", "th"])


@query("""
select source, doc_id from documents where source in ('src1', 'src2', 'src3') and n_chars between 200 and 4000 and (lang = 'en' or lang = 'de') and contains(lower(text), 'tion')""")
def f02_review_filter(t):
    d = t.documents
    return d.where(F.col("source").isin("src1", "src2", "src3") & F.col("n_chars").between(200, 4000) & F.arrays_overlap(F.array("lang"), F.array(F.lit("en"), F.lit("de"))) & F.lower("text").contains("tion")).select("source", "doc_id")

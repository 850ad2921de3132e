"""URL filter with redirect equivalence (operator 2), in DataFrame functions only.

Rules decide by host suffix and path prefix, the longest rule first. Pages that no rule fits take
the decision of their alias class: the connected component of their address over redirect edges
(meta refresh) and canonical-link edges, all of a page, resolved against its address and base. An explicit allow in the class wins over any block in it;
with neither, the page is allowed. What stands in comments, scripts, styles, text areas and templates is no tag; a tag ends at the first > outside
its quotes; a refresh names its target with or without ``url=``.

An address is host + path, without scheme, query and fragment. Null urls, and urls without ``://``,
have an empty host and path and no aliases; no rule fits them. Repeated rows are judged alike. Null
html has no edges, and pages without edges are judged by themselves. An empty table gives an empty result. Very long pages are read whole. Extra
columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import ascii_lower, staged

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _undotted(path: Column) -> Column:
    """``path`` without its . and .. segments."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.contains("/."), F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")).otherwise(path)


def _resolved(to: Column, host: Column, path: Column) -> tuple[Column, Column]:
    """(host, path) that ``to`` names on a page of that address; null where it names no address."""
    folder = F.when(path.contains("/"), F.regexp_extract(path, "^((?s:.*)/)", 1)).otherwise("/")
    local = F.regexp_extract(to, "^[^?#]*", 0)
    absolute, scheme = to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    far = F.when(to.startswith("//"), F.concat(F.lit("x:"), to)).when(absolute, to)
    full = F.when(local == "", path).when(local.startswith("/"), local).otherwise(F.concat(folder, local))
    return F.when(far.isNotNull(), host_of(far)).when(~scheme, host), F.when(far.isNotNull(), _undotted(path_of(far))).when(~scheme, _undotted(full))


#: What holds no tags, to its end or to the page's.
NO_TAGS = ["<!--.*?(?:-->|$)", *[rf"<{t}\b.*?(?:</{t}\s*>|$)" for t in ("script", "style", "textarea", "template")]]
#: Attributes of a tag, quoted ones with whatever they hold. The loop never goes back, so long tags need no stack.
INSIDE = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: The target of a refresh: behind a time, or behind url=, or both.
REFRESH = r"(?is)^\s*+(?:[\d.]++(?:\s*+[;,]|\s)\s*+(?:url\s*+=\s*+)?|url\s*+=\s*+)[\"']?([^\"'\s]+)"


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's address and each address that a canonical link or meta refresh of it names, relative to its base."""
    tags = lambda name: F.regexp_extract_all("body", F.lit(rf"(?is)<{name}\b{INSIDE}"), 0)
    # Values end at their own quote, or without quotes at white space.
    value = lambda tag, name: F.trim(F.regexp_replace(F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*|'[^']*|[^\"'\s>]+)", 1), "^[\"']", ""))
    unquote = lambda c: F.trim(F.regexp_replace(c, "&amp;", "&"))
    links = F.transform(F.filter(tags("link"), lambda t: value(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")), lambda t: value(t, "href"))
    metas = F.transform(F.filter(tags("meta"), lambda t: F.lower(value(t, "http-equiv")) == "refresh"), lambda t: F.regexp_extract(value(t, "content"), REFRESH, 1))
    bases = F.filter(F.transform(tags("base"), lambda t: unquote(value(t, "href"))), lambda h: h != "")
    has = F.lower(F.col("html")).contains("canonical") | F.lower(F.col("html")).contains("refresh")
    named = pages.where(F.col("url").contains("://") & has).withColumn("body", F.regexp_replace("html", "(?is)" + "|".join(NO_TAGS), " "))
    found = named.select("host", "path", F.get(bases, F.lit(0)).alias("base"), F.explode(F.concat(links, metas)).alias("to")).where("to <> ''")
    base_host, base_path = _resolved(F.col("base"), F.col("host"), F.col("path"))
    found = found.select(F.concat("host", "path").alias("a"), F.coalesce(base_host, "host").alias("base_host"), F.coalesce(base_path, "path").alias("base_path"), unquote(F.col("to")).alias("to"))
    host, path = _resolved(F.col("to"), F.col("base_host"), F.col("base_path"))
    return found.select("a", F.concat(host, path).alias("b")).where("a <> b and b <> ''")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url, html)."""
    rules = RULES if rules is None else rules
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = _rule(F.col("host"), F.col("path"), rules)
    judged = pages.drop("html").withColumns({"rule": rule, "own": verdict, "node": F.concat("host", "path")}).drop("url")
    edges = staged(alias_edges(pages), "alias-edges")
    cols = ["page_id", "host", "path", "rule"]
    if edges.isEmpty():  # all classes are single addresses
        return judged.select(*cols, F.coalesce("own", F.lit("allow")).alias("verdict"))
    member = staged(components(edges), "aliases")
    # The targets count as members with the decisions that the rules make on them.
    node_host, node_path = F.regexp_extract("node", "^[^/]*", 0), F.regexp_extract("node", "^[^/]*(.*)$", 1)
    decided = member.withColumn("own", _rule(node_host, node_path, rules)[1])
    classes = decided.groupBy("root").agg(F.max(F.when(F.col("own") == "allow", True)).alias("allowed"), F.max(F.when(F.col("own") == "block", True)).alias("blocked"))
    verdicts = staged(member.join(classes, "root").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow").alias("shared")), "alias-verdicts")
    return judged.join(verdicts, "node", "left").select(*cols, F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))


def oracle(rules: list[tuple[str, str]] | None = None) -> str:
    """DuckDB SQL. Targets count if they are absolute or begin with / and pages have no base, as is so on the given pages."""

    def judged(columns: str) -> tuple[str, str]:
        host, path = columns.split()
        rule, verdict = "null", "null"
        for action, text in sorted(RULES if rules is None else rules, key=lambda r: (len(r[1]), r[1])):
            name, _, prefix = text.partition("/")
            fits = f"({host} = '{name}' or ends_with({host}, '.{name}')) and starts_with({path}, '/{prefix}')"
            rule, verdict = f"case when {fits} then '{text}' else {rule} end", f"case when {fits} then '{action}' else {verdict} end"
        return rule, verdict

    def address(url: str) -> tuple[str, str]:
        lower = f"translate(coalesce(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return lower, f"coalesce(regexp_extract({url}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"

    sql = lambda pattern: pattern.replace("++", "+").replace("*+", "*").replace("'", "''")
    value = lambda name: f"trim(regexp_replace(regexp_extract(tag, '(?is)[\\s\"''/]{name}\\s*=\\s*(\"[^\"]*|''[^'']*|[^\"''\\s>]+)', 1), '^[\"'']', ''))"
    (host, path), (to_host, to_path) = address("url"), address("target")
    rule, verdict = judged("host path")
    node = judged("regexp_extract(node,'^[^/]*') regexp_extract(node,'^[^/]*(.*)$',1)")[1]
    return f"""
with recursive cut as (select page_id, {host} as host, {path} as path, regexp_replace(html, '(?is){sql("|".join(NO_TAGS))}', ' ', 'g') as body, contains(url, '://') as named from pages),
own as (select page_id, host, path, host || path as node, cast({rule} as varchar) as rule, {verdict} as own from cut),
tag as (select host, path, unnest(list_concat(regexp_extract_all(body, '(?is)<link\\b{sql(INSIDE)}'), regexp_extract_all(body, '(?is)<meta\\b{sql(INSIDE)}'))) as tag from cut where named),
goal as (select host, path, replace(case when lower(tag[1:5]) = '<link' and regexp_matches({value("rel")}, '(?i)(^|\\s)canonical(\\s|$)') then {value("href")}
  when lower(tag[1:5]) = '<meta' and lower({value("http-equiv")}) = 'refresh' then regexp_extract({value("content")}, '{sql(REFRESH)}', 1) end, '&amp;', '&') as target from tag),
edge as (select distinct host || path as a, case when contains(target, '://') then {to_host} || {to_path} else host || regexp_extract(target, '^[^?#]*') end as b from goal where contains(target, '://') or starts_with(target, '/')),
side as (select a, b from edge where a <> b union select b, a from edge where a <> b),
reach as (select a, b from side union select reach.a, side.b from reach join side on side.a = reach.b),
known as (select a, b as node from reach union select a, a from reach),
class as (select a, max(({node}) = 'allow') as allowed, max(({node}) = 'block') as blocked from known group by a)
select page_id, host, path, rule, coalesce(own, case when allowed then 'allow' when blocked then 'block' end, 'allow') as verdict from own left join class on a = node"""

"""Profiles of fetched pages: links, fingerprints, templates, candidates, change logs, budgets."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx
from ..functions import urls as ux

# Kinds of documents by keyword, in order, and keyword weights.
KINDS = [("packet", "agenda-packet"), ("minutes", "minutes"), ("record of proceedings", "minutes"), ("agenda", "agenda"), ("staff report", "staff-report"), ("ordinance", "ordinance"), ("resolution", "resolution"), ("budget", "budget-finance"), ("audit", "budget-finance"), ("financial", "budget-finance"), ("proclamation", "proclamation")]
WEIGHTS = {
    "agenda": 12, "minutes": 12, "packet": 10, "ordinance": 9, "resolution": 8, "staff report": 8, "public hearing": 8, "budget": 7, "meeting": 6, "council": 6, "commission": 6,
    "board": 5, "planning": 5, "zoning": 5, "proclamation": 5, "record of proceedings": 9, "documents": 3, "archive": 4, "records": 4, "calendar": 3, "news": 2,
}
VERBS = "viewfile|viewagenda|getagenda|document|download|weblink"


def kind(text: Column, kinds: list[tuple[str, str]] = KINDS, other: str = "document") -> Column:
    """The first kind whose keyword occurs; dashes and underscores count as spaces."""
    blob = F.translate(F.lower(text), "-_", "  ")
    out = F.when(F.lit(False), "")
    for word, name in kinds:
        out = out.when(blob.contains(word), name)
    return out.otherwise(other)


def relevance(url: Column, anchor: Column, weights: dict[str, int] = WEIGHTS, verbs: str = VERBS, suffix: str = r"\.(?:pdf|txt)$") -> Column:
    """Keyword weights, and 8 for a document's suffix, 4 for a path verb, 5 for a date."""
    path = F.translate(F.lower(ux.path(url)), "-_", "  ")
    blob = F.concat(F.lower(anchor), F.lit(" "), path)
    score = F.lit(0)
    for word, w in weights.items():
        score = score + F.when(blob.contains(word), w).otherwise(0)
    dated = fx.first_date(F.concat(anchor, F.lit(" "), ux.path(url))).isNotNull()
    return score + F.when(F.rtrim(path).rlike(suffix), 8).otherwise(0) + F.when(path.rlike(verbs), 4).otherwise(0) + F.when(dated, 5).otherwise(0)


def plain_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments out, tags to spaces, common references decoded, white space collapsed."""
    c = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(char))
    return fx.collapse(c)


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, ord, href, anchor of each link, scripts and styles left out."""
    body = F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a\s*>"), 0)
    one = pages.select("page_id", "url", F.posexplode(found).alias("ord", "tag"))
    return one.select("page_id", "url", "ord", F.regexp_extract("tag", r"(?is)href\s*=\s*[\"']([^\"']*)", 1).alias("href"), plain_text(F.col("tag")).alias("anchor"))


def fingerprints(pages: DataFrame, platforms: dict[str, dict[str, str]]) -> DataFrame:
    """Per platform: observations, kinds of evidence, up to five examples, and confidence (high from two kinds).

    ``platforms``: patterns by kind of evidence. Markers of the body are looked for in the pages' ``server`` too, where they have that column.
    """
    tests = []
    places = [("host", "host", ux.host(F.col("url"))), ("url", "url", ux.path(F.col("url"))), ("body", "body", F.lower("html"))]
    if "server" in pages.columns:
        places.append(("header", "body", F.lower("server")))
    for name, p in platforms.items():
        for how, of, on in places:
            if p.get(of):
                tests.append(F.when(on.rlike(p[of]), F.struct(F.lit(name).alias("platform"), F.lit(how).alias("evidence"))))
    e = pages.select("url", F.inline(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    ranked = e.groupBy("platform", "url").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("evidence")).alias("kinds"))
    ranked = ranked.withColumn("k", F.row_number().over(W.partitionBy("platform").orderBy("url")))
    out = ranked.groupBy("platform").agg(
        F.sum("n").alias("observations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("url")))).alias("examples"),
    )
    return out.withColumn("confidence", F.when(F.size("kinds") >= 2, "high").otherwise("low"))


def template_clusters(pages: DataFrame, kinds: list[tuple[str, str]], document: str) -> DataFrame:
    """Per URL template: pages, up to five example URLs, whether any is a document, and how many of each kind."""
    p = pages.select("url", ux.template(F.col("url")).alias("template"), kind(F.col("url"), kinds).alias("kind"), F.lower(ux.path(F.col("url"))).rlike(document).alias("doc"))
    by_kind = p.groupBy("template", "kind").agg(F.count(F.lit(1)).alias("n"), F.bool_or("doc").alias("doc"))
    shape = by_kind.groupBy("template").agg(F.sum("n").alias("pages"), F.bool_or("doc").alias("is_document"), F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))).alias("kinds"))
    first = p.select("template", "url").distinct().withColumn("k", F.row_number().over(W.partitionBy("template").orderBy("url"))).where("k <= 5")
    return shape.join(first.groupBy("template").agg(F.array_sort(F.collect_list("url")).alias("examples")), "template")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer join of two crawls (url, sha): new, updated, unchanged, or gone (and retained)."""
    b, a = before.select("url", F.col("sha").alias("before")), after.select("url", F.col("sha").alias("after"))
    what = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "unchanged").otherwise("updated")
    return b.join(a, "url", "full_outer").select("url", "before", "after", what.alias("outcome"))


def budgeted(rows: DataFrame, budget: int, *by: str, most_pages: int | None = None, most_seconds: float | None = None) -> DataFrame:
    """Adds rank (score descending, then ord), used (bytes up to and with the row) and state within ``by``: scheduled while within all budgets, else pending.

    ``most_pages`` bounds the ranks, ``most_seconds`` the sum of ``seconds``, a column that is needed then. What is pending is carried over.
    """
    w = W.partitionBy(*by).orderBy(F.desc("score"), "ord")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({"rank": F.row_number().over(w), "used": F.sum("bytes").over(upto)})
    fits = F.col("used") <= budget
    if most_pages is not None:
        fits &= F.col("rank") <= most_pages
    if most_seconds is not None:
        fits &= F.sum("seconds").over(upto) <= most_seconds
    return out.withColumn("state", F.when(fits, "scheduled").otherwise("pending"))

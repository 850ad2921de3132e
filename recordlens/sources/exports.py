"""Folders of account exports: every file goes to the reader of its kind, and what the readers find becomes one table of turns.

Turns are rows of path, kind, title, prompt, output, ts, ts_raw and product. Texts of pages are blocks on lines of their own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import pages_markdown
from ..shared import written
from . import files

TURN = ["path", "kind", "title", "prompt", "output", "ts", "ts_raw", "product"]

#: Kinds of files by the end of their name, before those of ``files.EXPORT_KINDS``.
KINDS = [
    ("gems", r"gems_data\.html?$"), ("scheduled", r"scheduled_actions_data\.html?$"), ("inventory", r"archive_browser\.html?$"), ("account", r"debugging\.html?$"),
    ("activity_json", r"myactivity[^/]*\.json$"), *[(k, p) for k, p in files.EXPORT_KINDS if k != "activity_json"], ("json", r"\.json$"),
]


def lines_of(html: Column) -> Column:
    """Text of a page with a line for each block: tags out, references decoded, at most one empty line in a row."""
    broken = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)\s*>", "\n")
    c = F.regexp_replace(broken, r"(?s)<[^>]+>", "")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(char))
    c = F.regexp_replace(F.regexp_replace(c, "[  ]", " "), r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _blocks(pages: DataFrame) -> DataFrame:
    """(path, block, name): the parts of settings pages (path, text) that begin with a line "Name: ..."."""
    cut = F.split(lines_of(F.col("text")), r"(?m)^(?=Name:\s)")
    b = pages.select("path", F.explode(cut).alias("block"))
    return b.withColumn("name", F.trim(F.regexp_extract("block", r"^Name:[ \t]*([^\n]+)", 1))).where("name <> ''")


def _field(name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract("block", rf"(?m)^{name}:[ \t]*([^\n]+)", 1)), F.lit(""))


def _turns(rows: DataFrame, kind: str, product: str, **columns: Column) -> DataFrame:
    """``rows`` with the columns of turns; those not given are empty."""
    given = {"title": F.lit(None).cast("string"), "prompt": F.lit(""), "output": F.lit(""), "ts": F.lit(None).cast("timestamp"), "ts_raw": F.lit(None).cast("string")} | columns
    return rows.select("path", F.lit(kind).alias("kind"), *[given[c].alias(c) for c in ("title", "prompt", "output", "ts", "ts_raw")], F.lit(product).alias("product"))


def assistants(pages: DataFrame) -> DataFrame:
    """One turn for each assistant of a settings export: its name, and all its instructions as the prompt."""
    b = _blocks(pages)
    text = F.regexp_extract("block", r"(?s)Instructions:\s*(.*)$", 1)
    return _turns(b, "gem", "assistants", title=F.concat(F.lit("Gem — "), "name"), prompt=F.regexp_replace(F.when(F.contains("block", F.lit("Instructions:")), text).otherwise(F.col("block")), r"\s+$", ""))


def scheduled(pages: DataFrame) -> DataFrame:
    """One turn for each scheduled action: its name, and schedule, state and unread turns as the output."""
    b = _blocks(pages)
    unread = F.concat(_field("Unread conversation turns"), F.lit(" unread conversation turns"))
    said = F.concat_ws(" · ", F.concat(F.lit("Schedule: "), _field("Schedule")), F.concat(F.lit("State: "), _field("State")), unread)
    return _turns(b, "scheduled", "scheduled actions", title=F.concat(F.lit("Scheduled action — "), "name"), prompt=F.col("name"), output=said)


def account_pages(pages: DataFrame, least: int = 80) -> DataFrame:
    """One document for each page of ``least`` characters or more."""
    p = pages.select("path", lines_of(F.col("text")).alias("body"), F.trim(F.regexp_replace(F.regexp_extract("text", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")).alias("name")).where(F.length("body") >= least)
    return _turns(p, "document", "account", title=F.coalesce(F.nullif("name", F.lit("")), F.regexp_extract("path", r"([^/]*)$", 1)), output=F.col("body"))


def bookmarks(pages: DataFrame) -> DataFrame:
    """One turn for each bookmark in JSON (an object with a title, and a day in its metadata); other texts give none."""
    shape = "struct<title:string,metadata:struct<revisionData:struct<dateAdded:string>,sourceAddedTimestamp:string>>"
    b = pages.select("path", F.from_json("text", shape).alias("b")).where("b.title is not null")
    added = F.coalesce("b.metadata.revisionData.dateAdded", "b.metadata.sourceAddedTimestamp")
    return _turns(b, "bookmark", "reading list", title=F.col("b.title"), output=F.col("b.title"), ts=F.try_to_timestamp(added), ts_raw=F.coalesce(added, F.lit("unknown")))


def inventory(pages: DataFrame) -> DataFrame:
    """(path, services, service_count, total_files, folder_names, leaf_count) of an export's own list of its files.

    A service has an English name, a label and the number of files that it says it holds.
    """
    one = r'data-english-name="([^"]+)"\s+data-folder-name="([^"]+)">([^<]*)</h1>\s*</div>\s*(?:<div[^>]*>)?([\d,.]+ files?[^<]*)'
    found = F.regexp_extract_all("text", F.lit("(?s)" + one), 0)
    part = lambda s, k: F.trim(F.regexp_extract(s, "(?s)" + one, k))
    count = lambda s: F.regexp_replace(F.regexp_extract(part(s, 4), r"^([\d,.]+) file", 1), r"\D", "").try_cast("long")
    services = F.transform(found, lambda s: F.struct(part(s, 1).alias("service"), F.coalesce(F.nullif(part(s, 3), F.lit("")), part(s, 2)).alias("label"), count(s).alias("files")))
    names = F.regexp_extract_all("text", F.lit(r'class="extracted-folder-name">([^<]*)<'), 1)
    leaves = F.regexp_count("text", F.lit(r'class="file-leaf"><div class="extracted-file-name">[^<]*<'))
    p = pages.select("path", services.alias("services"), F.array_sort(F.array_distinct(F.transform(names, F.trim))).alias("folder_names"), leaves.cast("long").alias("leaf_count"))
    return p.select("path", "services", F.size("services").alias("service_count"), F.aggregate("services", F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["files"], F.lit(0))).alias("total_files"), "folder_names", "leaf_count")


def kind_of(path: Column, text: Column) -> Column:
    """The kind of a file by its name, and of JSON without a telling name by what it holds; null if no reader takes it."""
    name, kind = F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), F.lit(None).cast("string")
    for k, pattern in reversed(KINDS):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    head = F.ltrim(text)
    held = F.when(F.contains(text, F.lit('"Browser History"')), "browser").when(head.startswith("[") | text.rlike(r'"(?:items|activity)"\s*:\s*\['), "activity_json").when(F.contains(text, F.lit('"title"')), "bookmark")
    return F.when(kind == "json", held).when(kind.isNull() & ~name.contains(".") & head.startswith("<"), "page").otherwise(kind)


def turns(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of all files (path, text) of an export, and one row for each file: path, kind, turns.

    The files are read once, dealt by kind to their readers, and the readers' turns put together. A file that no reader takes, or in
    which its reader finds nothing, stays in the second table with its kind (or null) and no turns. Equal turns of a file stay apart.
    """
    known = written(texts.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("kind", kind_of(F.col("path"), F.col("text"))), "export")
    of = lambda kind: known.where(F.col("kind") == kind).select("path", "text")
    activity = files.activity_turns(of("activity"))
    items = files.activity_items(of("activity_json"))
    visits = files.browser_visits(of("browser"))
    pages = pages_markdown(of("page").withColumnsRenamed({"path": "page_id", "text": "html"})).withColumnRenamed("page_id", "path").where("markdown <> ''")
    found = [
        activity.select("path", "kind", F.lit(None).cast("string").alias("title"), "prompt", "output", files.activity_stamp(F.col("ts_raw")).cast("timestamp").alias("ts"), "ts_raw", "product"),
        items.select("path", "kind", F.lit(None).cast("string").alias("title"), "prompt", "output", F.col("ts").cast("timestamp").alias("ts"), "ts_raw", "product"),
        _turns(visits, "visit", "browser", title=F.col("title"), output=F.col("url"), ts=F.col("ts").cast("timestamp")),
        _turns(files.mail_counts(of("mail")), "mail", "mail", output=F.concat(F.col("messages").cast("string"), F.lit(" messages"))),
        _turns(pages, "document", "page", title=F.col("title"), output=F.col("markdown")),
        _turns(of("text").where(F.trim("text") != ""), "document", "text", title=F.trim(F.regexp_replace(F.split_part(F.ltrim("text"), F.lit("\n"), F.lit(1)), "^#+", "")), output=F.col("text")),
        assistants(of("gems")), scheduled(of("scheduled")), account_pages(of("account")), bookmarks(of("bookmark")),
        _turns(inventory(of("inventory")), "inventory", "export", output=F.concat(F.col("service_count").cast("string"), F.lit(" services, "), F.col("total_files").cast("string"), F.lit(" files"))),
    ]
    every = found[0].select(*TURN)
    for t in found[1:]:
        every = every.unionByName(t.select(*TURN))
    every = written(every, "turns")
    counts = every.groupBy("path").agg(F.count(F.lit(1)).alias("turns"))
    return every, known.select("path", "kind").join(counts, "path", "left").na.fill(0, ["turns"])

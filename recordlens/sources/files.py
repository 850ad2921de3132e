"""File sources: catalogs, CSV, JSON lines, text folders, activity exports; text extraction from nested records."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def extract_text(record: str, paths: str) -> Column:
    """Trimmed non-empty values at comma-separated dotted paths, joined by a blank line."""
    values = [F.nullif(F.trim(F.col(f"{record}.{p.strip()}" if record else p.strip()).cast("string")), F.lit("")) for p in paths.split(",")]
    return F.concat_ws("\n\n", *values)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header and multi-line fields; a byte order mark is dropped; _file is the row's file."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.lstrip("﻿") for c in rows.columns]
    return rows.withColumn("_file", F.col("_metadata.file_path")).toDF(*names, "_file")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no record keeps its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text) of each file below a folder."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of meetings."""
    schema = "date string, body string, youtube_id string, file string, topic string, note string, expected_file string, granicus_clip_id long"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def transcripts(catalog: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meetings with their text by date and body, meetings whose file is absent or not named).

    ``file`` is a path below the folder of texts, or such a path's end: folders count, so equal names in two folders
    are told apart. Of several files that fit, the first by path is taken.
    """
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    names = texts.select("path", F.explode(ends).alias("_file")).join(catalog.select(F.col("file").alias("_file")).distinct(), "_file", "left_semi").groupBy("_file").agg(F.min("path").alias("path"))
    t = names.join(texts.select("path", "text"), "path").drop("path")
    c = catalog.withColumn("_file", F.col("file"))
    return c.join(t, "_file").drop("_file").orderBy("date", "body"), c.join(t, "_file", "left_anti").drop("_file")


def flatten_features(rows: DataFrame) -> DataFrame:
    """Fields of ``attributes`` (or ``properties``) at the top, and the geometry as _geometry."""
    inner = "attributes" if "attributes" in rows.columns else "properties"
    geometry = F.col("geometry") if "geometry" in rows.columns else F.lit(None)
    return rows.select(f"{inner}.*", geometry.alias("_geometry"))


# Zones that activity exports write, as hours from UTC. No daylight saving is applied.
ZONES = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10}


def activity_stamp(c: Column) -> Column:
    """UTC time of "Mar 4, 2026, 1:02:03 PM MST"; null if it does not parse."""
    flat = F.regexp_replace(c, r"[  ]", " ")
    zone = F.regexp_extract(flat, r"([A-Z]{2,4})\s*$", 1)
    wall = F.try_to_timestamp(F.trim(F.regexp_replace(flat, r"\s*[A-Z]{3,4}\s*$", "")), F.lit("MMM d, yyyy, h:mm:ss a"))
    hours = F.lit(None).cast("int")
    for name, offset in ZONES.items():
        hours = F.when(zone == name, offset).otherwise(hours)
    return wall - F.make_dt_interval(hours=hours)


def activity_turns(pages: DataFrame) -> DataFrame:
    """Turns of an activity export (path, text): one per outer cell, with product, verb, prompt, output, stamp and kind."""
    cell = F.explode(F.expr(r"""slice(split(text, '<div class="outer-cell'), 2, 1000000)""")).alias("cell")
    c = pages.select("path", cell)
    body = F.regexp_extract("cell", r"(?s)<div class=\"content-cell[^\"]*\">(.*?)</div>", 1)
    stamp = r"([A-Z][a-z]{2} \d{1,2}, \d{4}, \d{1,2}:\d{2}:\d{2}[\s  ][AP]M [A-Z]{2,4})"
    text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"\s+", " "))
    c = c.select("path", F.regexp_extract("cell", r"(?s)header-cell[^>]*>\s*<p[^>]*>(.*?)<br", 1).alias("product"), body.alias("body"))
    verb = F.regexp_extract("body", r"^\s*(Prompted|Searched for|Asked|Used|Visited)", 1)
    before = F.split_part(F.regexp_replace("body", stamp, "\x00$1\x00"), F.lit("\x00"), F.lit(1))
    after = F.regexp_extract("body", stamp + r"(?s)(.*)$", 2)
    return c.select(
        "path",
        text(F.col("product")).alias("product"),
        verb.alias("verb"),
        F.when(verb.isin("Prompted", "Asked"), "prompt").when(verb == "Searched for", "search").otherwise("event").alias("kind"),
        F.trim(F.regexp_replace(text(before), "^(?:Prompted|Searched for|Asked|Used|Visited)", "")).alias("prompt"),
        F.regexp_extract("body", stamp, 1).alias("ts_raw"),
        text(after).alias("output"),
    )


_ITEM = "struct<header:string,title:string,time:string,subtitles:array<string>,details:array<string>>"


def activity_items(pages: DataFrame, product: str = "Google") -> DataFrame:
    """Turns of activity exports in JSON (path, text): a list, or an object whose ``items`` or ``activity`` is one.

    Subtitles (names, or objects with a name) become the prompt, details the output; an entry without a prompt is an event.
    Texts that are no JSON give no turns.
    """
    shape = F.when(F.ltrim("text").startswith("["), F.from_json("text", f"array<{_ITEM}>"))
    whole = F.from_json("text", f"struct<items:array<{_ITEM}>,activity:array<{_ITEM}>>")
    one = F.from_json("text", _ITEM)
    lone = F.when(F.coalesce(one["title"], one["header"], one["time"]).isNotNull(), F.array(one))
    i = pages.select("path", F.posexplode(F.coalesce(shape, whole["items"], whole["activity"], lone)).alias("k", "i"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+", " "))
    name = lambda s: plain(F.when(s.startswith("{"), F.get_json_object(s, "$.name")).otherwise(s))
    joined = lambda c, by: F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), by)
    none = F.expr("cast(array() as array<string>)")
    prompt = joined(F.transform(F.coalesce("i.subtitles", none), name), "\n")
    source = F.coalesce(F.nullif("i.header", F.lit("")), F.lit(product))
    return i.select(
        "path", "k", source.alias("product"), F.when(prompt != "", "prompt").otherwise("event").alias("kind"), F.try_to_timestamp("i.time").alias("ts"),
        F.col("i.time").alias("ts_raw"), prompt.alias("prompt"), joined(F.coalesce("i.details", none), "\n\n").alias("output"),
    )


# Headers that drive listings use, by the column they fill, the first that is there.
DRIVE_HEADERS = {"name": ["title", "filename", "name", "file name"], "url": ["url", "link", "webviewlink"], "created": ["created", "creation time", "date"]}


def drive_rows(rows: DataFrame) -> DataFrame:
    """name, url, created of a drive listing (``read_csv``), whatever its headers are called; without a name "(unnamed)"."""
    by = {c.strip().strip('"').lower(): c for c in rows.columns}

    def first(column: str) -> Column:
        return next((F.col(f"`{by[h]}`") for h in DRIVE_HEADERS[column] if h in by), F.lit(None).cast("string"))

    empty = F.lit("")
    return rows.select(F.coalesce(F.nullif(first("name"), empty), F.lit("(unnamed)")).alias("name"), F.coalesce(first("url"), empty).alias("url"), F.coalesce(first("created"), empty).alias("created"))


def browser_visits(pages: DataFrame) -> DataFrame:
    """path, url, title, ts of browser histories in JSON (path, text); texts that are no history give no rows."""
    visit = "array<struct<url:string,title:string,time_usec:long>>"
    h = F.from_json("text", f"struct<`Browser History`:{visit},history:{visit}>")
    v = pages.select("path", F.explode(F.coalesce(h["Browser History"], h["history"])).alias("v"))
    return v.select("path", "v.url", "v.title", F.timestamp_micros(F.nullif("v.time_usec", F.lit(0))).alias("ts"))


def mail_counts(texts: DataFrame) -> DataFrame:
    """path and the number of messages of mailboxes (path, text)."""
    return texts.select("path", F.regexp_count("text", F.lit("(?m)^From ")).cast("long").alias("messages"))


#: Kinds of export files by the end of their name, the first that fits.
EXPORT_KINDS = [("mail", r"\.mbox$"), ("drive", r"\.csv$"), ("browser", r"browserhistory\.json$"), ("activity_json", r"\.json$"), ("activity", r"myactivity\.html?$"), ("page", r"\.(?:mht(?:ml)?|html?)$"), ("text", r"\.(?:txt|md)$")]


def export_kind(path: Column) -> Column:
    """Which reader a file of an export goes to, by its name; null if none does."""
    name, kind = F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), F.lit(None).cast("string")
    for k, pattern in reversed(EXPORT_KINDS):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    return kind

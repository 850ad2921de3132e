"""Sources and sinks on small files."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from recordlens.sources import files, sinks
from recordlens.sources.paged import PagedRecords

sys.path.insert(0, os.path.dirname(__file__))


@pytest.mark.parametrize("options, ids", [({}, [0, 1, 2, 3, 4]), ({"total": 5}, [0, 1, 2, 3, 4]), ({"maxRecords": 3, "total": 5}, [0, 1, 2]), ({"where": "id >= 2"}, [2, 3, 4])])
def test_paged_offsets(spark, options, ids):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "paged_fixture.py"))
    spark.dataSource.register(PagedRecords)
    rows = spark.read.format("paged_records").options(reader="paged_fixture.offset", pageSize="2", pagesPerTask="2", **{k: str(v) for k, v in options.items()}).load()
    assert [json.loads(r.record)["id"] for r in rows.orderBy("ordinal").collect()] == ids


@pytest.mark.parametrize("dialect", ["offset", "feature"])
def test_paged_ranges_and_pushed_bounds(spark, dialect):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "paged_fixture.py"))
    spark.dataSource.register(PagedRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("paged_records").options(reader=f"paged_fixture.{dialect}", dialect=dialect, pageSize="1", pagesPerTask="2", pushDown="true").load()
        assert rows.rdd.getNumPartitions() == 3 and sorted(r.ordinal for r in rows.collect()) == [0, 1, 2, 3, 4]  # no total is known
        for condition, want in (("ordinal >= 1 and ordinal < 4", [1, 2, 3]), ("ordinal = 2", [2]), ("ordinal > 3", [4]), ("ordinal <= 0", [0]), ("ordinal > 9", []), ("ordinal >= 3 and record like '%4%'", [4])):
            found = rows.where(condition)
            assert sorted(r.ordinal for r in found.collect()) == want, condition
        plan = rows.where("ordinal >= 3")._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan" in plan and "Filter " not in plan  # the source has taken the condition
        assert "Filter " in rows.where("record like '%4%'")._jdf.queryExecution().executedPlan().toString()
        assert rows.where("ordinal >= 3").rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_paged_features(spark):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "paged_fixture.py"))
    spark.dataSource.register(PagedRecords)
    rows = spark.read.format("paged_records").options(reader="paged_fixture.feature", dialect="feature", pageSize="2").load()
    r = rows.select("ordinal", F.from_json("record", "attributes struct<OBJECTID:long,NOTES:string>, geometry struct<x:double>").alias("r")).select("ordinal", "r.*")
    flat = files.flatten_features(r.drop("ordinal")).orderBy("OBJECTID")
    assert flat.columns == ["OBJECTID", "NOTES", "_geometry"] and [x.OBJECTID for x in flat.collect()] == [0, 1, 2, 3, 4]


def test_catalog_and_transcripts(spark, tmp_path):
    (tmp_path / "t" / "x").mkdir(parents=True)
    (tmp_path / "t" / "y").mkdir()
    (tmp_path / "t" / "x" / "a.md").write_text("---\n[00:00:01] hello")
    (tmp_path / "t" / "y" / "a.md").write_text("---\n[00:00:01] another")
    (tmp_path / "m.json").write_text(json.dumps([{"date": "2026-01-05", "body": "council", "file": "x/a.md"}, {"date": "2026-01-06", "body": "council", "file": None}, {"date": "2026-01-07", "body": "c", "file": "b.md"}]))
    found, missing = files.transcripts(files.read_catalog(spark, str(tmp_path / "m.json")), files.read_texts(spark, str(tmp_path / "t"), "*.md"))
    assert [(r.date, r.text[-5:]) for r in found.collect()] == [("2026-01-05", "hello")] and sorted(r.date for r in missing.collect()) == ["2026-01-06", "2026-01-07"]


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿id,notes\n1,\"two\nlines\"\n2,plain\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["id", "notes", "_file"] and [r.notes for r in got.orderBy("id").collect()] == ["two\nlines", "plain"]


def test_append_and_rebuild(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "")], "id long, notes string")
    path = str(tmp_path / "sink")
    sinks.rebuild(rows, path, "id", "notes")
    assert spark.read.json(path).count() == 2
    sinks.append(rows, path, "id", "notes")
    assert spark.read.json(path).count() == 2
    sinks.append(spark.createDataFrame([(9, "z")], rows.schema), path, "id", "notes")
    assert spark.read.json(path).count() == 3
    m = sinks.manifest(rows, rows.where("id = 1"), "id", "notes").first()
    assert (m.seen, m.written, m["empty"], m.duplicate) == (3, 1, 1, 1)


def test_dead_letters(spark):
    lines = spark.createDataFrame([('{"id": 1}',), ("{broken",)], "value string")
    good, bad = sinks.dead_letters(lines, "id long")
    assert [r.id for r in good.collect()] == [1] and [r.line for r in bad.collect()] == ["{broken"]


def test_extract_text(spark):
    df = spark.sql("select named_struct('a', named_struct('b', ' x '), 'c', 'y', 'd', '  ') as r")
    assert df.select(files.extract_text("r", "a.b,c,d")).first()[0] == "x\n\ny"


def test_activity_export(spark):
    cell = '<div class="outer-cell mdl"><div class="header-cell"><p class="t">Gemini Apps<br></p></div><div class="content-cell mdl-cell">Prompted what is &lt;this&gt;<br>Mar 4, 2026, 1:02:03 PM MST<br><p>An answer.</p></div></div>'
    got = files.activity_turns(spark.createDataFrame([("p", cell)], "path string, text string")).withColumn("ts", files.activity_stamp(F.col("ts_raw"))).first()
    assert (got["product"], got.kind, got.output) == ("Gemini Apps", "prompt", "An answer.") and str(got.ts) == "2026-03-04 20:02:03"


def test_activity_items_visits_and_listings(spark):
    one = '{"header":"Search","title":"t","time":"2026-03-04T01:02:03Z","subtitles":[{"name":"<b>who</b> is"},{"x":1}],"details":["a","b"]}'
    rows = [("list", f"[{one}]"), ("items", f'{{"items":[{one},{{"title":"x"}}]}}'), ("lone", '{"title":"only"}'), ("bad", "no json"), ("null", None)]
    got = sorted((r.path, r.k, r.product, r.kind, str(r.ts), r.prompt, r.output) for r in files.activity_items(spark.createDataFrame(rows, "path string, text string")).collect())
    full = ("Search", "prompt", "2026-03-04 01:02:03", "who is", "a\n\nb")
    assert got == [("items", 0, *full), ("items", 1, "Google", "event", "None", "", ""), ("list", 0, *full), ("lone", 0, "Google", "event", "None", "", "")]
    h = [("a", '{"Browser History":[{"url":"u","title":"t","time_usec":1000000},{"url":"v"}]}'), ("b", "{}"), ("c", "[")]
    assert [(r.url, str(r.ts)) for r in files.browser_visits(spark.createDataFrame(h, "path string, text string")).orderBy("url").collect()] == [("u", "1970-01-01 00:00:01"), ("v", "None")]
    d = files.drive_rows(spark.createDataFrame([("f", "http://x", "2026"), (None, None, "")], "`File Name` string, Link string, `Creation Time` string").coalesce(1))
    assert [tuple(r) for r in d.collect()] == [("f", "http://x", "2026"), ("(unnamed)", "", "")]
    assert files.mail_counts(spark.createDataFrame([("m", "From a\nx From b\nFrom c\n")], "path string, text string")).first().messages == 2
    kinds = {"x/Mail.MBOX": "mail", "BrowserHistory.json": "browser", "My/MyActivity.html": "activity", "a.json": "activity_json", "p.mhtml": "page", "n.md": "text", "x.bin": None}
    assert {r.p: r.k for r in spark.createDataFrame([(p,) for p in kinds], "p string").withColumn("k", files.export_kind(F.col("p"))).collect()} == kinds

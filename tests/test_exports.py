"""Exports of accounts: each kind of file, and a folder of all of them."""

import json

from recordlens.sources import exports

GEMS = "<html><body><p>Name: Tutor</p><p>Instructions: Explain<br>step by step &amp; slowly.</p><div>Name: Critic</div><div>Instructions: Be brief.</div></body></html>"
SCHEDULED = "<div>Name: Morning list</div><div>Schedule: daily at 7</div><div>State: active</div><div>Unread conversation turns: 3</div><div>Name: Weekly</div><div>State: paused</div>"
BROWSER = '<h1 data-english-name="Mail" data-folder-name="M">Post</h1></div><div>1,204 files, 3 MB</div><h1 data-english-name="Maps" data-folder-name="Karten"></h1> </div> 2 files<div class="extracted-folder-name">Inbox<</div><div class="extracted-folder-name">Inbox</div><div class="file-leaf"><div class="extracted-file-name">a.mbox</div></div>'
ITEM = {"header": "Assistant", "title": "Prompted", "time": "2026-01-05T10:00:00Z", "subtitles": [{"name": "hello"}], "details": ["answer"]}
FILES = {
    "x/gems_data.html": GEMS, "x/scheduled_actions_data.html": SCHEDULED, "x/archive_browser.html": BROWSER, "x/Login Debugging.html": "<title>Sign in</title><p>" + "word " * 30 + "</p>",
    "x/short debugging.html": "<p>short</p>", "x/MyActivity.json": json.dumps([ITEM, ITEM]), "x/other.json": json.dumps({"items": [ITEM]}), "x/mark.json": json.dumps({"title": "A page", "metadata": {"revisionData": {"dateAdded": "2026-02-01T00:00:00Z"}}}),
    "x/BrowserHistory.json": json.dumps({"Browser History": [{"url": "https://a", "title": "A", "time_usec": 1}]}), "x/box.mbox": "From a\n\nFrom b\n", "x/page.html": "<h1>Head</h1><p>text</p>", "x/notes.md": "# Notes\nbody",
    "x/empty.txt": "", "x/odd.json": "{}", "x/picture.png": "PNG", "x/saved": "<p>saved page</p>",
}


def frame(spark, names):
    return spark.createDataFrame([(n, FILES[n]) for n in names] + [("y/null.txt", None)], "path string, text string")


def test_settings_blocks(spark):
    got = [(r.title, r.prompt) for r in exports.assistants(frame(spark, ["x/gems_data.html"])).collect()]
    assert got == [("Gem — Tutor", "Explain\nstep by step & slowly."), ("Gem — Critic", "Be brief.")]
    got = [(r.prompt, r.output) for r in exports.scheduled(frame(spark, ["x/scheduled_actions_data.html"])).collect()]
    assert got == [("Morning list", "Schedule: daily at 7 · State: active · 3 unread conversation turns"), ("Weekly", "State: paused")]


def test_bookmarks_and_inventory(spark):
    r = exports.bookmarks(frame(spark, ["x/mark.json", "x/odd.json"])).collect()
    assert [(x.title, str(x.ts), x.ts_raw) for x in r] == [("A page", "2026-02-01 00:00:00", "2026-02-01T00:00:00Z")]
    r = exports.inventory(frame(spark, ["x/archive_browser.html"])).where("path like 'x%'").first()
    assert [tuple(s) for s in r.services] == [("Mail", "Post", 1204), ("Maps", "Karten", 2)]
    assert (r.service_count, r.total_files, r.folder_names, r.leaf_count) == (2, 1206, ["Inbox"], 1)


def test_no_file_is_lost(spark):
    turns, files = exports.turns(frame(spark, FILES))
    assert turns.columns == exports.TURN
    assert {r.path: (r.kind, r.turns) for r in files.collect()} == {
        "x/gems_data.html": ("gems", 2), "x/scheduled_actions_data.html": ("scheduled", 2), "x/archive_browser.html": ("inventory", 1), "x/Login Debugging.html": ("account", 1), "x/short debugging.html": ("account", 0),
        "x/MyActivity.json": ("activity_json", 2), "x/other.json": ("activity_json", 1), "x/mark.json": ("bookmark", 1), "x/BrowserHistory.json": ("browser", 1), "x/box.mbox": ("mail", 1), "x/page.html": ("page", 1),
        "x/notes.md": ("text", 1), "x/empty.txt": ("text", 0), "x/odd.json": (None, 0), "x/picture.png": (None, 0), "x/saved": ("page", 1), "y/null.txt": ("text", 0),
    }
    by = {r.path: r for r in turns.collect()}
    assert by["x/page.html"].output == "# Head\n\ntext" and by["x/notes.md"].title == "Notes" and by["x/box.mbox"].output == "2 messages"
    assert by["x/other.json"].prompt == "hello" and by["x/other.json"].output == "answer" and by["x/saved"].output == "saved page"
    none, nothing = exports.turns(frame(spark, []).where("false"))
    assert none.count() == nothing.count() == 0

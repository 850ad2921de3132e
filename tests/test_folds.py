"""Folds against fixed results and brute force."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from recordlens.operators import folds
from recordlens.operators import lexicon as lx
from recordlens.plans import records


def test_rolling_captions(spark):
    cues = [["hello there"], ["hello there", "how are"], ["how are", "you you"], [], ["you you", "you you"], ["other"]]
    df = spark.createDataFrame([(1, k, float(k), c) for k, c in enumerate(cues)], "doc int, ord int, start double, lines array<string>")
    got = [r.line for r in folds.caption_lines(df).orderBy("ord", "k").collect()]
    assert got == ["hello there", "how are", "you you", "you you", "other"]


def test_packing(spark):
    df = spark.createDataFrame([(1, [(0.0, "aaaa"), (1.0, "bbb"), (2.0, "cccccccccccc"), (3.0, "d")])], "doc int, lines array<struct<start:double,line:string>>")
    got = df.select(folds.pack_lines(F.col("lines"), 8).alias("p")).first().p
    assert [(p.start, p.text) for p in got] == [(0.0, "aaaa bbb"), (2.0, "cccccccccccc"), (3.0, "d")]


def test_passages(spark):
    body = " ".join(f"Word{k} goes on." for k in range(400))
    text = f"# Title\nDate: x\n---\n[00:00:05] {body} [00:10:00] More words here. [00:20:00]   \n[00:30:00] Adjourned."
    got = folds.passages(spark.createDataFrame([(7, text), (8, ""), (9, None)], "doc int, text string"), 1200).collect()
    assert got[0].start == "00:00:05" and got[-1].end == "00:30:00" and got[-1].text.endswith("Adjourned.")
    assert all(len(r.text) <= 2450 for r in got) and [r.passage for r in got] == list(range(len(got)))
    assert " ".join(r.text for r in got) == f"{body} More words here. Adjourned."


def test_roles(spark):
    rows = [(1, "Item five is next.", True), (2, "I open public comment. Good evening.", False), (3, "It is unconstitutional.", False), (4, "Thank you. " + "x" * 90 + " we close public comment", False), (5, "We deny that.", False)]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc int, seq int, text string, anchor boolean")
    got = [r.role for r in folds.roles(df, "open public comment", "close public comment").orderBy("seq").collect()]
    assert got == ["agenda_reading", "public_comment", "public_comment", "public_comment", "official"]


@pytest.mark.parametrize("seed", range(4))
def test_chain_is_heaviest(spark, seed):
    rng = random.Random(seed)
    rows = [(0, rng.randint(0, 7), rng.randint(0, 7), float(rng.randint(1, 9))) for _ in range(11)]
    best = 0.0
    for k in range(1 << len(rows)):
        chosen = sorted(r for i, r in enumerate(rows) if k >> i & 1)
        if all(a[1] < b[1] and a[2] < b[2] for a, b in zip(chosen, chosen[1:], strict=False)):
            best = max(best, sum(r[3] for r in chosen))
    got = sorted(tuple(r) for r in folds.chain(spark.createDataFrame(rows, "doc int, seq int, item int, score double")).collect())
    assert sum(r[3] for r in got) == best and all(a[1] < b[1] and a[2] < b[2] for a, b in zip(got, got[1:], strict=False))


def test_greedy_groups(spark):
    rows = [("b", 0, 0, ["x", "y", "z"]), ("b", 1, 10, ["x", "y", "w"]), ("b", 2, 20, ["q"]), ("b", 3, 400, ["x", "y", "w"]), ("b", 4, 25, None)]
    got = {r.ord: r.grp for r in folds.greedy_groups(spark.createDataFrame(rows, "block string, ord int, day int, tokens array<string>"), 0.5, 200).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 4: 2, 3: 3}


def test_greedy_groups_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"b{rng.randint(0, 2)}", k, k // 3, rng.sample("abcdefgh", rng.randint(0, 5))) for k in range(300)]
    want, lasts = {}, {}
    for block, k, day, tokens in rows:
        groups, mine = lasts.setdefault(block, []), set(tokens)
        near = [(len(mine & t) / max(1, len(mine | t)), -g) for g, (d, t) in enumerate(groups) if day - d <= 6]
        sim, g = max(near, default=(-1, 0))
        if sim >= 0.5:
            want[k], groups[-g] = -g, (day, mine)
        else:
            want[k] = len(groups)
            groups.append((day, mine))
    df = spark.createDataFrame(rows, "block string, ord int, day int, tokens array<string>").repartition(5)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")  # blocks go over many batches
    try:
        assert {r.ord: r.grp for r in folds.greedy_groups(df, 0.5, 6).collect()} == want
    finally:
        spark.conf.set(key, before)


def test_lifecycle_groups_read_whole_texts(spark):
    head = " ".join(f"open{k}" for k in range(12))
    texts = [head + "".join(f" left{k}" for k in range(80)), head + "".join(f" right{k}" for k in range(80))]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate([*texts, *texts])], "doc_id long, text string, lang string, source string")
    got = {r.ord: r.grp for r in records.g14_lifecycle_groups(SimpleNamespace(documents=docs)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1}


def test_default_lexicon(spark):
    texts = [
        "Vehicle operator detained under municipal code dispute; field verification prolonged past standard inspection timeline awaiting secondary unit.",
        "warranty expired; the ordinances and warrants were reviewed",
        "warranty expired",
        "the detention pond was built",
        "he was held in detention",
        "this does not warrant further review",
        "I think we met in executive session without notice, and I believe it.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: ({(h.category, h.term) for h in r.hits}, r.score, r.flagged) for r in lx.scored(df, lx.DEFAULT).collect()}
    assert got[0] == ({("deviation", "timeline"), ("deviation", "prolonged"), ("statutory", "municipal code"), ("enforcement", "detained")}, 5.0, True)
    assert {t for _, t in got[1][0]} == {"warrant", "ordinance"} and got[2][0] == set() and got[3][0] == set()
    assert got[4][0] == {("enforcement", "detention")} and got[5][0] == set()
    modes = lx.rhetoric(df, lx.DEFAULT).where("doc_id = 6").first()
    assert modes.subjective == 2 and modes.dominant == "subjective" and modes.objectivity == 0.0


def test_packed_words(spark):
    texts = ["one two  three\nfour", "", None, "a-very-long-word x y", "𝒳𝒳𝒳 𝒳𝒳𝒳 z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").coalesce(1)
    got = [tuple(r) for r in folds.packed_words(df, 8).orderBy("doc", "ord").collect()]
    assert got == [(0, 0, "one two"), (0, 1, "three"), (0, 2, "four"), (3, 0, "a-very-long-word"), (3, 1, "x y"), (4, 0, "𝒳𝒳𝒳 𝒳𝒳𝒳"), (4, 1, "z")]


def test_greedy_groups_meet_by_stretches_of_time(spark, monkeypatch):
    # Actions far apart in time are never joined, whatever they share: no token is a key of a join.
    seen, plain = [], folds.connected
    monkeypatch.setattr(folds, "connected", lambda edges: (seen.append(edges._jdf.queryExecution().optimizedPlan().toString()), plain(edges))[1])
    rows = [("a", k, k * 50, ["same", f"own{k % 3}"]) for k in range(12)]
    got = {r.ord: r.grp for r in folds.greedy_groups(spark.createDataFrame(rows, "block string, ord int, day int, tokens array<string>"), 0.5, 200).collect()}
    assert got == {k: k % 3 for k in range(12)} and "stretch" in seen[0] and "token#" not in seen[0]

"""Alignment and checks against fixed results."""

import collections
import datetime as dt
import difflib
import itertools
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from recordlens import shared
from recordlens.functions import text as fx
from recordlens.operators import alignment, checks, folds, lexicon, names, records, similarity, threads


def test_item_numbers(spark):
    said = {"7": "7", "seven": "7", "Twenty one": "21", "twenty": "20", "7b": "7B", "seven b": "7B", "for": None, "to discuss": None, "hello": None, "thirty-two c": "32C"}
    got = {r.s: r.n for r in spark.createDataFrame([(s,) for s in said], "s string").withColumn("n", alignment.item_number(F.col("s"))).collect()}
    assert got == said


def test_aligned(spark):
    seg = [(1, 0, 0, "Good evening."), (1, 1, 200, "Item number nine again"), (1, 2, 300, "Next item is number 7 about downtown parking meters"), (1, 3, 400, "talk"), (1, 4, 500, "number eight, liquor license transfer")]
    items = [(1, 7, "7", "Downtown parking meters"), (1, 8, "8", "Liquor license transfer"), (1, 9, "9", "Other business")]
    got = alignment.aligned(spark.createDataFrame(seg, "doc int, seq int, ts int, text string"), spark.createDataFrame(items, "doc int, item int, number string, title string"))
    assert [(r.item, r.start, r.end) for r in got.orderBy("seq").collect()] == [(7, 300, 500), (8, 500, None)]


def test_merged_threads(spark):
    day = 86400
    rows = [("a", 0, 0, 9, {"x": 1, "y": 1}), ("a", 1, day, 30 * day, {"x": 1, "z": 1}), ("a", 2, 2 * day, 2 * day, {"q": 1}), ("a", 3, 40 * day, 40 * day, {"x": 1}), ("a", 4, 70 * day, 70 * day, {"x": 1}), ("b", 0, 0, 0, {})]
    df = spark.createDataFrame(rows, "owner string, session int, start long, end long, counts map<string,int>")
    got = {(r.owner, r.session): r.thread for r in alignment.merged_threads(df).collect()}
    # Session 3 is near the last turn of thread 0, not its start; session 4 is too late.
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 0, ("a", 4): 2, ("b", 0): 0}
    many = [("a", k, k * 60, k * 60, {f"t{k}": 1} if k else {"x": 1}) for k in range(13)] + [("a", 13, 2000, 2000, {"x": 1})]
    got = alignment.merged_threads(spark.createDataFrame(many, df.schema)).where("session = 13").first()
    assert got.thread == 13  # twelve threads were opened since


def test_homophones(spark):
    said = [("Next item is for, the fence", "4"), ("next item is number a.", "8"), ("an item to discuss", None), ("won the item", None)]
    seg = spark.createDataFrame([(1, k, k, s) for k, (s, _) in enumerate(said)], "doc int, seq int, ts int, text string")
    assert {r.seq: r.number for r in alignment.anchors(seg).collect()} == {k: n for k, (_, n) in enumerate(said) if n}


def test_resolved_names(spark):
    members = spark.createDataFrame([("c", "Rinner", None), ("c", "Allard", "Dr"), ("c", "Kramer", "Mayor"), ("c", "Brook", None)], "body string, member string, title string")
    said = [("Mr.", "Rinder", "Rinner", 0.83), ("Dr.", "Alard", "Allard", 0.91), ("Mr", "Alard", None, None), ("Mayor", "Somebody", "Kramer", 1.0), ("Ms", "Crook", "Brook", 0.8), ("Mr", "Kramer", None, None)]
    names_ = spark.createDataFrame([("c", t, n, 1) for t, n, _, _ in said], "body string, title string, name string, mentions long")
    got = {(r.title, r.name): (r.member, r.score) for r in names.resolve(names_, members).collect()}
    for t, n, member, score in said:
        assert got[(t.rstrip("."), n)][0] == member and (score is None or got[(t.rstrip("."), n)][1] == score), (t, n, got)


def test_clean_minutes(spark):
    said = {"Dr. Ames moved 15- 1-402": "Dr Ames moved 15-1-402", "owner -occupied, Mr. X": "owner-occupied, Mr X", 'A , B voted "no."': 'A, B voted "no".', "re- turn": "re- turn"}
    got = {r.s: r.c for r in spark.createDataFrame([(s,) for s in said], "s string").withColumn("c", records.clean_minutes(F.col("s"))).collect()}
    assert got == said


def test_contiguous(spark):
    rows = [("s", 0), ("s", 1), ("s", 3), ("t", 1), ("u", 0)]
    got = records.contiguous(spark.createDataFrame(rows, "session string, n long"), "session", "n").collect()
    assert {tuple(r) for r in got} == {("s", 0), ("s", 1), ("u", 0)}


def test_term_plurals(spark):
    said = [("LEADS spoke; leads", "LEADS", 1), ("CATs and CAT", "CAT", 1), ("warrants, warrant, warranty", "warrant", 2), ("éclair clair", "clair", 1)]
    for s, term, n in said:
        assert spark.createDataFrame([(s,)], "s string").select(fx.count_term(F.col("s"), term)).first()[0] == n, s


def test_packed_paragraphs(spark):
    text = " ".join(f"word{k}" for k in range(3000))
    lines = F.transform(F.split("s", " "), lambda w, i: F.struct(i.cast("double").alias("start"), w.alias("line")))
    got = [r.text for r in spark.createDataFrame([(text,)], "s string").select(F.explode(folds.pack_lines(lines, 40)).alias("p")).select("p.text").collect()]
    want = [""]
    for w in text.split():
        want = [*want[:-1], f"{want[-1]} {w}".strip()] if len(want[-1]) + 1 + len(w) <= 40 or not want[-1] else [*want, w]
    assert got == want


def test_postponements(spark):
    d = dt.date
    p = [(1, d(2026, 2, 2), ["fence", "code", "north"]), (2, d(2026, 2, 2), ["liquor"]), (3, d(2026, 2, 3), ["park"]), (4, d(2027, 1, 1), ["road"]), (5, d(2026, 2, 2), ["water", "rate"])]
    agenda = [(d(2026, 2, 2), ["fence", "code", "south"]), (d(2026, 3, 2), ["water", "rate"])]
    meetings = [(d(2026, 2, 2),), (d(2026, 3, 2),)]
    got = checks.postponements(spark.createDataFrame(p, "id int, to date, tokens array<string>"), spark.createDataFrame(agenda, "date date, tokens array<string>"), spark.createDataFrame(meetings, "date date"))
    assert {r.id: (r.status, r.exception) for r in got.collect()} == {1: ("honored", False), 2: ("not found", True), 3: ("no meeting", True), 4: ("target not in record", False), 5: ("reappeared later", False)}


def test_attendance_citations_basis_lifecycle(spark):
    roll = spark.createDataFrame([(1, ["A", "B"]), (2, ["A"]), (3, ["A"])], "doc int, present array<string>")
    heard = spark.createDataFrame([(1, ["A", "C"]), (2, ["A"])], "doc int, heard array<string>")
    assert {r.doc: r.exception for r in checks.attendance(roll, heard).collect()} == {1: True, 2: False, 3: False}
    said = ["21-7-308", "W.S. 21-7-38", "35-2-1046", "21-7-308", "21-7-30", "21-07-308", "21-7-338", "21-7-388", "21-7-99", "21-7", "8-1-1234"]
    spoken = spark.createDataFrame([(1, k, "public", c) for k, c in enumerate(said)], "doc int, ord int, role string, citation string")
    official = spark.createDataFrame([(1, "21-7-308"), (1, "21-7-3088"), (1, "8-1-1284"), (2, "21-7-99")], "doc int, citation string")
    want = {0: ("exact", "21-7-308"), 1: ("close", "21-7-308"), 2: ("ungrounded", None), 4: ("close", "21-7-308"), 5: ("ungrounded", None), 6: ("ungrounded", None), 7: ("close", "21-7-3088"), 8: ("ungrounded", None), 9: ("ungrounded", None), 10: ("close", "8-1-1284")}
    assert {r.ord: (r.status, r.official) for r in checks.grounded_citations(spoken, official).collect()} == want
    basis = spark.createDataFrame([(1, [7], [7], []), (2, [7], [9], [7]), (3, [], [], [])], "doc int, agenda array<int>, minutes array<int>, speech array<int>")
    assert {r.doc: (r.consistent, r.exception) for r in checks.session_basis(basis).collect()} == {1: (True, False), 2: (False, True), 3: (False, True)}
    d = dt.date
    readings = [(1, d(2026, 1, 5), 1, "carried", None, False), (1, d(2026, 1, 19), 2, "postponed", None, False), (1, d(2026, 2, 2), 2, "postponed", None, False), (1, d(2026, 2, 16), 3, "carried", "4656", True), (2, d(2026, 1, 5), 3, "failed", None, False), (3, d(2026, 8, 1), 1, "carried", None, False)]
    got = {r.grp: (r.days, r.adopted, r.flags) for r in checks.lifecycle(spark.createDataFrame(readings, "grp int, date date, reading int, result string, number string, substitute boolean")).collect()}
    assert got == {1: (42, True, ["postponed repeatedly", "substitute at third reading"]), 2: (0, False, ["missing predecessor", "failed"]), 3: (0, False, [])}


def test_close_citations_by_brute_force(spark):
    rng = random.Random(12)
    section = lambda: "".join(rng.choice("0123") for _ in range(rng.choice([2, 3, 4, 4])))
    said, known = [f"7-1-{section()}" for _ in range(400)], sorted({f"7-1-{section()}" for _ in range(25)})
    spoken = spark.createDataFrame([(1, k, "public", c) for k, c in enumerate(said)], "doc int, ord int, role string, citation string")
    got = {r.citation: (r.status, r.official) for r in checks.grounded_citations(spoken, spark.createDataFrame([(1, c) for c in known], "doc int, citation string")).collect()}

    def rank(a, b):
        a, b = a[4:], b[4:]
        return 0 if a == b else 1 if b.startswith(a) else 2 if a.replace("0", "") == b.replace("0", "") else 3 if difflib.SequenceMatcher(None, a, b).ratio() >= 0.75 else None

    for c in set(said):
        best = min(((rank(c, o), o) for o in known if rank(c, o) is not None), default=(None, None))
        assert got[c] == ({None: "ungrounded", 0: "exact"}.get(best[0], "close"), best[1]), c


def test_close_citations_of_many_documents(spark):
    """What is near is found for distinct sections: citations of many documents send no keys, and all the same each document's chapter answers for itself."""
    rng = random.Random(7)
    section = lambda: f"{rng.randrange(10, 1400):0{rng.choice([2, 4])}}"
    said = [(rng.randrange(60), k, rng.choice("ab"), f"7-{rng.choice('12')}-{section()}") for k in range(3000)] + [(1, 3000, "a", "no number"), (None, 3001, "a", "7-1-308")]
    known = [(rng.randrange(60), f"7-{rng.choice('12')}-{section()}") for _ in range(1500)] + [(None, "7-1-308"), (1, None)]
    out = checks.grounded_citations(spark.createDataFrame(said, "doc int, ord int, role string, citation string"), spark.createDataFrame(known, "doc int, citation string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join .*doc#.*key#", plan) and re.search(r"Join .*key#", plan)
    first = {}
    for doc, k, role, c in said:
        first.setdefault((doc, role, c), k)

    def rank(a, b):
        return 0 if a == b else 1 if b.startswith(a) else 2 if a.replace("0", "") == b.replace("0", "") else 3 if difflib.SequenceMatcher(None, a, b).ratio() >= 0.75 else None

    want = set()
    for (doc, role, c), k in first.items():
        near = [(rank(c[4:], o[4:]), o) for d, o in known if o and doc is not None and d == doc and o[:4] == c[:4] and rank(c[4:], o[4:]) is not None]
        best = min(near, default=(None, None))
        want.add((doc, k, role, c, {None: "ungrounded", 0: "exact"}.get(best[0], "close"), best[1], best[0] is None))
    assert {tuple(r) for r in out.collect()} == want


def test_profiles_by_brute_force(spark):
    """Ties at the last place, texts without words, keys with few words; pairs are counted only if both words are frequent."""
    rng = random.Random(5)
    texts = [(key, [rng.choice("abcdefghijkl"[:width]) for _ in range(rng.randrange(12))]) for key, width in (("x", 12), ("y", 4), ("z", 2)) for _ in range(15)]
    texts += [("w", ["only"]), ("w", []), ("v", []), ("u", [f"once{k}" for k in range(20)])]
    for top in (1, 3, 7):
        out = similarity.profiles(spark.createDataFrame(texts, "key string, t array<string>"), "key", F.col("t"), top)
        assert "Join" in out._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)[0].rsplit("Aggregate", 1)[1]
        want = set()
        for key in "uwxyz":
            n = collections.Counter(w for k, t in texts if k == key for w in [*t, *(f"{a} {b}" for a, b in itertools.pairwise(t))])
            want |= {(key, w, round(c / n.total(), 9)) for w, c in sorted(n.items(), key=lambda i: (-i[1], i[0]))[:top]}
        assert {(r.key, r.term, round(r.weight, 9)) for r in out.collect()} == want, top


def test_bases_are_worked_out_once(spark):
    """Next mentions are no subsections; a text is cleaned in one projection and not again for each field."""
    said = [("16-4-405(a)16-4-405(a)(3)", "164405a 16 4 405 a 7"), ("16-4-405 (a)(iv)16-4-405(a)x", "164405a7164405"), ("16-4-405(a)(ivb) 16-4-405", "16-4-405 a 14, personnel"), ("16-4-405(a)(0)", "16-4-405a3x")]
    texts = spark.createDataFrame([(k, a, a, b) for k, (a, b) in enumerate(said)], "doc int, agenda string, minutes string, speech string")
    out = checks.sessions_of(texts)
    got = {r.doc: (r.agenda, r.speech, r.cited_without_subsection, r.purposes, r.notes) for r in out.collect()}
    assert got == {0: ([3], [7], True, [], ["bases differ"]), 1: ([4, 10], [], False, [], []), 2: ([], [], False, [2], ["no basis cited", "none on the agenda", "none in the minutes"]), 3: ([], [], True, [], ["no basis cited", "none on the agenda", "none in the minutes"])}
    assert out._jdf.queryExecution().optimizedPlan().toString().count(">>") == 1


def test_bases_of_closed_sessions(spark):
    rows = [("as 16- 4-\n405(a)(iii) says, 16-4-405(a)(10) and 16-4-405 (A)(3)", "by 164405A7 on real estate [noise]"), ("16-4-405(a)", "[music] >> 16 4 405 a 99 litigation"), ("", ""), (None, None), ("16-4-405(a)(i) in", "16-4-405 and")]
    df = spark.createDataFrame(rows, "written string, spoken string").coalesce(1)
    got = [(tuple(r.w), tuple(r.s)) for r in df.select(checks.closed_basis(F.col("written")).alias("w"), checks.closed_basis(F.col("spoken"), True).alias("s")).collect()]
    assert got == [
        (([3, 10], False, []), ([7], False, [7])), (([], True, []), ([], False, [3])), (([], False, []), ([], False, [])), (([], False, []), ([], False, [])), (([1], False, []), ([], True, [])),
    ]


def test_coverage_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    items = [(k, rng.randint(0, 5), rng.sample(words, rng.randint(1, 9))) for k in range(120)]
    entries = [(k, k, rng.randint(0, 4), rng.sample(words, rng.randint(0, 9)), rng.sample(words, rng.randint(0, 16)), 100) for k in range(40)] + [(90, 90, 5, ["w1"], ["w1"], 399)]
    got = checks.coverage(spark.createDataFrame(items, "id int, meeting int, tokens array<string>"), spark.createDataFrame(entries, "id int, ord int, meeting int, tokens array<string>, raw array<string>, chars int"))
    got = {r.left_id: r.exception for r in got.collect()}
    want = {}
    for k, m, t in items:
        of = [e for e in entries if e[2] == m]
        if sum(e[5] for e in of) >= 400:
            want[k] = not any(len(set(t) & set(e[3])) / len(set(t) | set(e[3])) >= 0.34 or len(set(t) & set(e[4])) / len(set(t)) >= 0.6 for e in of)
    assert got == want and {True, False} <= set(want.values()) and len(want) < 120


def test_best_match_by_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(600)]
    sets = lambda n: [(k, k * 7 % 31, [rng.choice(words) for _ in range(rng.randint(0, 14))]) for k in range(n)]
    left, right = sets(80), sets(200)
    frames = [spark.createDataFrame(rows, "id int, ord int, tokens array<string>") for rows in (left, right)]
    for least in (0.2, 0.5, 1.0):
        sim = lambda a, b: round(len(set(a) & set(b)) / max(1, len(set(a) | set(b))), 6)
        want = {}
        for k, _, t in left:
            near = [(-sim(t, u), o, i) for i, o, u in right if sim(t, u) >= least]
            if near:
                want[k] = (min(near)[:2], -min(near)[0])
        got = {r.left_id: (next((-r.similarity, o) for i, o, _ in right if i == r.right_id), r.similarity) for r in similarity.best_match(frames[0].drop("ord"), frames[1], least, "ord").collect()}
        assert got == want, least


def test_progress_scores(spark):
    rows = [
        (1, 0, "make it", "Here is the complete checklist.\n| a |\n|---|\n" + "x" * 500), (1, 1, "perfect", "I can't. As an AI I don't have access. Would you like me to try? Let me know if so."), (1, 2, "no, wrong", None),
    ]
    got = [(r.turn, r.score, r.reasons) for r in threads.progress_scores(spark.createDataFrame(rows, "conv_id int, turn int, prompt string, output string")).orderBy("turn").collect()]
    assert got[0][:2] == (0, 45 + 10 + 12 + 6 + 16) and got[0][2][-1] == "you confirmed the result before moving on"
    # 64 negative points of markers: 18 of those beyond 32 are given back; then the short answer and the rejection.
    assert got[1][:2] == (1, max(0, 45 - 18 - 18 - 16 - 10 - 12 - 8 + 18 - 14)) and got[2][:2] == (2, 45 - 18)


def test_redact_people(spark):
    said = [("Jane Example spoke, then Mr. Sample and Ms Moody; jane example too", None), ("Hello, my name is Pat Person of the Heights", None), ("For the record, Ida Holm here; record, ida", None), (None, None)]
    names = ["Jane Example", "Al Sample", "Rob Moody", "Prince", "Jane Example Two"]
    got = [r.t for r in spark.createDataFrame(said, "s string, x string").coalesce(1).select(fx.redact_people(F.col("s"), names, {"Moody"}).alias("t")).collect()]
    someone = "[member of the public]"
    assert got == [f"{someone} spoke, then {someone} and Ms Moody; jane example too", f"Hello, {someone} the Heights", f"For the record, {someone} here; record, ida", None]


def test_choices_and_open_asks(spark):
    answer = "Here:\nOption A  go **north** now\n 1) take the train home\n2. take the bus home\n3) short\n1) Take the train home\nWould you like me to draft it, or wait?"
    df = spark.createDataFrame([(answer,), ("nothing",), (None,)], "s string").coalesce(1)
    got = [r.c for r in df.select(threads.choices(F.col("s")).alias("c")).collect()]
    assert got == [["go north now", "take the train home", "Have the assistant draft it"], [], []]
    turns = [(1, k, f"todo: old item {k}", None) for k in range(3)] + [(1, 20, "Next - write the letter\nAnd why is it late? ok", "Pending: the long reply\nWhich do you prefer"), (2, 0, None, None)]
    turns += [(1, k, "todo: old item 2", "x") for k in range(3, 16)]
    got = [(r.thread, r.rank, r.ask) for r in threads.open_asks(spark.createDataFrame(turns, "thread int, ord int, prompt string, output string")).orderBy("thread", "rank").collect()]
    assert got == [(1, 1, "old item 2"), (1, 2, "write the letter"), (1, 3, "the long reply"), (1, 4, "Next - write the letter And why is it late?"), (1, 5, threads.ASKED_BACK)]


def test_named_entities(spark):
    text = "Under Wyoming statute section 12-3-456 and W.S. 7-8-90(b)(ii), §7-8-90(b)(ii), Alderman Olaf Berg and Alderman Berg The second moved Ordinance No. 812; resolution 13-20. Mayor The said RIVERS spoke, no rivers; Alderman Chair left. Ex-Mayor Holm"
    c = lexicon.named_entities(F.col("s"), ["Mayor", "Alderman", "Alder"], {"RIVERS": r"\bRIVERS\b", "Port Board": "Port Board"})
    got = [r.e for r in spark.createDataFrame([(text,), ("",), (None,)], "s string").coalesce(1).select(c.alias("e")).collect()]
    assert got[0].officials == ["Alderman Olaf Berg", "Alderman Berg", "Mayor Holm"] and got[0].agencies == ["RIVERS"]
    assert got[0].statutes == ["W.S. 12-3-456", "W.S. 7-8-90(b)(ii)"] and got[0].instruments == ["Ordinance 812", "Resolution 13-20"]
    assert all(list(e) == [[], [], [], []] for e in got[1:])


def test_neighbouring_abbreviations(spark):
    # As the SQL has it, one white space cannot end one abbreviation and open the next.
    said = {"St. Co. No. 5": "St Co. No 5", "St.  Co. x": "St  Co x", "Dr.\x0bX 15-\x0b1": "Dr.\x0bX 15-\x0b1"}
    got = {r.s: r.c for r in spark.createDataFrame([(s,) for s in said], "s string").withColumn("c", records.clean_minutes(F.col("s"))).collect()}
    assert got == said


def test_open_asks_beside_other_letters_and_line_ends(spark):
    turns = [(1, 0, "inópla the lamp\nzin ópla the lamp\x85in the house of cards\r\nin a deep cave", None), (2, 0, "x\u2028in the house of cards", None)]
    got = [(r.thread, r.ask) for r in threads.open_asks(spark.createDataFrame(turns, "thread int, ord int, prompt string, output string"), ["in"]).orderBy("thread", "rank").collect()]
    assert got == [(1, "ópla the lamp"), (1, "a deep cave")]


def test_distinct_words_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "Éa b éA  B c\ta C ab"), (2, ""), (3, None), (4, "x")], "doc_id int, text string").coalesce(1)
    out = lexicon.distinct_words(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.words) for r in out.collect()) == [(1, "Éa b c a ab"), (2, ""), (4, "x")]


def test_coverage_is_one_scan_of_the_minutes(spark, monkeypatch):
    """By brute force; of the minutes no token is written or shuffled, and items beyond what is broadcast at a time are worked on in blocks."""
    rng = random.Random(7)
    some = lambda most: [f"w{rng.randrange(25)}" for _ in range(rng.randrange(most))]
    items = [(k, rng.choice((1, 2, 3, None)), some(12)) for k in range(40)] + [(90, 1, []), (91, 2, None)]
    entries = [(k, k, rng.choice((1, 2, None)), some(14), some(30), 500) for k in range(60)] + [(91, 91, 1, [], None, 0), (92, 92, 3, ["w1"], ["w1"], 399)]
    want = set()
    for i, meeting, a in items:
        if meeting in (1, 2):
            of = [(set(a or ()), set(t or ()), set(raw or ())) for _, _, m, t, raw, _ in entries if m == meeting]
            near, held = (max((round(len(x & y[k]) / n, 6) for x, *y in of if (n := len(x | y[0]) if k == 0 else len(x))), default=0) for k in (0, 1))
            near, held = near if near >= 0.34 else None, held if held >= 0.6 else None
            want.add((i, meeting, near, held, near is None and held is None))
    names, write = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: names.append(name) or write(df, name))
    a, m = spark.createDataFrame(items, "id int, meeting int, tokens array<string>"), spark.createDataFrame(entries, "id int, ord int, meeting int, tokens array<string>, raw array<string>, chars int").repartition(3)
    assert {tuple(r) for r in checks.coverage(a, m).collect()} == want and names == ["tokens"]
    monkeypatch.setattr(similarity, "HELD", 40)
    assert {tuple(r) for r in checks.coverage(a, m).collect()} == want
    assert checks.coverage(a.where("id = 90"), m).first()[2:] == (None, None, True)


def test_dated_matches_compare_copies_once_and_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    sets = [[f"w{rng.randrange(30 if k % 3 else 300)}" for _ in range(rng.choice((1, 2, 9, 40, 130)))] for k in range(60)]
    rows = [(k, rng.randrange(14), sets[rng.randrange(60)]) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, day int, tokens array<string>")
    want = set()
    for i, d, a in rows:
        close = sorted((e, -round(len({*a} & {*b}) / len({*a} | {*b}), 6), o) for o, e, b in rows if 1 <= e - d <= 4 and round(len({*a} & {*b}) / len({*a} | {*b}), 6) >= 0.4)
        want |= {(i, o, -s, k) for k, (_, s, o) in enumerate(close[:3], 1)}
    for block in (similarity.BLOCK, 7):
        monkeypatch.setattr(similarity, "BLOCK", block)
        assert {tuple(r) for r in similarity.dated_matches(df, 1, 4, 0.4, 3).collect()} == want


def test_dated_matches_give_disk_back(spark, monkeypatch):
    """Several pairs a set, compared in rounds: the same as in one, and neither sketches, sets nor what a written table has shuffled stay on disk."""
    rows = [(k, k % 12, [f"w{w}" for w in range(20) if w != k % 20]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, day int, tokens array<string>")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for files in [disk.getAllFiles()] for k in range(files.length()) if (name := files.apply(k).getName()).startswith("shuffle_")}
    files, got = shuffled(), []
    shared.written(df.groupBy("day").count(), "days")
    assert not shuffled() - files
    for rounds, block in ((1, similarity.BLOCK), (3, 30)):
        monkeypatch.setattr(similarity, "ROUNDS", rounds, raising=False)
        monkeypatch.setattr(similarity, "BLOCK", block)
        folder = Path(shared.folder(spark).removeprefix("file://")) / "recordlens-core"
        before = {p.name for p in folder.glob("*")}
        out = similarity.dated_matches(df, 1, 10, 0.4, 2)
        assert {p.name.rpartition("-")[0] for p in folder.glob("*")} >= {"best", "names"}
        assert not {p.name for p in folder.glob("*") if p.name.startswith(("sketches-", "sets-", "asked-"))} - before
        got.append({tuple(r) for r in out.collect()})
    assert got[0] == got[1] and len(got[0]) > 60


def test_near_leaves_few_pairs_of_sets_that_share_common_tokens(spark):
    # Every two sets share 20 tokens of 100, which makes no similarity of 0.4.
    rng = random.Random(3)
    some = lambda n: [rng.randrange(-(2**63), 2**63) for _ in range(n)]
    shared, own = some(20), some(100)
    rows = [(k, k % 2, 100, shared + some(80)) for k in range(140)] + [(k, k % 2, 100, own) for k in (900, 901)]
    df = spark.createDataFrame(rows, "id long, at int, n int, tokens array<long>")
    pairs = {tuple(r) for r in similarity.near(df, 0.4, 1, 1).collect()}
    assert (900, 901) in pairs and len(pairs) < 200


def test_asked_keeps_shared_tokens_of_distinct_sets(spark):
    left = spark.createDataFrame([(k, ["a", "b", "c"]) for k in (5, 4)], "id long, tokens array<string>")
    right = spark.createDataFrame([(9, 2, ["a", "b", "x"]), (8, 3, ["b", "a", "x"]), (7, 1, ["a", *"mnopqrst"]), (6, 0, ["z"])], "id long, ord int, tokens array<string>")
    x, y, members = similarity.asked(left, right, 0.3, "ord")
    assert [(r.id, r.ord, r.n, len(r.tokens)) for r in y.collect()] == [(9, 2, 3, 2)] and [r.id for r in x.collect()] == [4]
    assert {tuple(r) for r in members.collect()} == {(4, 4), (5, 4)}
    assert {tuple(r) for r in similarity.best_match(left, right, 0.3, "ord").collect()} == {(4, 9, 0.5), (5, 9, 0.5)}

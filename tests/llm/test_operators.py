"""The operators against brute force, and on awkward tables."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordlens.llm import bpe, exact_dedup, html_text, lz_dedup, mixing, ngram_join, quality, registry, samples, topk, toxicity, url_filter
from recordlens.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, sig string, row string, score double, `a.b` int"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "co", "du", "fe", "gi"]) for _ in range(rng.randint(1, 3)))
    base = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(25)]
    near = [t.replace("ba", "zu", 1) + (" tail" if rng.random() < 0.5 else "") for t in base for _ in range(2)]
    long = " ".join(word() for _ in range(30_000))
    return [*base, *near, *base[:6], base[0].upper(), "", None, " \t\n ", "one", "one two three four", "one two three four", "é" * 50, "x" * 5000, long, long + " end", "ab " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 2}", 1, 2, "x", "y", 0.5, 3) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "one", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def collected(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def words(text):
    return text.encode().split()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, 100 + k) for k in range(1, 40)] + [(200 + k, 201 + k) for k in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_exact_dedup(docs):
    rows = collected(docs)
    fold = lambda t: t.encode().lower()
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    for huge in (1 << 22, 700):
        got = exact_dedup.exact_dedup(docs, huge).collect()
        assert len(got) == len(rows)
        want = Counter((i, max((x for x in groups[fold(t)] if x is not None), default=None), len(groups[fold(t)]), hashlib.sha256(fold(t)).hexdigest()) for i, t in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_fingerprints_compose():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 9000)), rng.randbytes(rng.randint(0, 9000))
        whole = exact_dedup.poly_hash(a + b, exact_dedup.R1, exact_dedup.P1)
        assert whole == exact_dedup.combine(exact_dedup.poly_hash(a, exact_dedup.R1, exact_dedup.P1), exact_dedup.poly_hash(b, exact_dedup.R1, exact_dedup.P1), len(b), exact_dedup.R1, exact_dedup.P1)
        direct = 0
        for c in a[:300]:
            direct = (direct * exact_dedup.R1 + c) % exact_dedup.P1
        assert direct == exact_dedup.poly_hash(a[:300], exact_dedup.R1, exact_dedup.P1)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    rows = [(1, "aaa"), (2, "bbb"), (3, "aaa"), (4, "ccc")]
    monkeypatch.setattr(exact_dedup, "_prints", weak(False))
    monkeypatch.setattr(exact_dedup, "_with_text", weak(True))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def weak(text: bool):
    """Fingerprints that tell lengths only; closures, so that they travel by value."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            raw = [t.as_py().encode() for t in b.column("text")]
            same, size = pa.array([7] * len(raw), pa.int64()), pa.array([len(r) for r in raw], pa.int64())
            if text:
                yield pa.RecordBatch.from_arrays([same, same, size, b.column("text")], ["h1", "h2", "n_bytes", "text"])
            else:
                sha = pa.array([hashlib.sha256(r).hexdigest() for r in raw])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), same, same, size, same, same, sha], ["doc_id", "h1", "h2", "n_bytes", "s1", "s2", "text_sha256"])

    return run


def near_copies():
    """Groups of copies with edits of their own or of a common ancestor, whose links lie on both sides of the threshold."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for size in (90, 40, 12):
        base = [word() for _ in range(120)]
        families = [base]
        for _ in range(size):
            new = list(rng.choice(families))
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(len(new))] = word()
            if rng.random() < 0.3:
                families.append(new)
            out.append(" ".join(new[: rng.choice([120, 118, 96])]))
    return out


def joined_by_brute_force(rows):
    sets = [(i, set(zip(*[words(t.lower())[k:] for k in range(5)], strict=False)) or ({tuple(words(t.lower()))} if words(t) else set())) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return Counter((i, len(s), low.get(find(x)) if s else i) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("small", "levels"), [(1024, 6), (5, 0), (5, 3)])
def test_ngram_join_of_near_copies(spark, small, levels):
    rows = list(enumerate(near_copies()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.ngram_join(docs, small=small, levels=levels).collect()
    want = joined_by_brute_force(rows)
    assert Counter(tuple(r) for r in got) == want and 10 < len({c for _, _, c in want}) < len(rows) - 20


def test_meetings_without_links_make_no_families(spark, monkeypatch):
    """Whole sets are read of linked ones only, though all others share much with some and a list of 35 runs through them."""
    rng, read = random.Random(8), []
    passage = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    chain, pool = [passage(300) for _ in range(40)], [passage(400) for _ in range(8)]
    texts = [f"{a} {b}" for a, b in itertools.pairwise(chain)] + [" ".join(x) for x in itertools.combinations(pool, 4)]
    rows = list(enumerate([*texts, texts[0] + " end"]))
    links = ngram_join.family_links
    monkeypatch.setattr(ngram_join, "family_links", lambda members, *more: read.append(members.count()) or links(members, *more))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == joined_by_brute_force(rows) and read == [2]


def test_near_copies_are_dropped_without_shuffling_rows(docs, monkeypatch):
    spark = docs.sparkSession
    want = Counter(i for i, _, c in joined_by_brute_force(collected(docs)).elements() if i == c)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, shuffled in ((ngram_join.MOST_DROPPED, False), (0, True)):
            monkeypatch.setattr(ngram_join, "MOST_DROPPED", most)
            kept = ngram_join.keep_one_of_each(docs)
            assert ("hashpartitioning(" in kept._jdf.queryExecution().executedPlan().toString()) == shuffled
            assert {r.doc_id for r in kept.select("doc_id").collect()} == set(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches_keep_linked_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 40, 64, 65, 130, 500, 1025, 3000)]
    for s in sets[2:]:
        for cut in (0.99, 0.9, 0.8, 0.7, 0.5):
            sets.append(np.union1d(s[: int(cut * len(s))], rng.integers(0, 2**63, int(rng.random() * 0.2 * len(s))).astype(np.uint64)))
    n, sketches = np.array([len(s) for s in sets]), [np.frombuffer(ngram_join._sketch(s), np.uint64) for s in sets]
    found = {frozenset(p) for p in ngram_join.alike_members(n, sketches, 75)}
    of = {x: x for x in range(len(sets))}
    for a, b in found:
        of = {k: of[a] if v == of[b] else v for k, v in of.items()}
    linked = 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        apart = len(np.setxor1d(sets[i], sets[j]))
        assert ngram_join._apart(sketches[i], sketches[j]) <= apart
        if 7 * apart <= n[i] + n[j]:
            linked += 1
            assert of[i] == of[j]
    assert linked > 10 and len(set(of.values())) > 8


@pytest.mark.parametrize(("paired", "sketched", "apart"), [(32, 4096, 64), (2, 5, 64), (0, 0, 64), (3, 4, 2)])
def test_blocks_keep_all_that_may_link(monkeypatch, paired, sketched, apart):
    for name, value in (("PAIRED", paired), ("SKETCHED", sketched), ("APART", apart)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(6)
    sets = [(sig, rng.randint(8, 60)) for sig in range(1, 90)]
    prefixes = {sig: rng.sample(range(40), min(n // 4, 12)) for sig, n in sets}
    packed = lambda p: np.array(p, np.uint64).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    batch = lambda rows: pa.RecordBatch.from_pydict({"n": [n for _, n in rows], "sig": [s for s, _ in rows], "prefix": pa.array([packed(prefixes[s]) for s, _ in rows], pa.binary())})
    every = type("", (), {"value": np.full(1 << 10, 2**64 - 1, np.uint64)})
    entries = pa.Table.from_batches(ngram_join._local_blocks(75, every)(map(batch, (sets[:30], sets[30:75], sets[75:])))).sort_by([(c, "ascending") for c in ("h", "sizes", "sig")])
    rows = pa.Table.from_batches(ngram_join._family_edges(75)(entries.to_batches(max_chunksize=50))).to_pylist()
    of, pairs, blocks = {s: s for s, _ in sets}, {frozenset((r["a"], r["b"])) for r in rows if r["kind"] == ngram_join.PAIR}, defaultdict(set)
    for r in rows:
        if r["kind"] == ngram_join.SURE:
            of = {k: of[r["a"]] if v == of[r["b"]] else v for k, v in of.items()}
        elif r["kind"] == ngram_join.MEMBER:
            blocks[r["a"]].add(r["b"])
    met = 0
    for (s, n), (t, m) in itertools.permutations(sets, 2):
        if n <= m and 100 * n >= 75 * m and any(175 * k <= 25 * n and h in prefixes[t] for k, h in enumerate(prefixes[s])):
            met += 1
            assert of[s] == of[t] or frozenset((s, t)) in pairs or any({s, t} <= b for b in blocks.values())
    assert met > 50 and (bool(pairs), bool(blocks)) == (paired > 0, 0 < paired < 32)


def test_shared_elements(spark):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 40, 3000).astype(np.uint64) for _ in range(30)]
    sets = [np.concatenate([s, sets[k - 1][:100]]) for k, s in enumerate(sets)]
    rows = [(bytearray(s.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()),) for s in sets]
    bitmap = ngram_join.shared_elements(spark.createDataFrame(rows, "prefix binary").repartition(4), ngram_join._dealt_prefixes)
    h, count = np.unique(np.concatenate(sets), return_counts=True)
    marked = ngram_join._marked(bitmap, h, 40)
    assert marked[count > 1].all() and marked[count == 1].mean() < 0.1


def test_ngram_join(docs):
    rows = collected(docs)
    want = joined_by_brute_force(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()) == want
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, _, c in want if i == c}


def cut_by_brute_force(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[(i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())] += 1
    return want


@pytest.mark.parametrize(("bits", "frequent"), [(27, 64), (6, 64), (27, 2)])
def test_lz_dedup(docs, bits, frequent):
    """A full bitmap and salted shares change nothing."""
    want = cut_by_brute_force(collected(docs))
    assert sum(v for (_, _, n, _), v in want.items() if n)
    assert Counter(tuple(r) for r in lz_dedup.lz_dedup(docs, bits=bits, frequent=frequent).collect()) == want


def test_lz_dedup_of_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(1, long), (2, long), (2, "short one"), (2, "head " + long + " tail"), (3, " ".join(f"w{k}" for k in range(90, 110)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in lz_dedup.lz_dedup(df).collect()) == cut_by_brute_force(rows)


def test_lz_factors(spark):
    a, b = ([f"{c}{k}" for k in range(30)] for c in "ab")
    both = [*a[5:25], *b[3:30]]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*a[20:30], *b[:10]])), (9, " ".join(["x", *both, "y"]))]
    got = lz_dedup.lz_dedup(spark.createDataFrame(rows, "doc_id long, text string"), full=True).where("doc_id = 9").first()
    assert got.kept == "x y" and [tuple(f) for f in got.factors] == [(1, 20, 1, 5), (21, 27, 2, 3)]


def test_bpe_matches_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(registry.vocabulary_path())
    rows = collected(docs) + [(900, "a<|endoftext|> b  c \n d's <|endoftext|>"), (901, "日本語 déjà 😀\x1c  ")]
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(rows[-2:], "doc_id long, text string"))
    want = Counter()
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.encode_documents(more, registry.vocabulary_path()).collect()) == want
    full = bpe.encode_documents(more, registry.vocabulary_path(), full=True).where("doc_id = 900").first()
    assert full.decoded == rows[-2][1] and list(full.ids) == t.encode(rows[-2][1], add_special_tokens=False).ids


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (230, 9)).astype("float32")
    v[40:60] = v[40]
    rows = [(i, [float(x) for x in r], "z") for i, r in enumerate(v)]
    rows += [(500, None, "z"), (550, [1.0, None], "z"), (600, [float("nan")] * 9, "z"), (650, [float("inf")] * 9, "z"), (None, [1.0] * 9, "z"), rows[7], (700, [0.5, 0.25], "z")]
    whole = {i: np.floor(256 * np.array(e, "float64")).astype(int) for i, e, _ in rows if i is not None and e is not None and i not in (550, 600, 650)}
    whole[700] = np.concatenate([whole[700], np.zeros(7, int)])
    want = set()
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.where("false")).collect() == []
    assert topk.top_k(df.where("vec_id = 50")).collect() == []


def test_url_filter_propagates_to_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.example.net/x?u=1#f", link.format("https://b.example.com/de/1")),
        (2, "http://A.example.net/x", None),
        (3, "https://c.net/y", '<meta http-equiv="refresh" content="0; url=/z">'),
        (4, "https://c.net/z", link.format("https://q.example.com/de/2")),
        (5, "https://c.net/z", link.format("https://q.com/fr/2")),
        (6, "https://example.org/es/1", ""),
        (7, "https://sub.example.org/en/12", ""),
        (8, "https://example.org/", ""),
        (9, None, "canonical"),
        (10, "no scheme", None),
        (11, "https://lonely.net", "plain"),
        (12, "https://notexample.org/es/", ""),
        (13, "x://org?a", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[1] == ("a.example.net", "/x", None, "block") and got[2][3] == "block"
    assert got[3][3] == got[4][3] == got[5][3] == "allow"
    assert got[6][2:] == ("example.org/es/", "block") and got[7][2:] == ("example.org/en/1", "block") and got[8][2:] == ("org/", "allow")
    assert got[9] == got[10] == ("", "", None, "allow") and got[11] == ("lonely.net", "", None, "allow") and got[12][2:] == ("org/", "allow") and got[13][2] is None


def test_summed_over_tasks_and_shares(spark):
    def add(batches):
        total = np.zeros(32)
        for b in batches:
            np.add.at(total, b.column("doc_id").to_numpy() % 32, 1)
        return total

    docs = spark.range(1000).withColumnRenamed("id", "doc_id")
    for parts in (1, 70):
        got = samples.summed(docs.repartition(parts), add, 32)
        assert got.tolist() == [sum(k % 32 == i for k in range(1000)) for i in range(32)]
    assert samples.summed(docs.where("false"), add, 32).tolist() == [0.0] * 32


def test_survivors_of_the_uniform_threshold():
    rng = np.random.default_rng(5)
    for width, groups in ((64, 4), (7, 3), (2, 4)):
        x = np.floor(rng.normal(size=(400, width)) * 256)
        q, ids = x[::40], np.arange(400)
        own, full = ids[::40][:, None] == ids, (q @ x.T).astype(np.int64)
        for place in (1, 5, 300):
            t = np.sort(np.where(own, -(1 << 40), full), axis=1)[:, -place][:, None]
            rows, cols, score = topk.survivors(q, x, t, own, groups)
            assert set(zip(rows, cols, score, strict=True)) == {(r, c, full[r, c]) for r, c in zip(*np.nonzero((full >= t) & ~own), strict=True)}


PLANTED = [  # (url, html, verdict)
    ("https://a.net/1", "<!-- <link rel=canonical href=https://x.com/de/1> -->", "allow"),
    ("https://a.net/2", "<script>var s = '<link rel=\"canonical\" href=\"https://x.com/de/2\">';</script>", "allow"),
    ("https://a.net/3", "<link rel=canonical title=\"a>b\" href=\"https://x.com/de/3\">", "block"),
    ("https://a.net/4", "<META HTTP-EQUIV='refresh' content=\"0; https://x.com/de/4\">", "block"),
    ("https://a.net/5", "<meta http-equiv=refresh content='5; URL=\"https://x.com/de/5\"'>", "block"),
    ("https://a.net/6", "<meta http-equiv=refresh content=5><textarea><link rel=canonical href=https://x.com/de/6></textarea>", "allow"),
    ("https://a.net/7", "<style><link rel=canonical href=https://x.com/de/7></style><link rel='alternate canonical' href='/8?q=1'>", "block"),
    ("https://a.net/8", "<link href=https://x.com/de/8 rel=canonical>", "block"),
    ("https://a.net/9", "<link rel=canonical href=https://x.com/de/9><meta http-equiv=refresh content='0;url=https://b.org/'>", "allow"),
    ("https://x.com/de/9", None, "block"),
    ("https://a.net/10", "<!-- open <link rel=canonical href=https://x.com/de/10>", "allow"),
    ("https://a.net/11", "<link rel=canonical data-x='" + "y" * 200_000 + "' href=https://x.com/de/11>", "block"),
    (None, "<link rel=canonical href=https://x.com/de/1>", "allow"),
]


def test_url_filter_reads_tags_as_browsers_do(spark):
    rows = [(k, url, html) for k, (url, html, _) in enumerate(PLANTED)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r) for r in url_filter.url_filter(df).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert {k: r[4] for k, r in got.items()} == {k: v for k, (_, _, v) in enumerate(PLANTED)}
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert {r[0]: r for r in con.execute(url_filter.oracle()).fetchall()} == got
    assert url_filter.url_filter(df.where("false")).count() == 0


def test_url_filter_resolves_every_target(spark):
    refresh, link = '<meta http-equiv="refresh" content="0; url={}">', '<link rel="{}" href="{}">'
    pages = [
        ("https://a.net/d/p", refresh.format("next.html"), "a.net/d/next.html"),
        ("https://b.net/d/e/p", refresh.format("../up"), "b.net/d/up"),
        ("https://c.net", refresh.format("x/./y?q=1#f"), "c.net/x/y"),
        ("https://d.net/p", '<base href="/other/">' + refresh.format("?x=1"), "d.net/other/"),
        ("https://e.net/p", '<base href="https://base.net/k/i">' + link.format("canonical", "z"), "base.net/k/z"),
        ("https://f.net/p", link.format("alternate canonical", "//g.net/q"), "g.net/q"),
        ("https://h.net/p", link.format("canonical", "/one") + link.format("CANONICAL", "/two"), "h.net/one h.net/two"),
        ("https://i.net/p", refresh.format("/three") + refresh.format("/four"), "i.net/three i.net/four"),
        ("https://j.net/p", refresh.format("go?to=http://k.com/de/"), "j.net/go"),
        ("https://l.net/p", link.format("canonical", "mailto:x@y.net") + link.format("noncanonical", "/no") + refresh.format("?x=1"), ""),
    ]
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    df = df.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    assert {tuple(r) for r in url_filter.alias_edges(df).collect()} == {(u.removeprefix("https://"), b) for u, _, to in pages for b in to.split()}
    rows = [(1, "https://m.net/d/p", refresh.format("q")), (2, "https://m.net/d/q", link.format("canonical", "https://x.com/de/1"))]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.verdict for r in got] == ["block", "block"]


def test_html_of_empty_tables_and_long_pages(spark):
    rows = [(1, "u", "<p>" + "</p><p>".join(f"Sentence number {k} is a part of the article." for k in range(8000)) + "</p>"), (2, "u", "<div>" * 3000 + "<p>A deep sentence of some length stands here.</p>" + "</div>" * 3000), (3, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got[1][0].count("\n") == 7999 and got[1][1] == len(got[1][0]) and got[2][0] == "A deep sentence of some length stands here." and got[3] == ("", 0)
    assert html_text.extract(df.where("false")).count() == 0


def test_html_min_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, i + 1, rng.uniform(0, 2)) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1)) for _ in range(n // 2)]
        cost = lambda yes: sum(np.logaddexp(0, -o if y else o) for o, y in zip(odds, yes, strict=True)) + sum(w for i, j, w in edges if yes[i] != yes[j])  # noqa: B023, E731
        best = min(cost([(k >> i) & 1 == 1 for i in range(n)]) for k in range(1 << n))
        assert cost(html_text.label(odds, edges)) == pytest.approx(best)


def test_html_neighbours_decide(monkeypatch):
    flows, cut = [], html_text._min_cut
    monkeypatch.setattr(html_text, "_min_cut", lambda *a: flows.append(1) or cut(*a))
    long = "Some words of a paragraph. " * 12
    page = f"<body><nav><a href=/>Home</a></nav><div><p>{long}</p><div>Yes.</div><div>No.</div><p>{long}</p></div><div class=ad>Buy it.</div><footer>All rights</footer></body>"
    own = {text: odds > 0 for text, odds, _, _ in html_text.blocks(page)}
    assert not own["Yes."] and html_text.main_text(page) == "\n".join([long.strip(), "Yes.", "No.", long.strip()]) and flows
    ad = f"<article><p>{long}</p><div class='ad'>Buy this now.</div><p>{long}</p><aside>See more</aside><p>{long}</p></article>"
    assert html_text.main_text(ad) == "\n".join([long.strip()] * 3)
    assert html_text.main_text("<ul>" + "<li><a href=/>Menu</a></li>" * 5 + "<li>Top</li></ul>") == ""


def test_html_main_text(spark):
    page = (
        '<html><head><title>t</title><script>var a = "</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this now, it is a very good thing to buy.</div>'
        "<article><header><h1>A &amp; B</h1></header><p><b>First   line of\n text.<br><p>Second&nbsp;one.<!-- no --></p><aside>Side notes of some length here.</aside></article>"
        '<section id="comments"><p>Readers say much about all of this, at length.</p></section><footer>&copy; me</footer>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<article><p>cut of"), (5, "u", "<p"), (None, "u", "<script>x")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got[1] == ("A & B\nFirst line of text.\nSecond one.", 37)
    assert got[2] == got[3] == got[5] == got[None] == ("", 0) and got[4][0] == "cut of"


def test_toxicity_held_out(spark):
    t = {n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels")}
    got = toxicity.toxicity(t["documents"], t["labels"]).join(t["labels"], "doc_id").where("held_out").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / (got.predicted == 1).sum() > 0.85 and hit.sum() / (got.toxic == 1).sum() > 0.75


def test_crf_marginals_match_brute_force():
    rng = np.random.default_rng(1)
    crf = toxicity.Crf(rng.normal(0, 1, 4), rng.normal(0, 1, (2, 2)))
    s = np.maximum(0, rng.normal(0, 3, (5, 2)))
    e = toxicity.Crf.features(s) @ crf.weights
    total = np.zeros(5)
    z = 0.0
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        w = np.exp(sum(e[i] for i in range(5) if y[i]) + sum(crf.transition[y[i], y[i + 1]] for i in range(4)))
        z += w
        total += w * np.array(y)
    assert crf.marginals(s) == pytest.approx(total / z)
    assert crf.forward_backward(toxicity.Crf.features(s)[None])[0][0, :, 1] == pytest.approx(total / z)


def test_quality_held_out(spark):
    t = {n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels")}
    got = quality.quality(t["documents"], t["labels"]).join(t["labels"], "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97


def test_scores_ignore_other_columns(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality.quality):
        got = f(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        plain = docs.select("doc_id", "text", "lang", "source")
        other = {(r.doc_id, r.score) for r in f(plain.withColumn("lang", F.lit("q")).withColumn("source", F.lit("q")), labels).collect()}
        assert {(r.doc_id, r.score) for r in got} == other
        assert f(docs.where("false"), labels).collect() == [] and len(f(docs, labels.where("false")).collect()) == docs.count()
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_raking_meets_the_margins(spark):
    rng = random.Random(6)
    rows = [(f"s{rng.randint(0, 3)}", rng.choice(["en", "de", "fr", "es"]), rng.choice(["prose", "noisy", "tabular"]), rng.randint(1, 900)) for _ in range(400)]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens long").groupBy("_source", "_lang", "_topic").agg(F.sum("tokens").alias("tokens"))
    for m, wanted in (("_source", None), ("_lang", mixing.LANGUAGE), ("_topic", mixing.TOPIC)):
        cells = cells.join(mixing.targets(cells, m, wanted), m)
    got = mixing.rake(cells, ["_source", "_lang", "_topic"]).toPandas()
    for m in ("_source", "_lang", "_topic"):
        by = got.groupby(m)
        assert np.allclose(by.weight.sum(), by[f"target_{m}"].first(), atol=1e-5)
    # Brute force: the same fit over a dense array.
    names = [sorted(got[m].unique()) for m in ("_source", "_lang", "_topic")]
    dense = np.zeros([len(n) for n in names])
    for r in got.to_dict("records"):
        dense[tuple(n.index(r[m]) for n, m in zip(names, ("_source", "_lang", "_topic"), strict=True))] = r["tokens"]
    dense /= dense.sum()
    goal = [np.array([got[got[m] == v][f"target_{m}"].iloc[0] for v in n]) for n, m in zip(names, ("_source", "_lang", "_topic"), strict=True)]
    for _ in range(60):
        for k in range(3):
            axes = tuple(a for a in range(3) if a != k)
            dense *= (goal[k] / dense.sum(axes)).reshape([-1 if a == k else 1 for a in range(3)])
    for r in got.to_dict("records"):
        assert r["weight"] == pytest.approx(dense[tuple(n.index(r[m]) for n, m in zip(names, ("_source", "_lang", "_topic"), strict=True))], abs=1e-5)


def test_mixed_sample_meets_the_margins(spark):
    rng = random.Random(8)
    form = {"prose": "word ", "tabular": "a | ", "noisy": "w! "}
    for hot in (40, 440):  # as even sources, and with one that holds about a third
        rows = []
        for s in range(20):
            for k in range(hot if s == 0 else 40):
                topic = rng.choices(["prose", "tabular", "noisy"], [90, 3 if s else 1, 7])[0] if k >= 12 else ["prose", "tabular", "noisy"][k % 3]
                lang = rng.choices(["en", "de", "fr", "es"], [60 if s else 75, 16, 16, 9])[0] if k >= 12 else ["en", "de", "fr", "es"][k // 3]
                rows.append((len(rows), form[topic] * rng.randint(20, 60), lang, f"s{s}"))
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
        assert got.probability.between(0, 1).all()
        kept, n = got.n_words * got.probability, got.n_words
        raw = np.minimum(n.groupby(got.source).sum() / n.sum(), mixing.SOURCE_CAP / 20)
        for column, target in (("source", (raw / raw.sum()).to_dict()), ("lang", mixing.LANGUAGE), ("topic", mixing.TOPIC)):
            share = (kept.groupby(got[column]).sum() / kept.sum()).to_dict()
            assert share == pytest.approx(target, abs=1e-5)
        assert kept.sum() / n.sum() <= mixing.KEEP + 1e-5


def test_mixing_awkward_rows(docs):
    got = mixing.mix(docs)
    rows = got.select("doc_id", "n_words", "probability", "sampled").collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    count = Counter((i, len(words(t))) for i, t in collected(docs))
    assert Counter((r.doc_id, r.n_words) for r in rows) == count
    assert got.select("row.*").columns == docs.columns
    assert mixing.mix(docs.where("false")).collect() == []


def test_quality_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here", 1), (1, "some words here", 2), (None, None, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert quality.quality(docs.where("false"), labels).count() == 0


def test_empty_tables(docs):
    none = docs.where("false")
    assert exact_dedup.exact_dedup(none).collect() == [] and ngram_join.ngram_join(none).collect() == [] and lz_dedup.lz_dedup(none).collect() == []
    assert bpe.encode_documents(none, registry.vocabulary_path()).collect() == []
    assert exact_dedup.keep_one_of_each(none).collect() == [] and ngram_join.keep_one_of_each(none).collect() == []

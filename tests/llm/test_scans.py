"""Periodic runs, lexical search and token counts against brute force, the library, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from recordlens.llm import lexical_search, periodic_runs, registry, token_counts
from recordlens.llm.staging import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows(spark, texts, kind="long"):
    """Rows with nulls, repeated ids and columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1.0, 7) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, row string, score double, runs int")


# Periodic runs


def all_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            block = words[i : i + q]
            if j - i + q >= max(6, 4 * q) and not any(q % d == 0 and block[d:] + block[:d] == block for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc, words):
    runs = all_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    most = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *most, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_texts():
    rng = random.Random(11)
    out = []
    for _ in range(120):
        letters, words = rng.choice([1, 2, 3, 40]), []
        for _ in range(rng.randint(0, 6)):
            block = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(1, rng.choice([2, 6, 30])))]
            words += (block * 9)[: rng.randint(1, 8 * len(block))]
        out.append(" ".join(words))
    return [*out, "", " \t", "a", "a " * 700, "a b\n" * 300, "x y z\x0b" * 400 + "x", "é è " * 20]


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("huge", [periodic_runs.HUGE_CHARS, 40])
def test_runs_against_brute_force(spark, huge):
    texts = [(k, t) for k, t in enumerate(periodic_texts())]
    texts += [(3, texts[3][1]), (3, "b " * 9), (None, "c " * 8), (None, None), (900, None)]
    got = periodic_runs.periodic_runs(odd_rows(spark, texts), huge=huge)
    assert got.columns == COLUMNS
    want = Counter(run_row(i, WORD.findall(t or "")) for i, t in texts)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(r[1] > 0 for r in want) > 40 and max(r[1] for r in want) > 1


def test_runs_full(spark):
    got = periodic_runs.periodic_runs(odd_rows(spark, [(1, "a b c c c c c c d"), (2, "no run")]), full=True).collect()
    found = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert found == {1: ([(2, 6, 1)], "a b c d"), 2: ([], "no run")}
    assert periodic_runs.periodic_runs(odd_rows(spark, [])).count() == 0


def test_tiles_cover_long_runs():
    rng = random.Random(3)
    for p in (37, 64, 129):
        block = [rng.randrange(10**6) for _ in range(p)]
        words = [-1, -2, *(block * 40)[: 31 * p + 5], -3]
        for k in range(10):
            parts = [(q, a + at, b + at) for m in range(0, len(words), 3 << k) for at in [max(0, m - (3 << k))] for q, a, b in periodic_runs.solve(words[at : m + (8 << k)], m - at, k)]
            assert periodic_runs.joined(parts) == ([(p, 2, 2 + 30 * p + 5)] if 1 << k <= p < 2 << k else [])


def test_planted(spark):
    docs = table(spark, SF, "documents").limit(200)
    got = {r.doc_id: r.text for r in periodic_runs.planted(docs).collect()}
    changed = 0
    for r in docs.collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert WORD.findall(got[r.doc_id] or "") == words
    assert changed > 5


# Ranked lexical search


def ranked(docs, items, top=10):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tf = [(d, Counter(split(t))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    n_docs, total = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        scores = defaultdict(int)
        for k, (_, c, n) in enumerate(tf):
            for t in set(split(text)):
                if c[t]:
                    m = 10 + 90 * n * n_docs // total
                    scores[k] += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
        best = sorted(((-s, tf[k][0] is None, tf[k][0] or 0) for k, s in scores.items() if s > 0))[:top]
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(best, 1)]
    return Counter(out)


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)] + ["a", "ab", "abc", "é", "Éa", "x1"]
    text = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(150)]
    docs += [(5, docs[5][1]), (5, "w1 w2"), (None, "w1 w2"), (400, None), (401, ""), (402, "\x00 -"), *[(500 + k, "w3 w4") for k in range(15)], (600, "w5 " * 3000)]
    items = [(k, text(rng.randint(1, 9))) for k in range(25)] + [(3, "w1"), (None, "W2 w2"), (70, None), (71, "?!"), (72, "unknown")]
    frames = odd_rows(spark, docs).repartition(5), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    for held, size in ((lexical_search.HELD, 512), (30, 7)):
        monkeypatch.setattr(lexical_search, "HELD", held)
        monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", size)
        got = lexical_search.search(*frames)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == ranked(docs, items)
    for empty in ((frames[0].limit(0), frames[1]), (frames[0], frames[1].limit(0))):
        assert lexical_search.search(*empty).count() == 0


# Token counts


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(registry.vocabulary_path(registry.COUNTED))
    out.no_truncation()
    out.no_padding()
    return out


def test_tokens_as_the_library(spark, library, monkeypatch):
    rng = random.Random(6)
    letters = "aab sStTrReEvVlLdDmM''' 12!.é́\n\t 漢ÅΣσςᲉİ<|"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["x<|endoftext|>'s<|startoftext|>é<|endoftext|>́a", "<|endoftext|><|endoftext|>", "<|endoftext|", "", " ", "a" * 3000, "ab" * 900 + "a", "=" * 1501, "é" * 700, "'" * 40, "don't we'll they're I'VE"]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(4000)), " ".join("word" + str(k) for k in range(3000))]
    rows = [*enumerate(texts), (3, texts[3]), (None, "null id"), (8000, None)]
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    for size in (token_counts.PIECE_CHARS, 64):
        monkeypatch.setattr(token_counts, "PIECE_CHARS", size)
        m = token_counts.merges(registry.vocabulary_path(registry.COUNTED))
        counted = [sum(token_counts.count(token_counts.pieces(t or ""), m)) for _, t in rows]
        assert counted == [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    got = token_counts.token_counts(odd_rows(spark, rows), registry.vocabulary_path(registry.COUNTED))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and Counter(map(tuple, got.collect())) == want
    assert token_counts.token_counts(odd_rows(spark, []), registry.vocabulary_path(registry.COUNTED)).count() == 0


def test_tokens_of_the_table(spark, library):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r.n_tokens for r in registry.op13_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_every_character(library):
    m = token_counts.merges(registry.vocabulary_path(registry.COUNTED))
    texts = [f"a{chr(c)}b1{chr(c)}{chr(c)}x'" for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    assert token_counts.count(list(texts), m).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merges_must_rise(tmp_path):
    path = tmp_path / "odd.json"
    text = open(registry.vocabulary_path(registry.COUNTED), encoding="utf-8").read()
    import json

    spec = json.loads(text)
    spec["model"]["merges"].reverse()
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        token_counts.Merges(str(path))

"""The pipeline's stages on the smallest tables, against brute force."""

import hashlib
import itertools
import re
import string

import duckdb
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from recordlens.llm import mixing, registry, toxicity
from recordlens.llm.staging import staged, table

SF = "/root/testdata/sf0.001"


def lowered(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def not_toxic(docs):
    scored = toxicity.toxicity(docs, table(docs.sparkSession, SF, "labels"))
    return {r.doc_id for r in scored.where("predicted = 0").collect()}


def last_of_equal(docs):
    return set({lowered(r.text): r.doc_id for r in docs.orderBy("doc_id").collect()}.values())


def first_of_near(docs):
    rows = sorted((r.doc_id, lowered(r.text)) for r in docs.select("doc_id", "text").collect())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := words(t))}
    first = {i: i for i, _ in rows}
    for i, j in itertools.combinations(sorted(sets), 2):
        small, large = sorted((len(sets[i]), len(sets[j])))
        if 4 * small >= 3 * large and first[i] != first[j]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (small + large - common):
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = {k: new if v == old else v for k, v in first.items()}
    return set(first.values())


def drawn(docs):
    """What the calibrated probabilities decide; words and topics are counted here anew."""
    texts, kept = {r.doc_id: r.text or "" for r in docs.collect()}, set()
    for r in mixing.mix(docs).drop("row").collect():
        text = texts[r.doc_id]
        bars, marks = text.count("|"), sum(map(text.count, "!%$&*#"))
        topic = "tabular" if bars and bars * 40 >= len(text) else "noisy" if marks * 40 >= len(text) > 0 else "prose"
        assert (r.n_words, r.topic) == (len(words(text)), topic)
        if r.sampled:
            kept.add(r.doc_id)
    return kept


EXPECTED = {"toxicity": not_toxic, "exact_dedup": last_of_equal, "ngram_join": first_of_near, "mixing": drawn}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    schema, rows = docs.schema, docs.collect()
    # Copies in other letters, near copies, texts without words, and null, beside what the table holds.
    long = [r for r in rows if len(words(r.text)) > 60][:12]
    more = [(10_000 + k, r.text.upper() if k % 2 else f"{r.text} and a tail", r.lang, r.source, r.n_chars) for k, r in enumerate(long)]
    more += [(10_100, None, None, None, None), (10_101, "", "en", "src0", 0), (10_102, " \t", "en", "src0", 2), (10_103, "| a | b |", "en", "src1", 9)]
    docs = docs.unionByName(spark.createDataFrame(more, schema))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, SF), f"test-{name}")
        kept = [tuple(r) for r in docs.collect()]
        want = EXPECTED[name](before)
        assert docs.schema == schema and sorted(kept, key=repr) == sorted((tuple(r) for r in before.collect() if r.doc_id in want), key=repr), name
        sizes.append(len(kept))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    name, stage = corpus_pipeline.STAGES[-1]
    got = {r.doc_id: r for r in stage(spark, docs, SF).collect()}
    library = Tokenizer.from_file(registry.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == sizes[-1]
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, list(g.ids), g.ids_sha256) == (len(ids), ids, sha(",".join(map(str, ids))))
        assert g.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns), name


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {q.split("_")[0] for q in names if q.startswith("op")} >= {f"op{k}" for k in range(1, 11)}


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(found.fetchall(), key=repr)

"""Queries of the training-data operators and their DuckDB SQL."""

from pathlib import Path

from pyspark.sql import DataFrame

from ..cluster import ship
from . import bpe, exact_dedup, html_text, lexical_search, lz_dedup, mixing, ngram_join, periodic_runs, quality, token_counts, topk, toxicity, url_filter
from .staging import bounded_batches, table

VOCABULARY, COUNTED = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def op1_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op3_uniform_threshold_topk(spark, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op6_mincut_main_text(spark, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_indexed_quality(spark, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_words", "weight", "probability", "sampled")


def op10_lz_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return lz_dedup.lz_dedup(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path(COUNTED))


QUERIES = [
    op1_crf_toxicity,
    op2_url_filter,
    op3_uniform_threshold_topk,
    op4_exact_dedup,
    op5_ngram_jaccard_join,
    op6_mincut_main_text,
    op7_bpe_codec,
    op8_indexed_quality,
    op9_source_mixing,
    op10_lz_substring_dedup,
    op11_periodic_runs,
    op12_lexical_search,
    op13_token_counts,
]


def queries() -> dict:
    def shipped(f):
        def run(spark, sf_dir):
            ship(spark)
            bounded_batches(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op2_url_filter": url_filter.oracle(),
        "op3_uniform_threshold_topk": topk.oracle(),
        "op4_exact_dedup": f"""
with t as (select doc_id, {lower} as body from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(body) as text_sha256
from t window g as (partition by body)""",
        "op12_lexical_search": lexical_search.oracle(),
    }

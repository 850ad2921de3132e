"""Ranked lexical search by an Aho-Corasick scan of the documents (operator 12).

No index of documents is made. The distinct terms of the items, each guarded by a separator on both sides, make one
automaton; it is broadcast, and every task runs it over its documents' whole texts and reads the terms' frequencies
off the hits. Two scans:

1. Counts. Each task sums terms, documents, and the documents that hold each term of the items: one row a term and task.
2. Scores. With the terms' weights known, a term found gives its share to all items that its output maps to. A task
   keeps each item's best documents only; a last ranking takes those of all tasks, in salted shares first.

Items are worked on in blocks whose number and whose terms' bytes are bounded, so automaton and score matrix have a
proven size; each block is a scan of its own.

A term is a run of ASCII letters, digits and characters from U+0080 on; only A-Z are lower-cased. Null or empty texts
have no terms: they count nowhere and are never found. Items that are null, empty or without a term that any document
has give no rows. Every row of documents is a document of its own, also where doc_ids repeat; a null doc_id comes
last among equal scores. Of items that share an item_id each gets its own ranks; a null item_id is kept. Empty tables give
an empty result, extra columns are ignored. Very long texts are scanned whole.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, staged
from .words import NOT_ALNUM, Words, slices

TOP = 10
#: Items of a block, and bytes of its distinct terms.
BLOCK_ITEMS, BLOCK_BYTES = 512, 1 << 20
#: Shares in which an item's candidates are first ranked.
SHARES = 16
#: Found documents that a task holds before it drops those below an item's best.
HELD = 50_000

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[NOT_ALNUM] = 32
_PLAIN[65:91] += 32
_TABLE = _PLAIN.tobytes()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, distinct terms) of the items, a bounded block at a time. One item's terms may exceed a block's bytes; it then is a block."""
    out, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        terms = sorted(set(terms_of(r.text)))
        new = sum(map(len, terms))
        if out and (len(out) >= BLOCK_ITEMS or size + new > BLOCK_BYTES):
            yield out
            out, size = [], 0
        if terms:
            out.append((r.item_id, terms))
            size += new
    if out:
        yield out


@lru_cache(2)
def _automaton(terms: tuple[bytes, ...]):
    """Guarded terms; its alphabet are bytes, written as the characters of their numbers."""
    found = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        found.add_word(f" {t.decode('latin-1')} ", k)
    found.make_automaton()
    return found


def _scanned(batch: pa.RecordBatch, terms: tuple[bytes, ...]):
    """(first row, terms of each row, then of each row and term found together: row, term, frequency), slice by slice."""
    automaton = _automaton(terms)
    for first, data, offsets in slices(batch.column("text")):
        n = np.diff(Words(data, offsets, between=NOT_ALNUM).ptr)
        plain = _PLAIN[data].tobytes()
        keys = []
        for row in np.flatnonzero(n):
            # Neighbouring terms share their guard: the automaton goes on from it as the next term's first.
            text = f" {plain[offsets[row] : offsets[row + 1]].decode('latin-1')} "
            hits = np.fromiter((k for _, k in automaton.iter(text)), np.int64)
            keys.append(hits + row * len(terms))
        key, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        yield first, n, key // len(terms), key % len(terms), tf


def _counts(terms: tuple[bytes, ...]):
    def run(batches):
        df, docs, total = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            for _, n, _, term, _ in _scanned(b, terms):
                docs += int((n > 0).sum())
                total += int(n.sum())
                df += np.bincount(term, minlength=len(terms))
        at = np.flatnonzero(df)
        # Two numbers behind the terms: documents and terms in all.
        number = np.append(at, [len(terms), len(terms) + 1])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.append(df[at], [docs, total]))], ["term", "n"])

    return run


def _scores(terms: tuple[bytes, ...], maps: list[np.ndarray], weights: np.ndarray, n_docs: int, total: int, items: int, top: int, doc_type: pa.DataType):
    """``maps``: items of each term."""
    first = np.concatenate([[0], np.cumsum([len(m) for m in maps])])
    flat = np.concatenate(maps)

    def best(item, score, row):
        """Which of the found stay: the ``top`` of each item, equal scores by row."""
        order = np.lexsort((row, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        return order[rank < top]

    def run(batches):
        item, score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], doc_type)
        floor = np.ones(items, np.int64)
        for b in batches:
            for start, n, row, term, tf in _scanned(b, terms):
                m = np.array([10 + 90 * int(x) * n_docs // total for x in n], np.int64)
                share = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                many = first[term + 1] - first[term]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[term], many)
                # Sums stay below 2^53, so doubles hold them exactly.
                sums = np.bincount(np.repeat(row, many) * items + flat[at], np.repeat(share, many), len(n) * items).astype(np.int64).reshape(len(n), items)
                new_row, new_item = np.nonzero(sums >= floor)
                item, score = np.append(item, new_item), np.append(score, sums[new_row, new_item])
                ids = pa.concat_arrays([ids, b.column("doc_id").take(pa.array(new_row + start))])
                if len(item) > HELD:
                    item, score, ids, floor = pruned(item, score, ids, floor)
        item, score, ids, _ = pruned(item, score, ids, floor)
        yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(score)], ["item", "doc_id", "score"])

    def pruned(item, score, ids, floor):
        keep = best(item, score, ranks(ids))
        item, score, ids = item[keep], score[keep], ids.take(pa.array(keep))
        full = np.bincount(item, minlength=items) >= top
        lowest = np.full(items, np.iinfo(np.int64).max)
        np.minimum.at(lowest, item, score)
        return item, score, ids, np.where(full, lowest, floor)

    def ranks(ids):
        """Order of the ids, null last."""
        out = np.empty(len(ids), np.int64)
        out[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        return out

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``top`` documents of each item."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    texts, found = docs.select("doc_id", "text"), None
    doc_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    for block in blocks(items):
        terms = tuple(sorted({t for _, ts in block for t in ts}))
        number = {t: k for k, t in enumerate(terms)}
        maps: list[list[int]] = [[] for _ in terms]
        for k, (_, ts) in enumerate(block):
            for t in ts:
                maps[number[t]].append(k)
        counted = staged(texts.mapInArrow(_counts(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "term-counts", len(terms) + 2)
        df = np.zeros(len(terms) + 2, np.int64)
        for r in counted.toLocalIterator():
            df[r.term] = r.n
        discard(counted)
        n_docs, total = int(df[-2]), int(df[-1])
        if not total:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df[:-2]], np.int64)
        scan = _scores(terms, [np.array(m) for m in maps], weights, n_docs, total, len(block), top, doc_type)
        rows = texts.mapInArrow(scan, f"item long, doc_id {kinds[0]}, score long")
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item long, item_id {kinds[1]}")
        rows = _ranked(_ranked(rows, top, F.pmod(F.xxhash64("doc_id", "score"), F.lit(SHARES))), top)
        rows = rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long") if found is None else found


def _ranked(rows: DataFrame, top: int, *share) -> DataFrame:
    order = Window.partitionBy("item", *share).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.select("item", "doc_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)


def oracle() -> str:
    return r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
g as (select count(*) as n_docs, sum(len(terms))::bigint as total from d where len(terms) > 0),
t as (select doc_id, len(terms)::bigint as n, unnest(terms) as term from d),
f as (select doc_id, n, term, count(*) as tf from t group by all),
i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from f, g group by term),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::bigint as score
      from i join f using (term) join w using (term), g group by item_id, doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 10"""

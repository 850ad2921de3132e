"""Substring dedup by relative Lempel-Ziv factors (operator 10).

Every document is a reference for the documents after it. A document is parsed into factors: from a word whose 13-word
window an earlier document has, the factor grows greedily as long as the next window continues in the same reference
document at the next word. Factors are 13 words at least, so each is a duplicate span. Where a factor ends, the windows
that reach over its boundary are looked up too: one that another reference has extends the span by a factor of its own.
The removed words are thus exactly those of the windows that an earlier document has.

References are found without gathering them in a task:

1. Anchors. Each window has a minimizer, the smallest hash of its 4-word grams, so equal windows have
   equal minimizers and only about a fifth of the grams are counted. Minimizers that occur in two
   documents set a bit in a bitmap of fixed size; those that very many tasks have, in a second one.
2. Index. Windows whose minimizer has its bit set go to the minimizer's task in runs and are sorted there; each gets the
   earliest document that has it and the word where it starts. What a task can decide among its own documents it
   decides before the shuffle, and windows of very frequent minimizers are first decided in salted shares, so a
   passage that fills the corpus costs one row a share.
3. The factors of a document are cut out of its text.

A full bitmap lets more windows through to the sort; it never changes the result. Windows are told by 64-bit hashes of
their words; texts are not compared again.

Null text has no words. Rows with a null doc_id neither lose words nor serve as a reference. Rows that repeat a doc_id
are judged each by its own text, and never against each other. An empty table gives an empty result. Very long texts
are cut whole. Extra columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged
from .words import Words, mix, slices

WINDOW, GRAM = 13, 4
#: Bits of the bitmap of shared anchors (2^27 bits are 16 MB).
BITMAP_BITS = 27
SLICE = 2 << 20
#: Slices that have a minimizer before it is very frequent, and the shares that its windows are first decided in.
FREQUENT, SHARES = 64, 64


def _minimizers(words: Words, hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest gram hash of each window, by the window's first word."""
    g, _ = words.grams(hashes, gram)
    count = len(hashes) - window + 1
    m = g[:count].copy()
    for k in range(1, window - gram + 1):
        np.minimum(m, g[k : k + count], out=m)
    return m


def _windows(text, window: int, gram: int):
    """(first row, row, word position, minimizer, window hash, second hash) of all windows, slice by slice."""
    for first, data, offsets in slices(text, SLICE):
        w = Words(data, offsets)
        hashes = w.hashes()
        if len(hashes) < window:
            continue
        full, valid = w.grams(hashes, window)
        low = _minimizers(w, hashes, window, gram)
        at = np.flatnonzero(valid)
        row = np.searchsorted(w.ptr, at, "right") - 1
        ends = mix(hashes[: len(full)] ^ np.uint64(0xA5A5A5A55A5A5A5A)) + np.uint64(31) * mix(hashes[window - 1 :] ^ np.uint64(0x5A5A5A5AA5A5A5A5))
        yield first, row, at - w.ptr[row], low[at], full[at], ends[at]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's key changes."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _anchors(window: int, gram: int):
    def run(batches):
        for b in batches:
            for _, row, _, low, _, _ in _windows(b.column("text"), window, gram):
                first = np.ones(len(low), bool)
                first[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                low, row = low[first], row[first]
                order = np.argsort(low)
                low, row = low[order], row[order]
                at = _starts(low)
                if not len(at):
                    continue
                several = np.minimum.reduceat(row, at) != np.maximum.reduceat(row, at)
                yield pa.RecordBatch.from_arrays([pa.array(low[at].view(np.int64)), pa.array(several.astype(np.int8) + np.int8(1))], ["anchor", "docs"])

    return run


def shared_anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITMAP_BITS, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the minimizers that occur in more than one row, and of the very frequent ones: 2^bits bits, whatever the corpus."""
    counted = docs.select("text").mapInArrow(_anchors(window, gram), "anchor long, docs byte")
    shared = counted.groupBy("anchor").agg(F.sum("docs").alias("docs")).where("docs > 1")
    bit = F.shiftrightunsigned("anchor", 64 - bits)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - bits}) & 63 as int))")
    packed = shared.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask"), F.bit_or(F.when(F.col("docs") >= frequent, mask)).alias("often")).toArrow()
    out = []
    for column in ("mask", "often"):
        bitmap = np.zeros(1 << (bits - 6), np.uint64)
        bitmap[packed.column("word").to_numpy()] = packed.column(column).fill_null(0).to_numpy().view(np.uint64)
        out.append(bitmap)
    return out[0], out[1]


#: A document is a doc_id and a hash of its text. ``tags``: of windows to look up, from position ``pos`` on. Without tags
#: the row is a run that is decided: ``n`` windows that document ``src`` has from word ``at`` on.
_INDEX = "anchor long, often boolean, doc_id long, name long, pos int, n int, src long, at int, tags array<long>"
_RUN = "doc_id long, name long, pos int, n int, src long, at int"


def _marked(bitmap: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    at = low >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(at, len(values)).astype(np.int32)), pa.array(values.astype(np.int64)))


def _run_rows(doc, name, pos, src, at) -> list[pa.Array]:
    """Runs of windows that go on in one document and in one reference; windows are sorted by document and position."""
    k = np.arange(len(pos))
    first = _starts(doc, name, pos - k, src, at - k)
    n = np.diff(np.append(first, len(pos)))
    return [pa.array(c[first], t) for c, t in zip((doc, name, pos), (pa.int64(), pa.int64(), pa.int32()), strict=True)] + [pa.array(n, pa.int32()), pa.array(src[first], pa.int64()), pa.array(at[first], pa.int32())]


def _index_rows(bitmaps, window: int, gram: int, bits: int):
    """Windows to look up in other tasks, in runs that share an anchor, and runs that this task has decided."""

    def run(batches):
        shared, often = bitmaps.value
        names = ["anchor", "often", "doc_id", "name", "pos", "n", "src", "at", "tags"]
        for b in batches:
            ids = b.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids, texts = ids.fill_null(0).to_numpy(), b.column("name").to_numpy()
            for first, row, pos, low, full, ends in _windows(b.column("text"), window, gram):
                hit = _marked(shared, low, bits) & known[row + first]
                row, pos, low, tag = row[hit], pos[hit], low[hit], mix(full[hit] ^ ends[hit]).view(np.int64)
                doc, name = ids[row + first], texts[row + first]
                if not len(doc):
                    continue
                many, low = _marked(often, low, bits), low.view(np.int64)
                order = np.lexsort((pos, doc, tag, low))
                at = _starts(low[order], tag[order])
                size = np.diff(np.append(at, len(doc)))
                src, where = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
                src[order], where[order] = np.repeat(doc[order][at], size), np.repeat(pos[order][at], size)
                decided = doc > src
                if decided.any():
                    cols = _run_rows(*(x[decided] for x in (doc, name, pos, src, where)))
                    n = len(cols[0])
                    yield pa.RecordBatch.from_arrays([pa.array(mix(cols[1].to_numpy().view(np.uint64)).view(np.int64)), pa.array(np.zeros(n, bool)), *cols, pa.nulls(n, pa.list_(pa.int64()))], names)
                row, pos, low, tag, doc, name, many = (x[~decided] for x in (row, pos, low, tag, doc, name, many))
                if len(doc):
                    at = _starts(row, low, pos - np.arange(len(pos)))
                    none = [pa.nulls(len(at), t) for t in (pa.int32(), pa.int64(), pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(low[at]), pa.array(many[at]), pa.array(doc[at]), pa.array(name[at]), pa.array(pos[at].astype(np.int32)), *none, _lists(tag, at)], names)

    return run


def _found(rest: bool):
    """From windows sorted by (anchor, tag, doc_id, pos), as runs: those that an earlier document has. With ``rest``
    also what stays to look up, as index rows: of each window the earliest document's.
    """

    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            anchor, tag, doc, name, pos = (b.column(n).to_numpy() for n in ("anchor", "tag", "doc_id", "name", "pos"))
            first = _starts(anchor, tag)
            size = np.diff(np.append(first, len(doc)))
            src, at = np.repeat(doc[first], size), np.repeat(pos[first], size)
            if last and last[:2] == (anchor[0], tag[0]):
                src[: size[0]], at[: size[0]] = last[2:]
            last = (anchor[-1], tag[-1], src[-1], at[-1])
            hit = doc > src
            order = np.flatnonzero(hit)
            order = order[np.lexsort((pos[order], name[order], doc[order]))]
            cols = _run_rows(doc[order], name[order], pos[order], src[order], at[order])
            if not rest:
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "name", "pos", "n", "src", "at"])
                continue
            keep, k = np.flatnonzero(~hit), int(hit.sum())
            m = len(keep)
            n = len(cols[0])
            tags = _lists(tag[keep], np.arange(m))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(mix(cols[1].to_numpy().view(np.uint64)).view(np.int64)) if k else pa.array([], pa.int64()), pa.array(tag[keep])]),  # from here on each window is dealt by its own hash
                    pa.array(np.zeros(n + m, bool)),
                    *(pa.concat_arrays([c, pa.array(x[keep], c.type) if x is not None else pa.nulls(m, c.type)]) for c, x in zip(cols, (doc, name, pos, None, None, None), strict=True)),
                    pa.concat_arrays([pa.nulls(n, tags.type), tags]),
                ],
                ["anchor", "often", "doc_id", "name", "pos", "n", "src", "at", "tags"],
            )

    return run


def _windows_of(rows: DataFrame) -> DataFrame:
    """One row for each window to look up."""
    return rows.where("tags is not null").select("anchor", "doc_id", "name", F.col("pos").alias("start"), F.posexplode("tags").alias("k", "tag")).select("anchor", "tag", "doc_id", "name", (F.col("start") + F.col("k")).alias("pos"))


def duplicate_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITMAP_BITS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, name, runs): of each document the runs of windows that an earlier document has too: pos, n, src, at."""
    spark = docs.sparkSession
    bitmaps = spark.sparkContext.broadcast(shared_anchors(docs, window, gram, bits, frequent))
    named = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("name"))
    rows = staged(named.mapInArrow(_index_rows(bitmaps, window, gram, bits), _INDEX), "windows")
    order = ("anchor", "tag", "doc_id", "pos")
    hot = _windows_of(rows.where("often")).repartition("tag", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    hot = staged(hot.sortWithinPartitions(*order).mapInArrow(_found(True), _INDEX), "frequent-windows")
    rest = rows.where("not often").unionByName(hot)
    looked_up = _windows_of(rest.repartition("anchor")).sortWithinPartitions(*order).mapInArrow(_found(False), _RUN)
    runs = rest.where("tags is null").select("doc_id", "name", "pos", "n", "src", "at").unionByName(looked_up)
    out = staged(runs.groupBy("doc_id", "name").agg(F.collect_list(F.struct("pos", "n", "src", "at")).alias("runs")), "runs")
    discard(rows, hot)
    return out


def factors(pos: np.ndarray, n: np.ndarray, src: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The parse of one document: start, words, reference and its start word of each factor, in order.

    Runs that continue each other in one reference grow into one factor; the next factor starts with the first window
    behind the last that it holds, so windows over a boundary are factors too.
    """
    order = np.argsort(pos)
    pos, n, src, at = pos[order], n[order], src[order], at[order]
    goes_on = np.zeros(len(pos), bool)
    goes_on[1:] = (pos[1:] == pos[:-1] + n[:-1]) & (src[1:] == src[:-1]) & (at[1:] == at[:-1] + n[:-1])
    first = np.flatnonzero(~goes_on)
    return pos[first], np.add.reduceat(n, first) + window - 1, src[first], at[first]


def _cut(window: int, full: bool):
    def run(batches):
        spans = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int32())]))
        for b in batches:
            n_words, removed, sha, kept_text, parsed = [], [], [], [], []
            for text, runs in zip(b.column("text"), b.column("runs"), strict=True):
                words = (text.as_py() or "").encode().split()
                gone, found = 0, ()
                n_words.append(len(words))
                if runs.is_valid:
                    found = factors(*(runs.values.field(k).to_numpy() for k in ("pos", "n", "src", "at")), window)
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, found[0], 1)
                    np.add.at(edge, found[0] + found[1], -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    gone = int(cover.sum())
                    words = [words[i] for i in np.flatnonzero(~cover)]
                removed.append(gone)
                kept = b" ".join(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                if full:
                    kept_text.append(kept.decode())
                    parsed.append([dict(zip(("start", "words", "doc_id", "at"), map(int, f), strict=True)) for f in zip(*found, strict=True)])
            cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            more = [pa.array(kept_text, pa.string()), pa.array(parsed, spans)] if full else []
            yield pa.RecordBatch.from_arrays([*cols, *more], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept", "factors"] if full else [])])

    return run


def lz_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITMAP_BITS, full: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with ``full`` also the kept words and the factors (start, words, reference, its start)."""
    found = duplicate_runs(docs, window, gram, bits, frequent).select(F.col("doc_id").alias("_doc"), F.col("name").alias("_name"), "runs")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string" + ", kept string, factors array<struct<start:int,words:int,doc_id:long,at:int>>" * full
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    rows = named.join(found, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.col("_text") == F.col("_name")), "left")
    return rows.select("doc_id", "text", "runs").mapInArrow(_cut(window, full), schema)

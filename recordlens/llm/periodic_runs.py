"""Periodic runs of words by scale-tiled solving and stitching (operator 11).

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(6, 4 * q) words, that no neighbouring word extends. Periods are parted into octaves [2^k, 2^(k+1)):

1. Tiles. An octave's tiles lie around boundaries 3 * 2^k words apart and overlap: 3 * 2^k words before the boundary,
   8 * 2^k behind it. Every run of the octave holds a boundary. A tile is dealt out only if it can hold a run: hashes of
   2^(k+1)-grams, doubled from octave to octave over the grams that recur, show where a gram comes again after a
   distance of the octave, which it does in every run.
2. Solving. A tile is solved by itself, on the words, by Z-functions from its boundary: of the words behind it (how far
   words q apart go on being identical) and of the reversed words before it (since when they are). A stretch that is
   long enough is a fragment, unless a divisor of q is its period too.
3. Stitching. Fragments go to their document and period and those that overlap are joined. A stretch that a tile cuts
   is long enough in that tile, and its neighbours overlap there, so the joined fragments are exactly the runs.

Tiles of documents of more than ``huge`` characters are rows that are dealt over all tasks before they are solved;
those of other documents are solved where their text is, with the same result. A task joins a document's fragments
before they are sent.

Null and empty texts have no words and no runs. Rows are numbered by themselves, so repeated rows, rows that share a doc_id
and null doc_ids each get their own result. An empty table gives an empty result. Extra columns are ignored.
Grams are compared by 64-bit hashes of their words to choose tiles; the words themselves decide.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged
from .words import Words, mix, slices

LEAST, TIMES = 6, 4
#: Characters of texts whose tiles are dealt over all tasks.
HUGE_CHARS = 1 << 22

_FRAGMENT = "period: int, start: long, stop: long"
_GRAM = np.uint64(0x9E3779B97F4A7C15)


def need(q: int) -> int:
    """Words of a run of period q that are identical to the word q places on."""
    return max(LEAST, TIMES * q) - q


def chosen(row: np.ndarray, hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(octave, words) of a slice's words: first words of a gram of 2^(k+1) words that comes again in the row 2^k to 2^(k+1) - 1 words on."""
    n, k, out = len(hashes), 0, []
    at = np.flatnonzero(row[1:] == row[:-1]) if n else np.zeros(0, np.int64)
    salted = mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))
    gram = mix(salted[at] * _GRAM + salted[at + 1]) if n else salted
    while len(at):
        order = np.argsort(gram, kind="stable")
        g, p = gram[order], at[order]
        again = g[1:] == g[:-1]
        gap = p[1:] - p[:-1]
        found = p[:-1][again & (gap >= 1 << k) & (gap < 2 << k)]
        if len(found):
            out.append((k, np.sort(found)))
        # Grams of the next octave are two of these, one behind the other, that both recur.
        stay = np.zeros(len(p), bool)
        stay[1:] |= again
        stay[:-1] |= again
        p, g = p[stay], g[stay]
        order = np.argsort(p)
        p, g = p[order], g[order]
        follows = np.searchsorted(p, p + (2 << k))
        both = follows < len(p)
        both[both] = p[follows[both]] == p[both] + (2 << k)
        at, follows = p[both], follows[both]
        gram = mix(g[both] * _GRAM + g[follows])
        same = row[at] == row[at + (4 << k) - 1]
        at, gram, k = at[same], gram[same], k + 1
    return out


def boundaries(k: int, found: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boundaries of the octave, counted from their row's first word on, next to the found words: the last one up to each, and the next."""
    step = 3 << k
    low = begins + (found - begins) // step * step
    high = np.where(low == found, low, low + step)
    return np.unique(np.concatenate([low, high[high < ends]]))


def z_function(s: list) -> list[int]:
    """How many elements from each place on are those that the list begins with."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        m = min(z[i - left], right - i) if i < right else 0
        while i + m < n and s[m] == s[i + m]:
            m += 1
        z[i] = m
        if i + m > right:
            left, right = i, i + m
    return z


def solve(words: list, middle: int, k: int) -> list[tuple[int, int, int]]:
    """(period, first word, first word behind the last that is identical to the word a period on) of the octave's stretches over ``middle``."""
    n, size = len(words), 1 << k
    if middle + size >= n:
        return []
    forward = z_function(words[middle:])
    reach = min(n, middle + 2 * size - 1)
    back = words[:middle][::-1]
    # ``None`` is no word: what follows it is compared with what stands before the boundary only.
    backward = z_function([*back, None, *words[:reach][::-1]])
    out = []
    for q in range(size, min(2 * size, n - middle)):
        f, b = min(forward[q], 6 * size), backward[len(back) + 1 + reach - middle - q] if middle + q <= reach else 0
        if f and f + b >= need(q) and not any(words[middle - b + r : middle - b + q] == words[middle - b : middle - b + q - r] and words[middle - b : middle - b + r] == words[middle - b + q - r : middle - b + q] for r in _divisors(q)):
            out.append((q, middle - b, middle + f))
    return out


def _divisors(q: int) -> list[int]:
    """q over each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out + ([q // rest] if rest > 1 else [])


def joined(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one period that overlap or touch become one."""
    out: list[tuple[int, int, int]] = []
    for q, a, b in sorted(fragments):
        if out and out[-1][0] == q and a <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((q, a, b))
    return out


def tiles(text: pa.Array):
    """(first row, words of the slice, tiles); a tile is (row, octave, first word, boundary, word behind the last), counted over the slice."""
    for first, data, offsets in slices(text):
        w = Words(data, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(w.ptr))
        out = []
        for k, found in chosen(row, w.hashes()):
            at = boundaries(k, found, w.ptr[row[found]], w.ptr[row[found] + 1])
            begin, end = w.ptr[row[at]], w.ptr[row[at] + 1]
            out += zip(row[at].tolist(), [k] * len(at), np.maximum(at - (3 << k), begin).tolist(), at.tolist(), np.minimum(at + (8 << k), end).tolist(), strict=True)
        yield first, w, out


def _solved_in_place(full: bool):
    """Of each row its fragments, and its text if there are any (or ``full``), else the digest of its words."""

    def run(batches):
        for b in batches:
            yield from _of_batch(b, full)

    return run


def _of_batch(b: pa.RecordBatch, full: bool):
    text = b.column("text")
    found: dict[int, list] = {}
    sha: list[str | None] = []
    for first, w, out in tiles(text):
        raw = w.data.tobytes()
        words = [raw[a:z] for a, z in zip(w.starts.tolist(), w.ends.tolist(), strict=True)] if out else None
        for row, k, begin, at, end in out:
            base = int(w.ptr[row])
            if got := solve(words[begin:end], at - begin, k):
                found.setdefault(row + first, []).extend((q, begin - base + x, begin - base + y) for q, x, y in got)
        ptr = w.ptr.tolist()
        for row in range(len(ptr) - 1):
            kept = None if row + first in found else b" ".join(raw[w.offsets[row] : w.offsets[row + 1]].split())
            sha.append(None if kept is None else hashlib.sha256(kept).hexdigest())
    rows = [_structs(joined(found[k])) if k in found else None for k in range(b.num_rows)]
    mask = pa.array([full or k in found for k in range(b.num_rows)])
    yield pa.RecordBatch.from_arrays(
        [b.column("doc_id"), pc.if_else(mask, text, pa.nulls(b.num_rows, text.type)), pa.array(sha, pa.string()), pa.array(rows, _STRUCTS)],
        ["doc_id", "text", "sha", "fragments"],
    )


_STRUCTS = pa.list_(pa.struct([("period", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))


def _structs(fragments):
    return [{"period": q, "start": a, "stop": b} for q, a, b in fragments]


def _tile_rows(batches):
    """Tiles as rows: their words are numbered within the document."""
    for b in batches:
        for first, w, out in tiles(b.column("text")):
            raw = w.data.tobytes()
            numbers: dict[bytes, int] = {}
            word = np.array([numbers.setdefault(raw[a:z], len(numbers)) for a, z in zip(w.starts.tolist(), w.ends.tolist(), strict=True)], np.int32)
            for at in range(0, len(out), 1000):
                part = out[at : at + 1000]
                base = [int(w.ptr[t[0]]) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column("row")[t[0] + first].as_py() for t in part], pa.int64()),
                        pa.array([t[1] for t in part], pa.int32()),
                        pa.array([t[2] - o for t, o in zip(part, base, strict=True)], pa.int64()),
                        pa.array([t[3] - t[2] for t in part], pa.int64()),
                        pa.array([word[t[2] : t[4]] for t in part], pa.list_(pa.int32())),
                    ],
                    ["row", "octave", "begin", "middle", "words"],
                )


def _solved_tiles(batches):
    for b in batches:
        out: dict[int, list] = {}
        for row, k, begin, middle, words in zip(*(b.column(c).to_pylist() for c in ("row", "octave", "begin", "middle")), b.column("words"), strict=True):
            out.setdefault(row, []).extend((q, begin + x, begin + y) for q, x, y in solve(words.values.to_pylist(), middle, k))
        flat = [(row, *f) for row, fragments in out.items() for f in joined(fragments)]
        cols = list(zip(*flat, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["row", "period", "start", "stop"])


def stitched(fragments: DataFrame) -> DataFrame:
    """(row, period, start, length) of the runs from (row, period, start, stop) of their fragments."""
    w = Window.partitionBy("row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    parts = parts.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.select("row", "period", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"))


def _collapsed(full: bool):
    def run(batches):
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["runs", "collapsed"] if full else [])]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, runs in zip(b.column("doc_id"), b.column("text"), b.column("runs"), strict=True):
                runs = sorted((r["start"], r["period"], r["length"]) for r in runs.as_py() or ())
                words = (text.as_py() or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, [s + q for s, q, _ in runs], 1)
                np.add.at(edge, [s + n for s, _, n in runs], -1)
                kept = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])
                # Greatest length / period: compared as whole numbers crosswise.
                best = runs[0] if runs else None
                for r in runs[1:]:
                    if r[2] * best[1] > best[2] * r[1]:
                        best = r
                most = [best[0], best[2], best[1], 1000 * best[2] // best[1]] if best else [None] * 4
                lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
                row = [doc.as_py(), len(runs), *most, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
                if full:
                    row += [[{"start": s, "length": n, "period": q} for s, q, n in runs], kept.decode()]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            types = [b.column("doc_id").type, *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names)

    return run


def periodic_runs(docs: DataFrame, full: bool = False, huge: int = HUGE_CHARS) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, digests of the runs and of the words without repetitions, for each row.

    With ``full`` also the runs (start, length, period) and the words that are left.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", "text")
    large = F.coalesce(F.length("text"), F.lit(0)) > huge
    small = texts.where(~large).mapInArrow(_solved_in_place(full), f"doc_id {kind}, text string, sha string, fragments array<struct<{_FRAGMENT}>>")
    small = staged(small.withColumn("row", F.monotonically_increasing_id()), "runs")
    # Below 0, so that the rows of both tables differ.
    big = staged(texts.where(large).withColumn("row", -1 - F.monotonically_increasing_id()), "huge-texts")
    dealt = big.mapInArrow(_tile_rows, "row long, octave int, begin long, middle long, words array<int>").repartition("row", "begin", "octave")
    fragments = small.where("fragments is not null").select("row", F.inline("fragments")).unionByName(dealt.mapInArrow(_solved_tiles, f"row long, {_FRAGMENT}"))
    runs = stitched(fragments).groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    rows = (small if full else small.where("fragments is not null")).select("row", "doc_id", "text").unionByName(big.select("row", "doc_id", "text"))
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * full
    found = rows.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(_collapsed(full), schema)
    if full:
        return found
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    without = small.where("fragments is null").select("doc_id", F.lit(0).cast("long").alias("n_runs"), *none, F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.col("sha").alias("collapsed_sha256"))
    return found.unionByName(without)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def planted(docs: DataFrame) -> DataFrame:
    """Documents in every tenth of which the words from a place on repeat: the query's input.

    With h the crc32 of the decimal doc_id, g = h div 10, and n words: where h mod 10 is 0, the first p words from word
    a on repeat to the end, for a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null doc_id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10), words_of(F.col("text"))
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))

"""Sequential folds over the pieces of one document: captions, paragraphs, segments, passages, roles.

Input rows hold one document each, so documents scale out. A fold's state is small; where a fold needs
Python, Spark hands it whole documents in Arrow batches.
"""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import collapse
from ..shared import written
from .capture import numbered
from .components import connected
from .similarity import MARGIN

def new_suffix(previous: Column, current: Column) -> Column:
    """The part of ``current`` (array of lines) behind its longest overlap with the end of ``previous``."""
    n = F.least(F.size(previous), F.size(current))
    overlaps = F.filter(F.sequence(F.lit(0), n), lambda k: F.slice(current, 1, k) == F.slice(previous, F.size(previous) - k + 1, k))
    return F.when(previous.isNull(), current).otherwise(F.slice(current, F.array_max(overlaps) + 1, F.size(current)))


def caption_lines(cues: DataFrame) -> DataFrame:
    """(doc, start, ord, line): what each cue (doc, ord, start, lines) adds to the non-empty cue before it."""
    w = W.partitionBy("doc").orderBy("ord")
    c = cues.where(F.size("lines") > 0).withColumn("previous", F.lag("lines").over(w))
    return c.select("doc", "ord", "start", F.posexplode(new_suffix(F.col("previous"), F.col("lines"))).alias("k", "line"))


def pack_lines(lines: Column, limit: int) -> Column:
    """Greedy paragraphs of ``lines`` (array of struct start, line): joined by spaces while at most ``limit`` characters."""
    empty = F.struct(F.expr("cast(array() as array<struct<start:double,text:string>>)").alias("done"), F.lit(None).cast("double").alias("start"), F.lit("").alias("text"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["text"] == "") | (F.length(acc["text"]) + 1 + F.length(x["line"]) <= limit)
        joined = F.when(acc["text"] == "", x["line"]).otherwise(F.concat(acc["text"], F.lit(" "), x["line"]))
        closed = F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["text"].alias("text"))))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(closed).alias("done"),
            F.when(fits & (acc["text"] != ""), acc["start"]).otherwise(x["start"].cast("double")).alias("start"),
            F.when(fits, joined).otherwise(x["line"]).alias("text"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["text"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["text"].alias("text")))))

    return F.aggregate(lines, empty, step, finish)


def packed_words(documents: DataFrame, limit: int) -> DataFrame:
    """(doc, ord, text): greedy paragraphs of the words of documents (doc, text), as ``pack_lines`` makes them, a row each."""

    def run(batches):
        for b in batches:
            doc, number, text, size = [], [], [], 0
            for d, t in zip(*(b.column(c).to_pylist() for c in ("doc", "text")), strict=True):
                held, length, count = [], -1, 0
                for w in (t or "").split(" "):
                    if not w:
                        continue
                    if held and length + 1 + len(w) > limit:
                        doc.append(d), number.append(count), text.append(" ".join(held))
                        held, length, count = [], -1, count + 1
                    held.append(w)
                    length += 1 + len(w)
                if held:
                    doc.append(d), number.append(count), text.append(" ".join(held))
                size += len(t or "")
                if size >= 1 << 24:
                    yield _packed(b, doc, number, text)
                    doc, number, text, size = [], [], [], 0
            yield _packed(b, doc, number, text)

    flat = documents.select("doc", collapse(F.col("text")).alias("text"))
    return flat.mapInArrow(run, f"doc {dict(documents.dtypes)['doc']}, ord int, text string")


def _packed(batch: pa.RecordBatch, doc: list, number: list, text: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field("doc").type), pa.array(number, pa.int32()), pa.array(text, pa.string())], ["doc", "ord", "text"])


def timestamped_segments(text: Column) -> Column:
    """(ts, text) of each part behind a [HH:MM:SS], header up to --- left out, white space collapsed, empty parts dropped."""
    body = F.when(text.rlike(r"(?m)^---\s*$"), F.regexp_replace(text, r"(?ms)\A.*?^---[ \t]*$", "")).otherwise(text)
    parts = F.split(F.regexp_replace(body, r"\[(\d\d:\d\d:\d\d)\]", "\x00$1\x01"), "\x00")
    found = F.transform(F.filter(parts, lambda p: p.contains("\x01")), lambda p: F.struct(F.substring_index(p, "\x01", 1).alias("ts"), F.trim(F.regexp_replace(F.substring_index(p, "\x01", -1), r"\s+", " ")).alias("text")))
    return F.filter(found, lambda x: x["text"] != "")


def split_long(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters: cut behind a sentence end, else at the last space, else anywhere."""
    out = []
    while len(text) > limit:
        head = text[: limit + 1]
        ends = [m.end() for m in re.finditer(r"[.?!](?=\s)", head) if m.end() <= limit]
        at = ends[-1] if ends else head.rfind(" ")
        at = at if at > 0 else limit
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text] if text else out


def passages(documents: DataFrame, chunk: int = 1200) -> DataFrame:
    """(doc, passage, start, end, text) of documents (doc, text): segments, long ones split, packed up to ``chunk`` characters.

    A passage closes once its pieces, each counted with one character more, reach ``chunk``.
    """
    segments = documents.select("doc", timestamped_segments(F.col("text")).alias("segments"))

    def run(batches):
        for b in batches:
            doc, number, start, end, text = [], [], [], [], []
            for d, segs in zip(b.column("doc").to_pylist(), b.column("segments").to_pylist(), strict=True):
                held, size, count, first = [], 0, 0, None
                pieces = [(s["ts"], p) for s in segs or [] for p in (split_long(s["text"], chunk) if len(s["text"]) > 2 * chunk else [s["text"]])]
                for k, (ts, p) in enumerate(pieces):
                    first = first or ts
                    held.append(p)
                    size += len(p) + 1
                    if size >= chunk or k == len(pieces) - 1:
                        for column, v in zip((doc, number, start, end, text), (d, count, first, ts, " ".join(held)), strict=True):
                            column.append(v)
                        held, size, count, first = [], 0, count + 1, None
            yield pa.RecordBatch.from_arrays([pa.array(doc, b.schema.field("doc").type), pa.array(number, pa.int32()), *(pa.array(x, pa.string()) for x in (start, end, text))], ["doc", "passage", "start", "end", "text"])

    return segments.mapInArrow(run, f"doc {dict(documents.dtypes)['doc']}, passage int, start string, end string, text string")


def roles(segments: DataFrame, start_cue: str, end_cue: str, late: int = 80) -> DataFrame:
    """Adds role: public_comment from a start cue until an end cue, else official; agenda_reading where ``anchor`` is set.

    An end cue behind character ``late`` ends the comment only after its own segment. A segment that holds
    both cues is decided by the one that comes last.
    """
    w = W.partitionBy("doc").orderBy("seq")
    a, z = F.regexp_instr("text", F.lit(start_cue)), F.regexp_instr("text", F.lit(end_cue))
    # State behind a segment: the last cue wins; without a cue it carries over.
    after = F.when((a > 0) & (a > z), True).when(z > 0, False)
    s = segments.withColumns({"_a": a, "_z": z, "_after": after})
    before = F.coalesce(F.last("_after", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    inside = F.when(F.col("_a") > 0, True).when((F.col("_z") > 0) & (F.col("_z") <= late), False).otherwise(before)
    return s.withColumn("role", F.when(F.col("anchor"), "agenda_reading").when(inside, "public_comment").otherwise("official")).drop("_a", "_z", "_after")


def chain(candidates: DataFrame) -> DataFrame:
    """The heaviest chain of candidates (doc, seq, item, score) with both seq and item strictly rising, per document.

    The best chain that ends at a candidate is known once all with smaller seq are done; a prefix maximum
    over items (a Fenwick tree) finds it, so a document of n candidates costs n log n.
    """

    def run(key, table):
        t = table.sort_by([("seq", "ascending"), ("item", "ascending")])
        seq, item, score = (t.column(c).to_pylist() for c in ("seq", "item", "score"))
        rank = {v: k + 1 for k, v in enumerate(sorted(set(item)))}
        tree = [(0.0, -1)] * (len(rank) + 1)
        best, back, at = [0.0] * len(seq), [-1] * len(seq), 0
        while at < len(seq):
            stop = at
            while stop < len(seq) and seq[stop] == seq[at]:
                k, found = rank[item[stop]] - 1, (0.0, -1)
                while k > 0:
                    found = max(found, tree[k], key=lambda x: x[0])
                    k -= k & -k
                best[stop], back[stop] = score[stop] + found[0], found[1]
                stop += 1
            for i in range(at, stop):
                k = rank[item[i]]
                while k < len(tree):
                    if best[i] > tree[k][0]:
                        tree[k] = (best[i], i)
                    k += k & -k
            at = stop
        keep, i = [], max(range(len(seq)), key=lambda i: (best[i], -rank[item[i]])) if seq else -1
        while i >= 0:
            keep.append(i)
            i = back[i]
        return t.take(pa.array(sorted(keep), pa.int64()))

    return candidates.groupBy("doc").applyInArrow(run, candidates.schema)


def greedy_groups(rows: DataFrame, least: float, days: int) -> DataFrame:
    """Groups of actions (block, ord, day, tokens): each joins the group whose last action is most similar (Jaccard at least
    ``least``, at most ``days`` earlier; of equal ones the group opened first), else opens one. Adds grp, counted in a block by first actions.

    Order decides, but only among actions that may join each other: pairs that are similar and near in time meet by block and stretch
    of time, whole sets beside each other, and their connected components are folded, each by itself, over sorted rows. Actions without such a
    pair never reach a fold.
    A fold holds the groups of its component whose last action is at most ``days`` old.
    """
    numbers = written(rows.withColumn("id", F.monotonically_increasing_id()), "actions")
    sets = written(numbers.select("id", "block", "day", F.transform(F.array_distinct("tokens"), lambda t: F.xxhash64(t)).alias("tokens")).where(F.size("tokens") > 0), "sets")
    # Actions meet by block and stretches of ``days``, an earlier one also in the stretch behind its own.
    stretch = F.floor(F.col("day") / days)
    earlier = sets.select(F.col("id").alias("a"), "block", F.col("day").alias("_day"), F.col("tokens").alias("_a"), F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    later = sets.select(F.col("id").alias("b"), "block", "day", F.col("tokens").alias("_b"), stretch.alias("stretch"))
    m, n = F.size("_a"), F.size("_b")
    near = (F.col("day") - F.col("_day")).between(0, days) & ((F.col("_day") < F.col("day")) | (F.col("a") < F.col("b"))) & (F.least(m, n) >= (least - MARGIN) * F.greatest(m, n))
    # The similarity, rounded to six digits, is not below ``least``; written so that the sets are compared once.
    close = F.size(F.array_intersect("_a", "_b")) >= (least - 5e-7) / (1 + least - 5e-7) * (m + n)
    roots = connected(earlier.join(later, ["block", "stretch"]).where(near & close).select("a", "b"))
    linked = numbers.select("id", "day", "ord").join(sets.select("id", "tokens"), "id").join(roots, F.col("id") == F.col("node")).select("root", "day", "ord", "id", "tokens")

    def run(batches):
        root, lasts = None, {}
        for b in batches:
            out = []
            for key, day, ident, tokens in zip(*(b.column(c).to_pylist() for c in ("root", "day", "id", "tokens")), strict=True):
                if key != root:
                    root, lasts = key, {}
                lasts = {g: x for g, x in lasts.items() if day - x[0] <= days}
                mine, best = set(tokens), (-1.0, ident)
                for g, (_, last) in lasts.items():
                    common = len(mine & last)
                    sim = common / (len(mine) + len(last) - common)
                    if sim >= least and sim > best[0]:
                        best = (sim, g)
                # A group is named by its first action; names stay in the order of opening.
                lasts[best[1]] = (day, mine)
                out.append(best[1])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.int64())], ["id", "lead"])

    led = written(linked.repartition("root").sortWithinPartitions("root", "day", "ord").mapInArrow(run, "id long, lead long"), "groups")
    named = numbers.select("id", "block", "day", "ord").join(led, "id", "left").withColumn("lead", F.coalesce("lead", "id"))
    leads = numbered(named.where("id = lead").select("block", "day", "ord", "lead"), "block", "day", ["ord"], 365).select("lead", (F.col("cursor") - 1).cast("int").alias("grp"))
    return numbers.drop("tokens").join(named.select("id", "lead"), "id").join(leads, "lead").select(*[c for c in rows.columns if c != "tokens"], "grp")

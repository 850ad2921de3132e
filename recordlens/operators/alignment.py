"""Agenda items on the spoken timeline: spoken numbers, candidates, the best chain, item spans; greedy threads of sessions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx
from .folds import chain

# Spoken numbers and what captions make of them.
UNITS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
#: What captions make of a number, read as one only behind "next item is".
HOMOPHONES = {"a": 8, "ate": 8, "won": 1, "to": 2, "too": 2, "for": 4}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50}
STOP = ["this", "that", "with", "from", "item", "number", "next"]
NUMBER_WEIGHT, OVERLAP_WEIGHT, LEAST_OVERLAP = 2.5, 4.0, 0.2


def _lookup(word: Column, table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[word]


def item_number(spoken: Column) -> Column:
    """Digits, number words (tens and units) and a letter behind: "twenty one b" is 21B; null if it is no number."""
    words = F.split(F.trim(F.regexp_replace(F.lower(spoken), "[^a-z0-9]+", " ")), " ")
    w = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    ten, unit = _lookup(w(0), TENS), lambda k: _lookup(w(k), UNITS)
    value = F.when(w(0).rlike(r"^\d+[a-z]?$"), F.upper(w(0))).when(ten.isNotNull() & (unit(1) < 10), (ten + unit(1)).cast("string")).when(ten.isNotNull(), ten.cast("string")).otherwise(unit(0).cast("string"))
    after = F.when(w(0).rlike(r"^\d+[a-z]$"), F.lit("")).when(ten.isNotNull() & (unit(1) < 10), w(2)).otherwise(w(1))
    return F.when(after.rlike("^[b-z]$"), F.concat(value, F.upper(after))).otherwise(value)


def anchors(segments: DataFrame) -> DataFrame:
    """(doc, seq, ts, number, tokens): segments that announce an item by its number."""
    said = F.regexp_extract("text", r"(?i)(?:item|number|agenda item)\s+(?:is\s+)?(?:number\s+)?([a-z0-9]+(?:[ -][a-z0-9]+){0,2})", 1)
    heard = F.regexp_extract("text", rf"(?i)\bnext item is (?:number |item )?({'|'.join(HOMOPHONES)})\b[ ,.]", 1)
    number = F.coalesce(item_number(said), _lookup(F.lower(heard), HOMOPHONES).cast("string"))
    a = segments.withColumn("number", number).where("number is not null")
    return a.select("doc", "seq", "ts", "number", fx.token_set(F.col("text"), STOP).alias("tokens"))


def candidates(anchor: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, seq, item, score, ts, matched): anchors with the items (doc, item, number, title) of their document that they may announce.

    By equal number, or by common title words: both are equalities, so a document's anchors and items are never all paired.
    """
    i = items.withColumn("title_tokens", fx.token_set(F.col("title"), STOP))
    share = F.size(F.array_intersect("tokens", "title_tokens")) / F.greatest(F.size("title_tokens"), F.lit(1))
    numbered = anchor.join(i.withColumn("number", F.upper("number")), ["doc", "number"]).select("doc", "seq", "ts", "item", F.lit(1.0).alias("num"), share.alias("share"))
    worded = (
        anchor.withColumn("t", F.explode("tokens")).join(i.drop("number").withColumn("t", F.explode("title_tokens")), ["doc", "t"]).dropDuplicates(["doc", "seq", "item"]).select("doc", "seq", "ts", "item", F.lit(0.0).alias("num"), share.alias("share"))
    )
    best = numbered.unionByName(worded.where(F.col("share") >= LEAST_OVERLAP)).groupBy("doc", "seq", "ts", "item").agg(F.max("num").alias("num"), F.max("share").alias("share"))
    return best.select("doc", "seq", "item", (NUMBER_WEIGHT * F.col("num") + OVERLAP_WEIGHT * F.col("share")).alias("score"), "ts", (F.col("num") > 0).alias("matched"))


def aligned(segments: DataFrame, items: DataFrame) -> DataFrame:
    """Items with start (the announcing segment) and end (the next item's start; null for the last), by the heaviest rising chain."""
    best = chain(candidates(anchors(segments), items))
    return best.withColumns({"start": F.col("ts"), "end": F.lead("ts").over(W.partitionBy("doc").orderBy("seq"))}).drop("ts")


def merged_threads(sessions: DataFrame, least: float = 0.13, days: float = 14.0, back: int = 12, top: int = 50) -> DataFrame:
    """Adds thread to sessions (owner, session, start, end, counts: map term -> count): greedy merge by profile overlap.

    A session joins the most similar of the last ``back`` threads that its owner has opened, if the thread's last turn is
    at most ``days`` old and the overlap reaches ``least``; of equals the one opened last. A profile is the ``top`` terms of all the
    thread's turns, so merging adds counts and takes the profile anew. Order decides: an owner's sessions are one fold.
    """

    def profile(counts: dict) -> dict:
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]
        whole = sum(n for _, n in best) or 1.0
        return {t: n / whole for t, n in best}

    def run(key, table):
        import pyarrow as pa

        t = table.sort_by([("start", "ascending"), ("session", "ascending")])
        threads, out = [], []  # the last turn's time, counts, profile; in the order of opening
        for start, end, pairs in zip(*(t.column(c).to_pylist() for c in ("start", "end", "counts")), strict=True):
            counts, best = dict(pairs or []), (0.0, None)
            mine = profile(counts)
            for k in range(len(threads) - 1, max(-1, len(threads) - 1 - back), -1):
                last, _, theirs = threads[k]
                total = sum(mine.values()) + sum(theirs.values())
                sim = 2 * sum(min(w, theirs[x]) for x, w in mine.items() if x in theirs) / total if total else 0.0
                if (start - last) // 86400 <= days and sim > best[0]:
                    best = (sim, k)
            sim, k = best
            if k is None or sim < least:
                k = len(threads)
                threads.append((end, counts, mine))
            else:
                both = dict(threads[k][1])
                for x, n in counts.items():
                    both[x] = both.get(x, 0) + n
                threads[k] = (end, both, profile(both))
            out.append(k)
        return t.drop_columns(["counts"]).append_column("thread", pa.array(out, pa.int32()))

    names = [f"{n} {k}" for n, k in sessions.dtypes if n != "counts"]
    return sessions.groupBy("owner").applyInArrow(run, ", ".join([*names, "thread int"]))

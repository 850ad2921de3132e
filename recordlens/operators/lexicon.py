"""Classification against a lexicon: hits, scores, rhetoric, claims, themes, search."""

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx


@dataclass
class Lexicon:
    """Terms by category; scoring weights and the review threshold."""

    deviation: list[str]
    statutory: list[str]
    enforcement: list[str]
    rhetoric: dict[str, list[str]] = field(default_factory=dict)
    exclusions: dict[str, dict[str, str]] = field(default_factory=dict)
    deviation_weight: float = 1.5
    statutory_weight: float = 2.0
    threshold: float = 3.0

    def categories(self) -> dict[str, list[str]]:
        return {"deviation": self.deviation, "statutory": self.statutory, "enforcement": self.enforcement}


# The default lexicon of public-meeting records.
DEFAULT = Lexicon(
    deviation=[
        "warrant", "statute", "timeline", "ordinance", "prolonged", "unverified", "non-compliant", "pretext", "tabled", "postponed", "without notice", "no notice",
        "point of order", "out of order", "suspend the rules", "waive the rules", "emergency ordinance", "executive session", "past the deadline", "missed the deadline",
        "not on the agenda", "without a second", "failed to", "appeal",
    ],
    statutory=[
        "w.s.", "wyoming statute", "municipal code", "city code", "fourth amendment", "due process", "administrative procedure", "title 16", "public meetings act",
        "public records act", "open meetings", "unified development code", "udc", "charter", "state law",
    ],
    enforcement=["detention", "detained", "felony", "misdemeanor", "citation", "seizure", "arrest", "code enforcement", "nuisance abatement", "lien", "penalty"],
    rhetoric={
        "objective": ["according to", "per the", "the data", "the report", "staff report", "the record", "section", "percent", "dollars", "the statute", "the ordinance says", "as written", "documented", "the numbers", "audit"],
        "subjective": ["i feel", "i think", "i believe", "in my opinion", "frankly", "honestly", "i'm concerned", "i am concerned", "my gut", "i'm not comfortable", "personally"],
        "deferral": ["look into it", "get back to you", "follow up", "table this", "at a later date", "next meeting", "not prepared", "we'll see", "down the road", "take it under advisement"],
        "authority": ["legal advised", "city attorney", "our attorney", "legal counsel", "staff recommends", "staff recommendation", "the state requires", "we're required", "we are required", "mandated"],
    },
    exclusions={
        "detention": {"near": r"\b(?:pond|ponds|basin|basins|storm ?water|drainage|retention|facility|area)\b"},
        "warrant": {"after": r"^(?:s)?\s+(?:a|an|the|further|more|it|some|any|that|this|additional|consideration|review|discussion)\b"},
        "appeal": {"near": r"\b(?:curb|visual|aesthetic|appealing|appeals? to (?:me|people|them|voters))\b"},
        "penalty": {"near": r"\b(?:prepayment|early payment)\b"},
    },
)


def term_count(c: Column, term: str, exclusion: dict[str, str] | None = None) -> Column:
    """Occurrences of a term that no context rule cancels.

    ``near`` is looked for in 60 characters on both sides, ``after`` in the 25 that follow. One pass takes
    each match with its context: the context before a match is what follows the match before it.
    """
    if not exclusion:
        return fx.count_term(c, term)
    pattern = fx.term_pattern(term)
    pieces = F.split(F.regexp_replace(c, pattern, "\x00$0\x01"), "\x00")
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    plain = lambda x: F.replace(x, F.lit("\x01"), F.lit(""))

    def live(piece: Column, i: Column) -> Column:
        after = F.concat(F.substring_index(piece, "\x01", -1), plain(F.array_join(F.slice(rest, i + 2, F.size(rest)), "")))
        before = plain(F.array_join(F.slice(pieces, 1, i + 1), ""))
        keep = F.lit(True)
        if "near" in exclusion:
            around = F.concat(F.right(before, F.lit(60)), F.substring_index(piece, "\x01", 1), after.substr(1, 60))
            keep = keep & ~around.rlike(f"(?i){exclusion['near']}")
        if "after" in exclusion:
            keep = keep & ~after.substr(1, 25).rlike(f"(?i){exclusion['after']}")
        return keep

    return F.when(F.lower(c).contains(term.split()[0].lower()), F.size(F.filter(rest, live))).otherwise(0)


def counted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds ``hits``: one struct (category, term, n) for each term that occurs."""
    return docs.withColumn("hits", F.filter(F.array(*_counts(lexicon)), lambda h: h["n"] > 0))


def _counts(lexicon: Lexicon) -> list[Column]:
    return [
        F.struct(F.lit(category).alias("category"), F.lit(term).alias("term"), term_count(F.col("text"), term, lexicon.exclusions.get(term)).cast("long").alias("n"))
        for category, terms in lexicon.categories().items()
        for term in terms
    ]


def hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row for each document and term that occurs in it."""
    return docs.select("*", F.inline(F.array(*_counts(lexicon)))).where("n > 0")


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds score (weighted distinct terms) and flagged (score above the threshold, not at it)."""
    of = lambda category: F.size(F.filter("hits", lambda h: h["category"] == category))
    score = lexicon.deviation_weight * of("deviation") + lexicon.statutory_weight * of("statutory")
    return counted(docs, lexicon).withColumn("score", score).withColumn("flagged", F.col("score") > lexicon.threshold)


def rhetoric(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds a count for each mode, the share of objective among objective and subjective, and the dominant mode (ties in the lexicon's order)."""
    modes = list(lexicon.rhetoric)
    out = docs.withColumns({m: reduce(lambda a, b: a + b, [fx.count_term(F.col("text"), x) for x in terms]).cast("long") for m, terms in lexicon.rhetoric.items()})
    top = F.greatest(*modes)
    dominant = F.when(top == 0, "none")
    for m in modes:
        dominant = dominant.when(F.col(m) == top, m)
    both = F.col("objective") + F.col("subjective")
    return out.withColumns({"objectivity": F.when(both > 0, F.round(F.col("objective") / both, 6)), "dominant": dominant})


def distinct_words(docs: DataFrame) -> DataFrame:
    """doc_id, words: each word of a text once, without regard to case, in order and in its first spelling."""
    # A text is sorted by itself, in its row: nothing is shuffled.
    placed = F.sort_array(F.transform(F.split(fx.collapse(F.col("text")), " "), lambda w, k: F.struct(F.lower(w).alias("low"), k.alias("k"), w.alias("w"))))
    first = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["low"] != x["low"])))[0]
    words = F.array_join(F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["k"], x["w"]))), lambda x: x["w"]), " ")
    return docs.where("text is not null").select("doc_id", words.alias("words"))


def claims(docs: DataFrame, types: dict[str, str], negation: str) -> DataFrame:
    """Sentences with at least one assertion type. They deny only if every type found is negated.

    A type is negated when ``negation`` matches in the 40 characters before its first match.
    """
    s = docs.select("doc_id", F.posexplode(fx.sentences(F.col("text"))).alias("segment", "sentence"))
    at = {k: F.regexp_instr("sentence", F.lit(f"(?i){p}")) for k, p in types.items()}
    first = lambda a: F.greatest(a - 40, F.lit(1))
    negated = {k: F.col("sentence").substr(first(a), a - first(a)).rlike(negation) for k, a in at.items()}
    found = s.withColumns({k: a > 0 for k, a in at.items()}).where(reduce(lambda a, b: a | b, [F.col(k) for k in types]))
    denies = reduce(lambda a, b: a & b, [~F.col(k) | negated[k] for k in types])
    return found.withColumn("polarity", F.when(denies, "deny").otherwise("assert"))


def theme_scores(docs: DataFrame, keywords: list[tuple[str, str, int]]) -> DataFrame:
    """doc_id, theme, score: weight x min(n, 3), and the weight again from three occurrences; words match by beginning, phrases anywhere."""

    def n(kw: str) -> Column:
        return F.when(F.col("low").contains(kw), F.regexp_count("low", F.lit(kw if " " in kw else f"(?<![a-z0-9_]){kw}"))).otherwise(0)

    one = [F.struct(F.lit(theme).alias("theme"), F.lit(w).alias("w"), n(kw).alias("n")) for theme, kw, w in keywords]
    # Lower-cased once, by a generator that the optimizer does not copy into each count.
    low = docs.select("doc_id", F.explode(F.array(F.lower("text"))).alias("low"))
    found = low.select("doc_id", F.inline(F.array(*one))).where("n > 0")
    score = F.col("w") * F.least("n", F.lit(3)) + F.when(F.col("n") >= 3, F.col("w")).otherwise(0)
    return found.groupBy("doc_id", "theme").agg(F.sum(score).alias("score"))


def primary_theme(docs: DataFrame, keywords: list[tuple[str, str, int]]) -> DataFrame:
    """The best theme (``general`` if none) and at most two more that reach max(2, 0.45 of the best)."""
    by = W.partitionBy("doc_id")
    r = theme_scores(docs, keywords).withColumns({"k": F.row_number().over(by.orderBy(F.desc("score"), "theme")), "top": F.max("score").over(by)})
    second = F.col("k").between(2, 3) & (F.col("score") >= F.greatest(F.lit(2.0), 0.45 * F.col("top")))
    best = r.groupBy("doc_id").agg(
        F.max(F.when(F.col("k") == 1, F.col("theme"))).alias("primary_theme"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(second, F.struct("k", "theme")))), lambda x: x["theme"]), ",").alias("secondary"),
    )
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("primary_theme", F.lit("general")).alias("primary_theme"), F.coalesce("secondary", F.lit("")).alias("secondary"))


def search(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that hold all terms; 6 for a text that starts with a term, 3 at the start of a word, else 1 each."""
    low = F.lower("text")
    one = [F.when(low.startswith(q), 6).when(low.rlike(f"[ \n]{q}"), 3).otherwise(1) for q in terms]
    return docs.where(reduce(lambda a, b: a & b, [low.contains(q) for q in terms])).select("doc_id", reduce(lambda a, b: a + b, one).cast("long").alias("score"))


def entities(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, kind, value, n of everything that a kind's pattern matches."""
    found = [F.transform(F.regexp_extract_all("text", F.lit(p), 0), _tag(kind)) for kind, p in patterns.items()]
    return docs.select("doc_id", F.inline(F.concat(*found))).groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def _tag(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


# Words that are no names behind a title, and how statutes and instruments are cited.
NO_NAMES = [
    "The", "And", "But", "So", "If", "We", "I", "It", "This", "That", "Thank", "Thanks", "Yes", "No", "Okay", "All", "Second", "Motion", "Mayor", "President", "Chair", "Council",
    "City", "Madam", "Madame", "Sir", "Please", "Any", "Are", "Is", "Do", "Can", "Would", "Members", "Member", "Clerk", "Director", "Chief", "Chairman", "Chairwoman", "Mr", "Mrs",
    "Ms", "Dr", "Vice", "Commissioner", "Councilman", "Councilwoman", "Attorney", "Sheriff",
]
STATUTE = r"(?i)(?:\bW\.?\s?S\.?|Wyo(?:ming)?\.?\s+Stat(?:\.|ute)?s?|§)\s*(?:section\s+|sec\.\s*)?§?\s*(\d{1,2}-\d{1,2}-\d{2,4}(?:\([a-z0-9]+\))*)"
INSTRUMENT = r"(?i)\b(Ordinance|Resolution|Council Bill|Bill)\s+(?:No\.?|Number|#)?\s*(\d{1,2}-\d{2,5}|\d{2,5})\b"


def named_entities(c: Column, titles: list[str], agencies: dict[str, str]) -> Column:
    """officials, agencies, statutes and instruments that a text names, each once and in order.

    An official is a title of ``titles`` and one or two capitalised words behind it, a second one only if it is a name. ``agencies`` are patterns by
    name, taken as they are written. A statute is given as "W.S." and its number, an instrument as its kind and number.
    """
    word = r"[A-Z][a-zA-Z'\-]{1,}"
    title = "|".join(re.escape(t) for t in sorted(titles, key=lambda t: (-len(t), t)))
    official = rf"({title})\s+({word})(?:\s+({word}))?"

    def person(m: Column) -> Column:
        first, second = F.regexp_extract(m, official, 2), F.regexp_extract(m, official, 3)
        full = F.concat_ws(" ", F.regexp_extract(m, official, 1), first, F.when((second != "") & ~second.isin(*NO_NAMES), second))
        return F.when(~first.isin(*NO_NAMES), full)

    text = F.coalesce(c, F.lit(""))
    people = F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![\w.]){official}"), 0), person)
    acts = F.transform(F.regexp_extract_all(text, F.lit(INSTRUMENT), 0), lambda m: F.concat_ws(" ", F.initcap(F.regexp_extract(m, INSTRUMENT, 1)), F.regexp_extract(m, INSTRUMENT, 2)))
    bodies = F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in agencies.items()]) if agencies else F.array().cast("array<string>")
    return F.struct(
        F.array_distinct(F.array_compact(people)).alias("officials"), F.array_compact(bodies).alias("agencies"),
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(STATUTE), 1), lambda n: F.concat(F.lit("W.S. "), n))).alias("statutes"), F.array_distinct(acts).alias("instruments"),
    )

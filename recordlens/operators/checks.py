"""Checks of independent records against each other; each adds an ``exception``."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .names import with_ratio
from .similarity import best_match, candidates, most_shared, ordered, similar
from .timeline import within


def postponements(postponed: DataFrame, agenda: DataFrame, meetings: DataFrame, days: int = 60, least: float = 0.5) -> DataFrame:
    """R1: what became of items postponed to a day: honored, reappeared later, no meeting that day, not found, or the day lies outside the record.

    ``postponed`` (id, to, tokens), ``agenda`` (date, tokens), ``meetings`` (date); dates are dates.
    """
    x, y = ordered(postponed.select("id", "to", "tokens"), agenda.select(F.monotonically_increasing_id().alias("id"), "date", "tokens"))
    near = (F.col("date") >= F.col("to")) & (F.col("date") <= F.date_add("to", days))
    pairs = candidates(x.withColumn("t", F.lit(least)), y, least, near)
    found = similar(pairs, x, y, least, ["date"]).groupBy(F.col("left_id").alias("id")).agg(F.min("date").alias("found"))
    last = meetings.agg(F.max("date").alias("last"))
    held = meetings.select(F.col("date").alias("to")).distinct().withColumn("held", F.lit(True))
    j = postponed.select("id", "to").join(found, "id", "left").join(held, "to", "left").crossJoin(F.broadcast(last))  # one row
    status = F.when(F.col("found") == F.col("to"), "honored").when(F.col("to") > F.col("last"), "target not in record").when(F.col("found").isNotNull(), "reappeared later").when(F.col("held").isNull(), "no meeting").otherwise("not found")
    return j.select("id", "to", status.alias("status"), status.isin("no meeting", "not found").alias("exception"))


def coverage(agenda: DataFrame, minutes: DataFrame, least: float = 0.34, within: float = 0.6, chars: int = 400) -> DataFrame:
    """R3: agenda items (id, meeting, tokens) that no entry (id, ord, meeting, tokens, raw, chars) of their meeting's minutes covers.

    An entry covers an item by a title of similarity ``least``, or if its whole text (``raw`` tokens) has a share ``within`` of the item's
    tokens. Meetings without minutes, or with less than ``chars`` characters of them, are not judged. Returns left_id, meeting, similarity, share, exception.
    """
    held = minutes.groupBy("meeting").agg(F.sum("chars").alias("chars")).where(F.col("chars") >= chars).select("meeting")
    items = agenda.join(held, "meeting")
    # Tokens of other meetings are other tokens.
    named = lambda df: df.where("meeting is not null").withColumn("meeting", F.col("meeting").cast("string"))
    of = lambda c: F.transform(c, lambda t: F.xxhash64("meeting", t)).alias(c)
    most = most_shared(named(items).select("id", of("tokens")), named(minutes).select(of("tokens"), of("raw")))
    enough = lambda c, bound: F.when(F.round(c, 6) >= bound, F.round(c, 6)).alias(c)
    most = most.select("left_id", enough("similarity", least), enough("share", within))
    out = items.select(F.col("id").alias("left_id"), "meeting").join(most, "left_id", "left")
    return out.withColumn("exception", F.col("similarity").isNull() & F.col("share").isNull())


def roster_heard(listed: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Adds heard to the distinct ``listed`` names: whether ``words`` have them. Each task sends a name that it hears once."""
    heard = words.select(*keys).distinct().withColumn("_heard", F.lit(True))
    return listed.join(heard, keys, "left").withColumn("heard", F.coalesce("_heard", F.lit(False))).drop("_heard")


def commenters_in_window(items: DataFrame, segments: DataFrame, entries: DataFrame, apart: int = 4, least: float = 0.3, width_seconds: int = 3600) -> DataFrame:
    """R5: the public commenters that the minutes list for an item against the speakers who introduce themselves while it is dealt with.

    ``items`` (doc, item, start, end, tokens, listed: names), ``segments`` (doc, ts, text, intro: whether a speaker introduces themselves) and
    ``entries`` (doc, ord, tokens, listed), the minutes. Segments meet items by time, in buckets of ``width_seconds``. A listed name is heard if its surname, of
    more than three letters, is part of a segment of the item. Comments that an item lacks may be listed under a related one: the entry of the
    document with commenters whose title is most similar, ``least`` at least. Items without names and speakers are left out.
    """
    surname = lambda name: F.lower(F.element_at(F.regexp_extract_all(F.concat(F.lit("a "), F.split_part(name, F.lit(","), F.lit(1))), F.lit("[A-Za-z']+"), 0), -1))
    said = within(segments, items.select("doc", "item", "start", "end"), ["doc"], "ts", "start", "end", width_seconds).select("doc", "item", F.lower("text").alias("text"), "intro")
    starts = said.groupBy("doc", "item").agg(F.count_if("intro").alias("introduced"))
    named = items.select("doc", "item", F.posexplode("listed").alias("k", "name")).withColumn("surname", surname(F.col("name"))).where(F.length("surname") > 3)
    heard = said.join(named, ["doc", "item"]).where(F.contains("text", F.col("surname"))).select("doc", "item", "k").distinct().groupBy("doc", "item").agg(F.count(F.lit(1)).alias("heard"))
    j = items.select("doc", "item", F.size("listed").alias("listed")).join(starts, ["doc", "item"], "left").join(heard, ["doc", "item"], "left").na.fill(0, ["introduced", "heard"])
    j = j.where("listed > 0 or introduced > 0")
    of = lambda: F.transform("tokens", lambda t: F.concat_ws("\x1f", F.col("doc").cast("string"), t)).alias("tokens")
    lonely = items.join(j.where("listed = 0").select("doc", "item"), ["doc", "item"]).select(F.struct("doc", "item").alias("id"), of())
    related = best_match(lonely, entries.where(F.size("listed") > 0).select(F.col("ord").alias("id"), "ord", of()), least, "ord")
    j = j.join(related.select("left_id.doc", "left_id.item", F.col("right_id").alias("related")), ["doc", "item"], "left")
    exception = ((F.col("listed") >= 2) & (F.col("introduced") == 0)) | ((F.col("listed") == 0) & (F.col("introduced") >= 2)) | (F.abs(F.col("listed") - F.col("introduced")) >= apart)
    return j.withColumn("exception", exception & F.col("related").isNull())


def attendance(roll: DataFrame, spoken: DataFrame) -> DataFrame:
    """R6: the recorded roll (doc, present) against the members heard in the roll call (doc, heard)."""
    j = roll.join(spoken, "doc", "left").withColumn("heard", F.coalesce("heard", F.expr("cast(array() as array<string>)")))
    j = j.withColumns({"only_recorded": F.array_except("present", "heard"), "only_heard": F.array_except("heard", "present")})
    return j.withColumn("exception", (F.size("heard") > 0) & ((F.size("only_recorded") > 0) | (F.size("only_heard") > 0)))


def grounded_citations(spoken: DataFrame, official: DataFrame) -> DataFrame:
    """R7: spoken citations (doc, ord, role, citation) against official ones (doc, citation), the first of each citation and role.

    A citation has title, chapter and section: 16-4-405. It is grounded exactly, or closely: by an official one of the same title and chapter
    whose section begins with the spoken one, differs by zeros only, or has a matching-blocks ratio of 0.75 or more. Of close ones the first
    kind counts, then the smallest. What sections are near each other does not depend on documents: it is found once for the distinct sections
    (of two to four digits, 11,100 at most), in order of preference, and the first of them that the document's chapter has is the official one.
    """

    def parts(d: DataFrame) -> DataFrame:
        """Sections as numbers: a one before the digits keeps zeros in front."""
        p = F.col("p")
        chapter, code = F.when(p != "", F.substring_index(p, "-", 2)), F.when(p != "", F.concat(F.lit("1"), F.substring_index(p, "-", -1)).cast("int"))
        return d.withColumn("p", F.regexp_extract("citation", r"(\d{1,2}-\d{1,2}-\d{2,4})", 1)).withColumns({"chapter": chapter, "code": code}).drop("p")

    # Both sides are dealt out by document and chapter once; what follows stays in its task.
    spoken, official = parts(spoken.select("doc", "ord", "role", "citation")), parts(official.select("doc", "citation")).where("chapter is not null")
    first = spoken.repartition("doc", "chapter").groupBy("doc", "chapter", "code", "citation", "role").agg(F.min("ord").alias("ord"))
    known = official.repartition("doc", "chapter").groupBy("doc", "chapter").agg(F.collect_set("code").alias("known"))
    digits = lambda d, name: d.where("chapter is not null").select(F.substring(F.col("code").cast("string"), 2, 4).alias(name)).distinct()
    near = near_sections(digits(spoken, "section"), digits(official, "other"))
    near = near.select(F.concat(F.lit("1"), "section").cast("int").alias("code"), F.transform("others", lambda o: F.concat(F.lit("1"), o).cast("int")).alias("near"))
    j = first.join(known, ["doc", "chapter"], "left").join(F.broadcast(near), "code", "left")
    j = j.withColumn("best", F.when(F.col("ord").isNotNull() & F.col("role").isNotNull(), F.get(F.array_intersect("near", "known"), F.lit(0))))
    status = F.when(F.col("best") == F.col("code"), "exact").when(F.col("best").isNotNull(), "close").otherwise("ungrounded")
    grounded = F.when(F.col("best").isNotNull(), F.concat_ws("-", "chapter", F.substring(F.col("best").cast("string"), 2, 4)))
    return j.select("doc", "ord", "role", "citation", status.alias("status"), grounded.alias("official"), F.col("best").isNull().alias("exception"))


def near_sections(spoken: DataFrame, official: DataFrame) -> DataFrame:
    """(section, others): the official sections (other) that ground a spoken one (section), itself first, then by kind and digits.

    Sections have two to four digits, so a ratio of 0.75 needs them to be equal but for one digit more, less or other (two digits and two: to be
    equal): each section is joined by itself with one digit left out.
    """

    def keys(c: Column, heads: Column | None = None) -> Column:
        """What sections meet by: themselves, without zeros, without one digit; the official ones also by their beginnings."""
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.lit("d"), F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.array_distinct(F.concat(F.array(F.concat(F.lit("h"), c), F.concat(F.lit("z"), F.replace(c, F.lit("0"))), F.concat(F.lit("d"), c)), cut, heads if heads is not None else F.array().cast("array<string>")))

    heads = F.transform(F.sequence(F.lit(2), F.length("other")), lambda n: F.concat(F.lit("h"), F.substring("other", F.lit(1), n)))
    x = spoken.withColumn("key", F.explode(keys(F.col("section"))))
    y = official.withColumn("key", F.explode(keys(F.col("other"), heads)))
    m, n = F.length("section"), F.length("other")
    by_digits = F.col("key").startswith("d") & (F.least(m, n) >= 2) & (m + n >= F.when(m == n, 8).otherwise(5)) & (F.abs(m - n) <= 1)
    rank = F.when(F.col("other") == F.col("section"), 0).when(F.col("other").startswith(F.col("section")), 1).when(F.replace("other", F.lit("0")) == F.replace("section", F.lit("0")), 2).when(by_digits, 3)
    pairs = x.join(y, "key").withColumn("rank", rank).where("rank is not null").select("section", "other", "rank").distinct()
    # The ratio takes the longest block first, so it may be less than what two sections have in common.
    by_ratio = with_ratio(pairs.where("rank = 3").select("section", "other", "rank", F.col("section").alias("x"), F.col("other").alias("y"))).where("ratio >= 0.75").drop("x", "y", "ratio")
    near = pairs.where("rank < 3").unionByName(by_ratio)
    return near.groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda p: p["other"]).alias("others"))


# The statute on closed sessions, and the wordings (parted by bars) of its purposes by subsection.
CLOSED_STATUTE = ["16", "4", "405"]
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii"]
PURPOSES = {
    1: r"threat to the security|right of access", 2: r"appointment, employment|dismissal of a public officer|personnel", 3: r"litigation",
    7: r"selection of a site|purchase of real estate|real estate", 8: r"gifts, donations", 9: r"classified as confidential by law",
    10: r"wages|salaries|terms of employment", 12: r"security planning",
}


def closed_basis(text: Column, spoken: bool = False) -> Column:
    """numbers, bare and purposes of a text on a closed session.

    What follows each mention of the statute is looked at by itself: an "a", bracketed or not, and then the subsection, in arabic or, in written
    texts, roman digits. ``numbers`` are the subsections, sorted; ``bare`` says that a mention has none; ``purposes`` are those named by
    their wording. Of captions, notes in brackets and signs of speakers go first; there the statute's numbers may run together.
    """
    return _basis(_said(text, spoken), _mentions(_said(text, spoken), spoken), spoken)


def _said(text: Column, spoken: bool) -> Column:
    said = F.coalesce(F.regexp_replace(text, r"\[[^\]]*\]|>>", " ") if spoken else text, F.lit(""))
    return F.lower(F.regexp_replace(said, r"\s+", " "))


def _mentions(said: Column, spoken: bool) -> Column:
    """The subsection behind each mention of the statute, empty if it has none; a next mention is no subsection."""
    statute = rf"\b{(' ?-? ?' if spoken else ' ?- ?').join(CLOSED_STATUTE)}"
    digits = r"\d+" if spoken else r"\d+|[ivx]+"
    return F.regexp_extract_all(said, F.lit(rf"{statute}(?=[ (]*a[ )(]*(?!{statute})({digits})(?![a-z]))?"), 1)


def _basis(said: Column, found: Column, spoken: bool) -> Column:
    roman = F.create_map(*[x for k, v in enumerate(ROMAN, 1) for x in (F.lit(v), F.lit(k))])
    value = F.transform(found, lambda v: v.try_cast("int") if spoken else F.coalesce(F.try_element_at(roman, v), v.try_cast("int")))
    real = F.filter(value, lambda n: n.between(1, len(ROMAN)) if spoken else n > 0)
    names = lambda p: reduce(lambda x, y: x | y, [F.contains(said, F.lit(w)) for w in p.split("|")])
    purposes = F.array_compact(F.array(*[F.when(names(p), F.lit(k)) for k, p in PURPOSES.items()]))
    return F.struct(F.array_sort(F.array_distinct(real)).alias("numbers"), F.array_contains(found, "").alias("bare"), purposes.alias("purposes"))


def sessions_of(texts: DataFrame) -> DataFrame:
    """R8 from texts (doc, agenda, minutes, speech): ``session_basis`` of what they cite, with what speech cites without a subsection, and its purposes."""
    kinds = {"agenda": False, "minutes": False, "speech": True}
    # One step a projection: what later steps use more than once is not worked out again within them.
    t = texts.select("doc", *[_said(F.col(c), spoken).alias(c) for c, spoken in kinds.items()])
    t = t.withColumns({f"_{c}": _mentions(F.col(c), spoken) for c, spoken in kinds.items()})
    basis = lambda c: _basis(F.col(c), F.col(f"_{c}"), kinds[c])
    numbers = t.select("doc", basis("agenda")["numbers"].alias("agenda"), basis("minutes")["numbers"].alias("minutes"), basis("speech")["numbers"].alias("speech"), basis("speech")["bare"].alias("cited_without_subsection"), basis("speech")["purposes"].alias("purposes"))
    return session_basis(numbers)


def session_basis(rows: DataFrame) -> DataFrame:
    """R8: the legal basis of closed sessions (doc, agenda, minutes, speech: cited subsections): whether all that cite one agree."""
    cited = F.transform(F.filter(F.array("agenda", "minutes", "speech"), lambda a: F.size(a) > 0), lambda a: F.array_sort(F.array_distinct(a)))
    n = F.size("_cited")
    notes = F.array_compact(
        F.array(
            F.when(n == 0, F.lit("no basis cited")),
            F.when(F.size("agenda") == 0, F.lit("none on the agenda")),
            F.when(F.size("minutes") == 0, F.lit("none in the minutes")),
            F.when((n > 1) & ~F.col("_alike"), F.lit("bases differ")),
        )
    )
    # Steps of their own again: every row's lists are compared once.
    judged = rows.withColumn("_cited", cited).withColumn("_alike", F.size(F.array_distinct("_cited")) <= 1)
    return judged.withColumns({"consistent": (n > 0) & F.col("_alike"), "notes": notes, "exception": (n == 0) | ~F.col("_alike")}).drop("_cited", "_alike")


def lifecycle(readings: DataFrame, stale_days: int = 120) -> DataFrame:
    """R2: groups of readings (grp, date, reading, result, number, substitute): span, adopted, and flags."""
    as_of = readings.agg(F.max("date").alias("as_of"))
    g = readings.groupBy("grp").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.min("reading").alias("lowest"), F.max("reading").alias("highest"), F.countDistinct("reading").alias("distinct_readings"),
        F.count_if(F.col("result") == "postponed").alias("postponements"), F.bool_or((F.col("reading") == 3) & F.col("substitute")).alias("late_substitute"), F.bool_or(F.col("result") == "failed").alias("failed"),
        F.bool_or((F.col("reading") == 3) & (F.col("result") == "carried")).alias("adopted"), F.max("number").alias("number"),
    ).crossJoin(F.broadcast(as_of))
    flag = lambda c, name: F.when(c, F.lit(name))
    pending = ~F.col("adopted") & ~F.col("failed") & (F.datediff("as_of", "last") > stale_days)
    flags = F.array(flag(F.col("distinct_readings") < F.col("highest"), "missing predecessor"), flag(F.col("postponements") >= 2, "postponed repeatedly"), flag(F.col("late_substitute"), "substitute at third reading"), flag(F.col("failed"), "failed"), flag(pending, "pending"))
    g = g.withColumns({"days": F.datediff("last", "first"), "flags": F.filter(flags, lambda x: x.isNotNull())})
    return g.withColumn("exception", F.size("flags") > 0).drop("as_of", "lowest", "distinct_readings")

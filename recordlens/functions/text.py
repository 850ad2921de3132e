"""Column functions on text: terms, snippets, ids, clocks, tokens, redaction."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script, inside a character class.
WORD = r"\p{L}\p{N}_"
#: What SQL's patterns take as white space: ``\s`` of Java has the vertical tab besides.
SPACE = r"[\t\n\f\r ]"
#: Where a word begins and ends beside ASCII letters, digits and underscores only, as SQL's patterns have them: ``\b`` of Java knows letters of any script.
BEGIN, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def term_pattern(term: str) -> str:
    """Java pattern of a whole word or phrase: any white space between words, an optional plural.

    Case counts only for terms of more than one letter that are all capitals; those (acronyms) have no plural.
    """
    body = r"\s+".join(re.escape(w) for w in term.split())
    plural = "(?:s|es)?" if term[-1].isalpha() and not case_sensitive(term) else ""
    return f"{'' if case_sensitive(term) else '(?i)'}(?<![{WORD}]){body}{plural}(?![{WORD}])"


def case_sensitive(term: str) -> bool:
    return len(term) > 1 and term.isupper()


def count_term(c: Column, term: str) -> Column:
    """Occurrences of a term; a plain substring test comes first because most texts fail it."""
    word = term.split()[0]
    near = c.contains(word) if case_sensitive(term) else F.lower(c).contains(word.lower())
    return F.when(near, F.regexp_count(c, F.lit(term_pattern(term)))).otherwise(0)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def snippet(c: Column, pattern: str, radius: int = 90) -> Column:
    """The first match with ``radius`` characters on both sides, white space collapsed; null without a match."""
    at = F.regexp_instr(c, F.lit(pattern))
    end = at + F.length(F.regexp_extract(c, pattern, 0)) - 1
    first, last = F.greatest(at - radius, F.lit(1)), F.least(end + radius, F.length(c))
    text = collapse(c.substr(first, last - first + 1))
    return F.when(at > 0, F.concat(F.when(first > 1, "…").otherwise(""), text, F.when(last < F.length(c), "…").otherwise("")))


def distinct_ci(words: Column) -> Column:
    """Elements whose lower-case form has not occurred before, in order, in their first spelling."""
    lowered = F.transform(words, F.lower)
    return F.filter(words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1)


def record_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts, joined by a unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def to_clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def from_clock(clock: Column) -> Column:
    p = F.split(clock, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def tokens(c: Column, least: int) -> Column:
    """Lower-case ASCII words of at least ``least`` letters and digits."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) >= least)


def token_set(c: Column, stop: list[str], least: int = 4) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens(c, least), lambda w: ~w.isin(stop))))


def token_list(c: Column, stop: list[str], least: int = 3) -> Column:
    return F.filter(tokens(c, least), lambda w: ~w.isin(stop))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(c: Column, least: int = 13) -> Column:
    """Sentences end after . ? ! and white space, and at >>; short ones go."""
    return F.filter(F.transform(F.split(c, r"(?<=[.?!])\s+|>>"), collapse), lambda s: F.length(s) >= least)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"


def redact(c: Column) -> Column:
    """E-mail addresses, social security numbers and phone numbers."""
    for pattern, name in ((EMAIL, "[email]"), (SSN, "[ssn]"), (PHONE, "[phone]")):
        c = F.regexp_replace(c, pattern, name)
    return c


# How people of the public introduce themselves, and what stands for them.
INTRODUCTIONS = [r"(?i)\b(?:my name is|this is|name's)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z']+){0,2}", r"(?<=record, )[A-Z][a-z]+(?: [A-Z][a-z']+){1,2}"]
SOMEONE = "[member of the public]"


def redact_people(c: Column, names: list[str], keep: set[str] = frozenset()) -> Column:
    """Members of the public: full ``names`` of two words and more, their surnames behind a title, and whoever introduces themselves.

    Longer names go first. Names whose surname is one to ``keep`` (an official's) stay.
    """
    public = [n for n in sorted(set(names), key=lambda n: (-len(n), n)) if len(n.split()) >= 2 and n.split()[-1] not in keep]
    patterns = [p for n in public for p in (re.escape(n), rf"(?:Mr|Ms|Mrs|Miss|Dr)\.? {re.escape(n.split()[-1])}")]
    for pattern in [*([rf"\b(?:{'|'.join(patterns)})\b"] if patterns else []), *INTRODUCTIONS]:
        c = F.regexp_replace(c, pattern, SOMEONE)
    return c


SECRET_KEYS = "token|key|apikey|api_key|access_token|auth|password|secret|signature|sig"


def redact_url(c: Column, keys: str = SECRET_KEYS) -> Column:
    """Values of secret query keys and user info in URLs."""
    c = F.regexp_replace(c, r"(https?://)[^/@\s]+@", "$1")
    return F.regexp_replace(c, rf"(?i)([?&](?:{keys})=)[^&#\s]+", "$1[redacted]")


def excerpt(c: Column, limit: int) -> Column:
    """Cut after the last whole word within ``limit`` characters, with an ellipsis."""
    flat = collapse(c)
    cut = F.regexp_extract(flat.substr(1, limit), r"^(.*)\s\S*$", 1)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.when(cut == "", flat.substr(1, limit)).otherwise(cut), F.lit("…")))


def slug(c: Column, limit: int = 60) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-").substr(1, limit), "^-+|-+$", "")


def highlight(c: Column, terms: list[str]) -> Column:
    longest_first = sorted(terms, key=lambda t: (-len(t), t))
    return F.regexp_replace(c, f"(?i)({'|'.join(map(re.escape, longest_first))})", "<mark>$1</mark>")


def relative_age(seconds: Column) -> Column:
    """today, yesterday, n days ago, n mo ago, n.n yr ago from an age in seconds, to the nearest day; empty without an age."""
    days = F.floor(seconds / 86400 + 0.5)
    return (
        F.when(days.isNull(), "")
        .when(days <= 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 30, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 365, F.concat(F.floor(days / 30 + 0.5).cast("string"), F.lit(" mo ago")))
        .otherwise(F.concat((F.floor(days / 365 * 10 + 0.5) / 10).cast("decimal(10,1)").cast("string"), F.lit(" yr ago")))
    )


def byte_label(n: Column) -> Column:
    """A number of bytes in the largest unit that it fills, with one decimal below ten of a unit; 0 without bytes."""
    out = F.when(F.coalesce(n, F.lit(0)) == 0, "0").when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        x = n / F.lit(float(1024**k))
        label = F.when(x < 10, (F.floor(x * 10 + 0.5) / 10).cast("decimal(20,1)").cast("string")).otherwise(F.floor(x + 0.5).cast("string"))
        out = out.when((x < 1024) | F.lit(unit == "TB"), F.concat(label, F.lit(f" {unit}")))
    return out


#: Month names by their first three letters.
_MONTHS = {m: k for k, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"], 1)}


def first_date(c: Column) -> Column:
    """The first of four written forms that names a real day: 2026-02-03, January 13, 2026, 1/13/2026, -20260113-.

    Of each form the first place counts that has a month and a day of the calendar. The text is cut into runs of letters, of digits and of
    what parts them, and a form is three numbers in their order; a number belongs to no longer word.
    """
    text = F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))
    month, day, year = r"(1[0-2]|0?[1-9])", r"(3[01]|[12]\d|0?[1-9])", r"(20\d\d)"
    apart = lambda *parts: r"(?<!\w)" + "".join(parts) + r"(?!\w)"
    word = "(?i:" + "|".join(sorted((m + rest for m, rest in zip(_MONTHS, ("(?:uary)?", "(?:ruary)?", "(?:ch)?", "(?:il)?", "", "(?:e)?", "(?:y)?", "(?:ust)?", "(?:t(?:ember)?|ember)?", "(?:ober)?", "(?:ember)?", "(?:ember)?"), strict=True)))) + ")"
    forms = [
        (apart(year, "[-_/]", month, "[-_/]", day), (1, 2, 3)),
        (apart(f"({word})", r"\.?\s+", r"(3[01]|[12]?\d)", "(?i:st|nd|rd|th)?", r",?\s+", year), (3, 1, 2)),
        (apart(month, "[-/.]", day, "[-/.]", year), (3, 1, 2)),
        (r"(?:^ |[-_])" + year + r"(1[0-2]|0[1-9])(3[01]|[12]\d|0[1-9])(?: $|[-_.])", (1, 2, 3)),
    ]
    names = F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])

    def made(pattern: str, places: tuple) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, k) for k in places)
        number = F.coalesce(F.try_element_at(names, F.lower(F.substring(m, 1, 3))), m.try_cast("int"))
        # A day that the month lacks gives null.
        return F.date_format(F.try_to_timestamp(F.format_string("%s-%02d-%02d", y, number, d.try_cast("int")), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")

    return F.coalesce(*[made(*form) for form in forms])


# Fixed value: what stands before a title on an agenda, its reading included.
TITLE_PREFIX = r"(?i)^\s*(?:\[CA\]\s*)?(?:ORDINANCE|RESOLUTION)\s*[-–]\s*(?:\d(?:st|nd|rd|th)\s+READING\s*[-–]\s*)?"


def title_key(c: Column, least: int = 4) -> Column:
    """Distinct tokens of a title without its kind and reading: a title is the same at every reading."""
    return F.array_distinct(tokens(F.regexp_replace(c, TITLE_PREFIX, ""), least))

"""Mixing sources to target weights by iterative proportional fitting (operator 9), native only.

Documents are counted into cells (source, language, topic). Raking scales the cells' token weights
to each marginal in turn until all marginals hold, with no cell asked for more than it has; a document
is then kept with its cell's calibrated probability, decided by a hash of its id and text, so a rerun
decides alike. The expected sample has the targets' shares; where no weights meet all targets (cells
that do not exist), it has those of the nearest fit.

Null source or language form the category ``unknown``; null text has no words. Categories without a
target share the weight that the named ones leave, in proportion to their tokens. Repeated rows are
decided alike. Extra columns are carried. An empty table gives an empty result; very long texts count all their words.
"""

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .staging import packed, staged

#: A source's share may not exceed this many equal shares.
SOURCE_CAP = 2.0
LANGUAGE = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}
TOPIC = {"prose": 0.90, "tabular": 0.04, "noisy": 0.06}
#: Expected share of all tokens that is kept, at most: less where the targets ask for more of a category than there is.
KEEP = 0.8
ROUNDS, ROUNDS_AT_ONCE, TOLERANCE = 24, 4, 1e-6


def _count(text: Column, mark: str) -> Column:
    """Occurrences of a single character in a short text."""
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def n_words(text: Column) -> Column:
    """Words [^ \\t-\\r]+: each becomes one letter, together with the white space behind it."""
    t = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(t, r"[^ \t-\r]++[ \t-\r]*+", "a")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's own form: tabular, noisy or prose."""
    t = F.coalesce(text, F.lit(""))
    marks = F.regexp_replace(t, r"[^|!%$&*#]++", "")
    bars = _count(marks, "|")
    return F.when(bars * 40 >= F.length(t), F.when(bars > 0, "tabular").otherwise("prose")).when((F.length(marks) - bars) * 40 >= F.length(t), "noisy").otherwise("prose")


def targets(cells: DataFrame, column: str, wanted: dict[str, float] | None, cap: float = SOURCE_CAP) -> DataFrame:
    """(column, target) with targets that add up to 1 over the categories that have tokens.

    With ``wanted``, those shares, and the rest in proportion to tokens; without, the tokens' own
    shares, none above ``cap`` equal shares.
    """
    sums = cells.groupBy(column).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    whole = W.partitionBy()
    if wanted is None:
        raw = F.least(F.col("t") / F.sum("t").over(whole), F.lit(cap) / F.count(F.lit(1)).over(whole))
    else:
        named = F.lit(None).cast("double")
        for k, v in wanted.items():
            named = F.when(F.col(column) == k, v).otherwise(named)
        rest = F.greatest(F.lit(1.0 - sum(wanted.values())), F.lit(0.01))
        raw = F.coalesce(named, rest * F.col("t") / F.sum(F.when(named.isNull(), F.col("t"))).over(whole))
    return sums.withColumn("raw", raw).select(column, (F.col("raw") / F.sum("raw").over(whole)).alias(f"target_{column}"))


def fit(cells: DataFrame, margins: list[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE, keep: float | None = None) -> tuple[DataFrame, float, float]:
    """``rake``, with ``keep`` under the bound weight * keep <= the cell's share of all tokens; also the largest error of a margin and the largest weight relative to the share.

    Only what is below its bound is scaled further, so cells at the bound pass what they cannot take to the others.
    """
    bounded = F.col("_free") if keep is None else F.least("_free", F.col("_share") / keep)
    w = cells.withColumn("_share", F.col("tokens") / F.sum("tokens").over(W.partitionBy())).withColumn("_free", F.col("_share"))
    errors = [F.max(F.abs(F.col(f"s_{m}") - F.col(f"target_{m}"))) for m in margins]
    done, error, most = 0, 0.0, 0.0
    while done < rounds:
        for _ in range(ROUNDS_AT_ONCE):
            for m in margins:
                w = w.withColumn("_free", F.when(F.col("tokens") > 0, F.col("_free") * F.col(f"target_{m}") / F.sum(bounded).over(W.partitionBy(m))).otherwise(0.0))
        w, done = staged(w, "raked"), done + ROUNDS_AT_ONCE
        sums = w.withColumns({f"s_{m}": F.sum(bounded).over(W.partitionBy(m)) for m in margins})
        error, most = (x or 0.0 for x in sums.agg(F.greatest(*errors, F.lit(0.0)), F.max(F.when(F.col("tokens") > 0, bounded / F.col("_share")))).first())
        if error <= tolerance:
            break
    if error > tolerance:
        logging.getLogger(__name__).warning("raking ended after %d rounds with margins off by up to %.2g", done, error)
    return w.withColumn("weight", bounded).drop("_free", "_share"), error, most


def rake(cells: DataFrame, margins: list[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``weight`` to cells that have ``tokens`` and ``target_<margin>`` columns: weights add up to 1 and to each target."""
    return fit(cells, margins, rounds, tolerance)[0]


def rake_to_keep(cells: DataFrame, margins: list[str], keep: float) -> tuple[DataFrame, float]:
    """Raked cells, and the share of all tokens that can be kept with them, ``keep`` at most: no cell has to be kept more than whole.

    Where the plain fit asks for more than a cell has, the fit is repeated under that bound, for as much as the scarcest
    category allows and then for less; where none of these meets the targets, the plain fit is scaled down as a whole.
    """
    w, error, most = fit(cells, margins)
    share = min(keep, 1 / most) if most else keep
    if share < keep and error <= TOLERANCE:
        room = [F.min(F.when(F.col(f"target_{m}") > 0, F.col(f"s_{m}") / F.col(f"target_{m}"))) for m in margins]
        sums = cells.withColumns({f"s_{m}": F.sum("tokens").over(W.partitionBy(m)) / F.sum("tokens").over(W.partitionBy()) for m in margins})
        top = min(keep, sums.agg(F.least(*room)).first()[0])
        for k in (top, (top * share) ** 0.5):
            bounded, error, _ = fit(cells, margins, keep=k)
            if k > share and error <= TOLERANCE:
                return bounded, k
    return w, share


def mix(docs: DataFrame, language: dict[str, float] | None = None, topic: dict[str, float] | None = None, keep: float = KEEP) -> DataFrame:
    """row (all columns of ``docs``), doc_id, source, lang, n_words, topic, weight (of one of the cell's tokens, relative to the input), probability and sampled."""
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = packed(docs, "doc_id", "source", "lang", "text").withColumns(
        {"_source": F.coalesce("source", F.lit("unknown")), "_lang": F.coalesce("lang", F.lit("unknown")), "_topic": topic_of(F.col("text")), "_words": n_words(F.col("text")), "_u": u}
    )
    # Texts are gone through once: counting and sampling both read what is staged here, and only the columns they need.
    rows = staged(rows.drop("text"), "measured")
    margins = ["_source", "_lang", "_topic"]
    cells = staged(rows.groupBy(margins).agg(F.sum("_words").alias("tokens")), "cells")
    for m, wanted in zip(margins, (None, LANGUAGE if language is None else language, TOPIC if topic is None else topic), strict=True):
        cells = cells.join(targets(cells, m, wanted), m, "left")
    cells, keep = rake_to_keep(staged(cells.fillna(0.0), "cells-with-targets"), margins, keep)
    share = F.col("tokens") / F.sum("tokens").over(W.partitionBy())
    cells = staged(cells.select(*margins, F.when(F.col("tokens") > 0, F.col("weight") / share).otherwise(1.0).alias("_weight")), "cell-weights")
    p = F.least(F.lit(1.0), F.lit(keep) * F.col("_weight"))  # above 1 by rounding only
    return rows.join(cells, margins, "left").select(
        "row", "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_words").alias("n_words"), F.col("_weight").alias("weight"), p.alias("probability"), (F.col("_u") < p).alias("sampled")
    )

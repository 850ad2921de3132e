"""Names: rosters, sound and sequence similarity, aliases."""

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def roster(meetings: DataFrame) -> DataFrame:
    """Per member of meetings (ord, present, absent: arrays of struct name, title): meetings, and the first title seen."""
    m = meetings.select("ord", F.explode(F.concat("present", "absent")).alias("p")).select("ord", "p.name", "p.title")
    return m.groupBy(F.col("name").alias("member")).agg(F.countDistinct("ord").alias("meetings"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("ord"))).alias("title"))


def ratio_batches(batches):
    for b in batches:
        got = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, "ratio"])


def with_ratio(pairs: DataFrame) -> DataFrame:
    """Adds ratio, the matching-blocks similarity of strings x and y."""
    return pairs.mapInArrow(ratio_batches, ", ".join([*(f"{n} {k}" for n, k in pairs.dtypes), "ratio double"]))


def resolve(names: DataFrame, members: DataFrame, least: float = 0.6, sound: float = 0.8, other_letter: float = 0.85, sure: float = 0.75) -> DataFrame:
    """Each spoken name (body, title, name, mentions) with the best member of its body's roster (body, member, title), or null below ``least``.

    A Mayor is the roster's mayor, whatever the name, and nobody else is. A Dr may be a member with that title or without
    one; Mr, Mrs and Ms are no Dr. The score is the matching-blocks ratio, at least ``sound`` for equal Soundex codes; below
    ``sure`` it is times ``other_letter`` where first letters differ. Ties go to the first member by name. Names meet only their own
    body's members: dozens, by the nature of a roster.
    """
    n = names.withColumns({"x": F.lower("name"), "_title": F.regexp_replace("title", r"\.+$", "")}).drop("title")
    mayor = members.where("title = 'Mayor'").groupBy("body").agg(F.min("member").alias("mayor"))
    others = members.where("title is null or title <> 'Mayor'").select("body", "member", F.lower("member").alias("y"), F.col("title").alias("held"))
    fits = F.when(F.col("_title") == "Dr", F.col("held").isNull() | (F.col("held") == "Dr")).when(F.col("_title").isin("Mr", "Mrs", "Ms"), F.col("held").isNull() | (F.col("held") != "Dr")).otherwise(True)
    pairs = n.where("_title is null or _title <> 'Mayor'").join(others, "body").where(fits)
    scored = with_ratio(pairs.select("body", "_title", "name", "member", "x", "y"))
    r = F.when(F.soundex("x") == F.soundex("y"), F.greatest("ratio", F.lit(sound))).otherwise(F.col("ratio"))
    scored = scored.withColumn("r", r).withColumn("score", F.when((F.substring("x", 1, 1) != F.substring("y", 1, 1)) & (F.col("r") < sure), F.col("r") * other_letter).otherwise(F.col("r")))
    best = scored.groupBy("body", "_title", "name").agg(F.min(F.struct((-F.col("score")).alias("s"), "member")).alias("b"))
    best = best.select("body", F.col("_title").alias("t"), F.col("name").alias("m"), F.col("b.member").alias("member"), (-F.col("b.s")).alias("score"))
    j = n.join(best, (n["body"] == best["body"]) & n["_title"].eqNullSafe(best["t"]) & (n["name"] == best["m"]), "left").drop(best["body"]).join(mayor, "body", "left")
    is_mayor = F.coalesce(F.col("_title") == "Mayor", F.lit(False))
    member = F.when(is_mayor, F.col("mayor")).when(F.col("score") >= least, F.col("member"))
    score = F.when(is_mayor, F.when(F.col("mayor").isNotNull(), 1.0)).when(F.col("score") >= least, F.round("score", 2))
    return j.select("body", F.col("_title").alias("title"), "name", "mentions", member.alias("member"), score.alias("score"))


def alias_table(resolved: DataFrame) -> DataFrame:
    """Share of mentions that are resolved, over all names."""
    return resolved.agg(F.sum("mentions").alias("mentions"), F.round(F.sum(F.when(F.col("member").isNotNull(), F.col("mentions"))) / F.sum("mentions"), 6).alias("resolved"))

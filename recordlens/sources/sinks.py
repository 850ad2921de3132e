"""Sinks: append without known ids, atomic rebuild, dead letters, manifests, exports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _filled(text: str, least: int):
    return F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > least


def new_records(records: DataFrame, known: DataFrame, key: str, text: str, least: int = 0) -> DataFrame:
    """Records with text whose key is not known yet, each key once."""
    return records.where(_filled(text, least)).join(known.select(key), key, "left_anti").dropDuplicates([key])


def append(records: DataFrame, path: str, key: str, text: str) -> None:
    """Append records whose key the sink at ``path`` does not hold."""
    spark = records.sparkSession
    known = spark.read.schema(records.schema).json(path)
    new_records(records, known, key, text).write.mode("append").json(path)


def rebuild(records: DataFrame, path: str, key: str, text: str) -> None:
    """Replace the sink by the records. They are written beside it first, and take its place by renaming once they are complete.

    Until then the old records stay; a run that dies between the two renames leaves them in ``<path>.old``.
    """
    spark = records.sparkSession
    to, new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    records.where(_filled(text, 0)).dropDuplicates([key]).write.mode("overwrite").json(f"{path}.new")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(to) and not fs.rename(to, old) or not fs.rename(new, to):
        raise OSError(f"cannot put {path}.new in the place of {path}")
    fs.delete(old, True)


def dead_letters(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good records, lines that do not parse with their error): together they are all lines."""
    parsed = lines.withColumn("_r", F.from_json(column, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_r._corrupt_record").isNotNull() | F.col("_r").isNull()
    good = parsed.where(~bad).select("_r.*").drop("_corrupt_record")
    return good, parsed.where(bad).select(F.col(column).alias("line"), F.lit("not a JSON object of the schema").alias("error"))


def manifest(records: DataFrame, known: DataFrame, key: str, text: str, least: int = 0) -> DataFrame:
    """One row: seen, written, empty, duplicate."""
    k = known.select(key).distinct().withColumn("_known", F.lit(True))
    r = records.join(k, key, "left")
    full = _filled(text, least)
    return r.agg(F.count(F.lit(1)).alias("seen"), F.count_if(full & F.col("_known").isNull()).alias("written"), F.count_if(~full).alias("empty"), F.count_if(full & F.col("_known")).alias("duplicate"))


def export_rows(rows: DataFrame) -> DataFrame:
    """Flat rows for CSV: arrays joined by " | ", line breaks in strings to spaces."""
    out = []
    for name, kind in rows.dtypes:
        c = F.array_join(name, " | ") if kind.startswith("array") else F.replace(F.col(name), F.lit("\n"), F.lit(" ")) if kind == "string" else F.col(name)
        out.append(c.alias(name))
    return rows.select(out)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header, for any reader: quotes are doubled, white space at the ends of a field stays."""
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    export_rows(rows).write.mode("overwrite").options(**plain).csv(path)


def write_dead_letters(lines: DataFrame, schema: str, good_path: str, bad_path: str, column: str = "value") -> None:
    """Records to one sink, and the lines that do not parse to another."""
    good, bad = dead_letters(lines, schema, column)
    good.write.mode("append").json(good_path)
    bad.write.mode("append").json(bad_path)


def write_threads(turns: DataFrame, path: str, column: str) -> None:
    """Transcripts of turns (thread, ord, role, text), one row a thread, in a folder for each value of ``column``."""
    said = F.array_sort(F.collect_list(F.struct("ord", F.concat("role", F.lit(": "), "text").alias("line"))))
    whole = turns.groupBy("thread", column).agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias("transcript"), F.count(F.lit(1)).alias("turns"))
    write_by(whole, path, column)


def write_by(rows: DataFrame, path: str, column: str) -> None:
    """One folder for each value of ``column``; readers prune by it."""
    rows.repartition(column).write.mode("overwrite").partitionBy(column).json(path)

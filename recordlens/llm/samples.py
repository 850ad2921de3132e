"""Bounded samples of labelled rows, and sums of fixed-size arrays over all tasks."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4; rows with 2 are held out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


HELD_OUT = 2
#: Shares in which the sums of all tasks are first merged.
SHARES = 64


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most ``most[label]`` documents of each label outside the held-out fold, by a hash of doc_id."""
    known = labels.where(F.col(column).isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.max(column).alias("label"))
    by = F.xxhash64("doc_id")
    ids = [known.where(F.col("label") == k).orderBy(by, "doc_id").limit(most[k]) for k in (0, 1)]
    ids = staged(ids[0].unionByName(ids[1]), "sample-ids")
    text = F.coalesce("text", F.lit("")).alias("text")
    # The sample's ids are few by their bound, so they go to the documents; all tasks scan, and the few rows found go to 32 files.
    return staged(docs.select("doc_id", text).join(F.broadcast(ids), "doc_id").repartition(32, "doc_id"), "sample")


def summed(docs: DataFrame, add: Callable, size: int, slices: int = 16) -> np.ndarray:
    """Sum over all tasks of the float arrays of ``size`` that ``add(batches)`` returns for a task's batches.

    A task sends one row for each slice of the array, whatever it has read. Sums of whole numbers do not depend on the order of merging.
    """
    part = size // slices

    def local(batches):
        total = add(batches).astype("<f8").reshape(slices, part)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["slice", "values"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("slice").to_pylist(), b.column("values"), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw.as_buffer(), "<f8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "values"])

    schema = "slice int, values binary"
    out = np.zeros((slices, part))
    # Tasks are merged in shares first: a slice of many tasks is never merged by one.
    shares = docs.mapInArrow(local, schema).withColumn("share", F.spark_partition_id() % SHARES).repartition("slice", "share")
    for r in shares.mapInArrow(merge, schema).repartition("slice").mapInArrow(merge, schema).collect():
        out[r["slice"]] += np.frombuffer(r["values"], "<f8")
    return out.reshape(-1)

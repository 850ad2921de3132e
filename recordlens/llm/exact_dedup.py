"""Exact dedup by composable polynomial fingerprints (operator 4).

A text's fingerprint is its bytes as a polynomial at a fixed point, modulo two 31-bit primes. Chunks
are hashed apart and put together by length-shifted arithmetic, H(a + b) = H(a) r^len(b) + H(b), so a
huge text may be cut over many tasks. Rows with equal fingerprints are then compared chunk by chunk;
a fingerprint that covers different texts is resolved by the texts' SHA-256 digests.

Null text counts as empty, texts are equal when identical after lower-casing A-Z. Repeated rows are
members of their group. A null doc_id is kept only when its whole group has null ids, once per row.
Extra columns are ignored. An empty table gives an empty result; very long texts are hashed and compared in chunks.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ascii_lower, packed, staged

P1, R1 = 2147483647, 1234567891
P2, R2 = 2147483629, 987654321
CHUNK = 4096
#: Texts of more characters are cut into parts of so many for the fingerprint.
HUGE_CHARS = 1 << 22


def _powers(r: int, p: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * r % p
    return out[::-1].copy()


_POW = {p: _powers(r, p, CHUNK) for r, p in ((R1, P1), (R2, P2))}
_STEP = {p: pow(r, CHUNK, p) for r, p in ((R1, P1), (R2, P2))}


def poly_hash(data: bytes, r: int, p: int) -> int:
    """Polynomial of ``data`` at ``r`` mod ``p``; chunk hashes by one matrix product, then shifted together."""
    head = len(data) % CHUNK
    first = np.frombuffer(data, np.uint8, head)
    h = int((first * _POW[p][CHUNK - head :]).sum() % p) if head else 0
    if len(data) > head:
        body = np.frombuffer(data, np.uint8, offset=head).reshape(-1, CHUNK)
        step = _STEP[p]
        for c in (body @ _POW[p] % p).tolist():
            h = (h * step + c) % p
    return h


def combine(h_left: int, h_right: int, right_len: int, r: int, p: int) -> int:
    """Fingerprint of a concatenation from those of its parts."""
    return (h_left * pow(r, right_len, p) + h_right) % p


def _prints(batches):
    """Adds h1, h2, n_bytes, text_sha256 and the shifts r^n_bytes s1, s2; text goes unless wanted."""
    for b in batches:
        h1, h2, size, sha = [], [], [], []
        for t in b.column("text"):
            raw = (t.as_py() or "").encode().lower()
            h1.append(poly_hash(raw, R1, P1))
            h2.append(poly_hash(raw, R2, P2))
            size.append(len(raw))
            sha.append(hashlib.sha256(raw).hexdigest())
        names = [n for n in b.schema.names if n != "text"]
        shifts = [[pow(r, n, p) for n in size] for r, p in ((R1, P1), (R2, P2))]
        new = [*(pa.array(x, pa.int64()) for x in (h1, h2, size, *shifts)), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], [*names, "h1", "h2", "n_bytes", "s1", "s2", "text_sha256"])


_PRINTS = "h1 long, h2 long, n_bytes long, s1 long, s2 long, text_sha256 string"


def _with_text(batches):
    for b in batches:
        rows = [(t.as_py() or "").encode().lower() for t in b.column("text")]
        keys = [pa.array([f(raw) for raw in rows], pa.int64()) for f in (lambda x: poly_hash(x, R1, P1), lambda x: poly_hash(x, R2, P2), len)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([raw.decode() for raw in rows], pa.string())], [*KEY, "text"])


KEY = ["h1", "h2", "n_bytes"]


def fingerprints(docs: DataFrame, huge_chars: int = HUGE_CHARS) -> DataFrame:
    """doc_id, h1, h2, n_bytes, text_sha256 of each row.

    Texts of more than ``huge_chars`` characters are cut into parts that are spread over the cluster,
    hashed apart and combined in order.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cols = ["doc_id", *KEY, "text_sha256"]
    small = docs.where(F.length("text") <= huge_chars).mapInArrow(_prints, f"doc_id {dict(docs.dtypes)['doc_id']}, {_PRINTS}")
    n = F.ceil(F.length("text") / huge_chars).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("text").substr(i * huge_chars + 1, F.lit(huge_chars)))
    parts = (
        docs.where(F.length("text") > huge_chars)
        .withColumns({"row": F.expr("uuid()"), "whole": F.sha2(ascii_lower(F.col("text")), 256)})
        .select("doc_id", "row", "whole", F.posexplode(cuts).alias("part", "text"))
        .repartition("row", "part")
        .mapInArrow(_prints, f"doc_id {dict(docs.dtypes)['doc_id']}, row string, whole string, part int, {_PRINTS}")
    )

    def fold(h: str, s: str, p: int):
        return F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: (acc * x[s] + x[h]) % p).alias(h)

    huge = (
        parts.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("whole").alias("text_sha256"), F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("part", "h1", "h2", "s1", "s2"))).alias("parts"))
        .select("doc_id", fold("h1", "s1", P1), fold("h2", "s2", P2), "n_bytes", "text_sha256")
    )
    return small.select(cols).unionByName(huge.select(cols))


def colliding(docs: DataFrame, repeated: DataFrame, chunk_chars: int = 1 << 16) -> DataFrame:
    """Fingerprints of ``repeated`` (h1, h2, n_bytes) that cover texts which differ in some chunk.

    Rows stream chunk by chunk into a partial aggregate, so a group of any size costs each task one
    row for each of its distinct chunks.
    """
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / chunk_chars).cast("int"))
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("text").substr(i * chunk_chars + 1, F.lit(chunk_chars)))
    members = docs.select("text").mapInArrow(_with_text, "h1 long, h2 long, n_bytes long, text string").join(repeated, KEY, "left_semi")
    chunks = members.select(*KEY, F.posexplode(cuts).alias("chunk_no", "chunk")).groupBy(*KEY, "chunk_no", "chunk").agg(F.lit(1).alias("one"))
    return chunks.groupBy(*KEY, "chunk_no").count().where("count > 1").select(KEY).distinct()


def exact_dedup(docs: DataFrame, huge_chars: int = HUGE_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text)."""
    prints = fingerprints(docs, huge_chars).groupBy("doc_id", *KEY, "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    prints = staged(prints, "fingerprints")
    groups = prints.groupBy(KEY).agg(F.sum("copies").alias("n"))
    clash = staged(colliding(docs, staged(groups.where("n > 1").select(KEY), "repeated-fingerprints")), "collisions")
    keyed = prints.join(clash.withColumn("clash", F.lit(True)), KEY, "left").withColumn("variant", F.when(F.col("clash"), F.col("text_sha256")).otherwise("")).drop("clash")
    key = [*KEY, "variant"]
    keep = staged(keyed.groupBy(key).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return (
        keyed.join(keep, key)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    rows = packed(docs, "doc_id", "text").select("doc_id", "row", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256).alias("sha"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "sha"]).select("row.*")

"""Exact top-k inner products by a three-phase uniform threshold (operator 3).

Vectors are cut into groups of dimensions; a score is the sum of the groups' local scores.

1. Every block of candidates sends, for each query, its local lists: the k best of each group, summed over the groups.
   The k-th best sum over all blocks is a safe cutoff for the query.
2. The cutoffs go back to the blocks. A vector can reach cutoff t only if one group's local score is at least t / groups (the
   uniform threshold), and only if the local scores of all groups but the last, with the last one's bounded by the lengths of both
   vectors' parts, come to t. On the vectors of sf0.1 one pair of five is left.
3. Of those alone the last group is fetched; their scores are exact, and the k best that reach t are sent.

Queries and candidates meet block by block; what a block sends is at most k rows for each query.

Components become floor(256 x) with x as double. Null vectors and vectors with null or non-finite
components take no part; shorter vectors count as padded with zeros. Rows that repeat a vec_id are
candidates like any other, but never for a query of the same vec_id; of repeated equal rows one
counts. A null vec_id takes no part. Scores are 64-bit integers. An empty table gives an empty result, extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .staging import staged

EVERY, K, GROUPS = 50, 5, 4
QUERY_BLOCK, VECTOR_BLOCK = 4096, 8192
#: Below this magnitude of components, products of doubles are exact integers (for up to 2^13 dimensions).
EXACT = 1 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v an array of floor(256 x) as long."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(d, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(good).select("vec_id", F.transform(d, lambda x: F.floor(x * 256)).alias("v")).dropDuplicates(["vec_id", "v"])


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _pack(width: int, size: int):
    """Rows of a partition in blocks: ids, cutoffs and a matrix, as bytes."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                packed = [part.column(c).to_numpy().astype("<i8") for c in ("vec_id", "cutoff")] + [_matrix(part.column("v"), width).astype("<i8")]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], ["ids", "cutoffs", "matrix"])

    return run


def _blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    return rows.select("vec_id", "cutoff", "v").mapInArrow(_pack(width, size), "ids binary, cutoffs binary, matrix binary")


def _exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a type whose products are exact."""
    kind = np.float64 if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < EXACT else np.int64
    return q.astype(kind), x.astype(kind)


def _dimensions(width: int, groups: int) -> list[np.ndarray]:
    return np.array_split(np.arange(width), groups)


def _local(q: np.ndarray, x: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Local scores of a group of dimensions, queries by vectors."""
    return (q[:, dims] @ x[:, dims].T).astype(np.int64)


_TILE = 512


def _tiles(b: pa.RecordBatch, width: int):
    """(query ids, queries, vector ids, vectors) for tiles of the block pairs of a batch."""
    for i in range(b.num_rows):
        q_ids, q, x_ids, x = (np.frombuffer(b.column(c)[i].as_buffer(), "<i8") for c in ("q_ids", "q", "ids", "matrix"))
        q, x = _exact(q.reshape(-1, width), x.reshape(-1, width))
        for at in range(0, len(q), _TILE):
            yield q_ids[at : at + _TILE], q[at : at + _TILE], x_ids, x


def _best(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, vector) of the k highest scores of each row, ties to smaller ids; ``own`` marks what is left out."""
    low = np.iinfo(np.int64).min
    score = np.where(own, low, score)
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None] if score.shape[1] > k else low
    rows, cols = np.nonzero((score >= kth) & (score > low))
    order = np.lexsort((ids[cols], -score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    start = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - start < k
    return rows[keep], cols[keep]


def _first(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of some entries (query, vector, score) are among the k best of their query, ties to smaller ids."""
    order = np.lexsort((ids[cols], -score, rows))
    rows = rows[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def _emit(q_ids, ids, rows, cols, score):
    return pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(ids[cols]), pa.array(score)], ["query_id", "vec_id", "score"])


def _local_lists(width: int, groups: int, k: int):
    """Phase 1: the k best of each local list; only these entries are summed over the groups."""

    def run(batches):
        for b in batches:
            for q_ids, q, ids, x in _tiles(b, width):
                own = q_ids[:, None] == ids
                local = [_local(q, x, d) for d in _dimensions(width, groups)]
                rows, cols = np.unique(np.concatenate([np.stack(_best(s, ids, own, k)) for s in local], axis=1), axis=1)
                score = sum(s[rows, cols] for s in local)
                keep = _first(rows, cols, score, ids, k)
                yield _emit(q_ids, ids, rows[keep], cols[keep], score[keep])

    return run


#: Pairs whose last group is fetched at once.
FETCH = 1 << 16


def survivors(q: np.ndarray, x: np.ndarray, t: np.ndarray, own: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 of a tile: (query, vector, score) of all pairs whose score reaches the query's cutoff ``t``.

    A sum of t needs a local score of ceil(t / groups): the uniform threshold. Local scores of all groups but the last are added up; the last one's
    are bounded by the lengths of both parts. Pairs that cannot reach the cutoff with that bound, or the uniform threshold in any
    group, are dropped; of the others alone the last group is fetched, and their scores are exact.
    """
    *early, last = _dimensions(q.shape[1], groups)
    share = -(-t // groups)
    partial, over = np.zeros(own.shape, np.int64), np.zeros(own.shape, bool)
    for dims in early:
        s = _local(q, x, dims)
        partial += s
        over |= s >= share
    length = lambda m: np.sqrt((m[:, last].astype(np.float64) ** 2).sum(axis=1))
    most = np.ceil(length(q)[:, None] * length(x) * (1 + 1e-9)).astype(np.int64)
    rows, cols = np.nonzero((partial + most >= t) & (over | (most >= share)) & ~own)
    rest = [np.einsum("ij,ij->i", q[r][:, last], x[c][:, last]).astype(np.int64) for r, c in ((rows[at : at + FETCH], cols[at : at + FETCH]) for at in range(0, len(rows), FETCH))]
    rest = np.concatenate(rest) if rest else np.zeros(0, np.int64)
    score = partial[rows, cols] + rest
    enough = (score >= t[rows, 0]) & (over[rows, cols] | (rest >= share[rows, 0]))
    return rows[enough], cols[enough], score[enough]


def _sufficient(width: int, groups: int, k: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                one, at = b.slice(i, 1), 0
                cutoffs = np.frombuffer(one.column("cutoffs")[0].as_buffer(), "<i8")
                for q_ids, q, ids, x in _tiles(one, width):
                    t = cutoffs[at : at + len(q_ids)][:, None]
                    at += len(q_ids)
                    rows, cols, score = survivors(q, x, t, q_ids[:, None] == ids, groups)
                    keep = _first(rows, cols, score, ids, k)
                    yield _emit(q_ids, ids, rows[keep], cols[keep], score[keep])

    return run


#: Below any score; its negative still fits a long.
LOWEST = -(1 << 62)
_FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, groups: int = GROUPS) -> DataFrame:
    """query_id, rank, vec_id, score for queries with vec_id divisible by ``every`` among ``vectors`` (vec_id, embedding)."""
    v = staged(usable(vectors), "vectors").withColumn("cutoff", F.lit(LOWEST))
    width = max(1, v.agg(F.max(F.size("v"))).first()[0] or 0)
    candidates = _blocks(v, width, VECTOR_BLOCK)
    asked = staged(v.where(F.col("vec_id") % every == 0).groupBy("vec_id", "cutoff").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def meet(queries: DataFrame) -> DataFrame:
        """Each block of queries with each block of candidates."""
        q = _blocks(queries.repartition(blocks, "vec_id"), width, QUERY_BLOCK).select(F.col("ids").alias("q_ids"), "cutoffs", F.col("matrix").alias("q"), F.monotonically_increasing_id().alias("name"))
        q = staged(q, "query-blocks")
        names = [r["name"] for r in q.select("name").collect()]
        x = candidates.select("ids", "matrix", F.explode(F.array(*map(F.lit, names)) if names else F.expr("array_repeat(0L, 0)")).alias("name"))
        return x.join(q, "name").select("q_ids", "cutoffs", "q", "ids", "matrix")

    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lists = meet(asked).mapInArrow(_local_lists(width, groups, k), _FOUND)
    best = lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    cutoffs = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(LOWEST)).alias("cutoff"))
    queries = staged(asked.drop("cutoff").join(staged(cutoffs, "cutoffs"), "vec_id"), "queries-with-cutoffs")
    found = meet(queries).mapInArrow(_sufficient(width, groups, k), _FOUND)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(every: int = EVERY, k: int = K) -> str:
    """DuckDB SQL for tables whose vec_id does not repeat."""
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {k}"""

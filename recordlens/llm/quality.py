"""Quality classifier on random-indexing word vectors (operator 8).

Words, and the forms of words (trailing marks, capitals, repetition), are hashed to buckets. Each
bucket has a sparse random index vector; a bucket's word vector is the sum of its neighbours' index
vectors over the whole corpus, plus its own. A document is the mean of its words' vectors. A network
of two layers, trained on a bounded sample and calibrated by temperature on a part of it that the
training does not see, gives the probability.

A score depends on the text alone. Null text counts as empty; empty texts get the score of the zero
vector. Repeated rows are scored alike. Extra columns are ignored. An empty table gives an empty result; without labelled rows every text gets one
score. Very long texts are read whole, a bounded slice of words at a time.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import HELD_OUT, fold, labelled, summed
from .words import _K, Words, mix, slices

#: Labelled documents of each label that training reads at most.
SAMPLE = {0: 6_000, 1: 14_000}
BUCKETS, FORMS, DIM, NONZERO, HIDDEN = 8192, 1024, 32, 4, 32
THRESHOLD = 0.7

_MARK = np.ones(256, np.uint8)
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero components of each bucket's index vector; words first, then forms."""
    rng = np.random.default_rng(20_240_101)
    n = BUCKETS + FORMS
    return rng.permuted(np.tile(np.arange(DIM), (n, 1)), axis=1)[:, :NONZERO], rng.choice([-1.0, 1.0], (n, NONZERO))


POSITION, SIGN = _index_vectors()
INDEX = np.zeros((BUCKETS + FORMS, DIM))
np.put_along_axis(INDEX, POSITION, SIGN, 1)


def _buckets(text):
    """(first row, words, word bucket, form bucket) slice by slice; form buckets follow the word buckets."""
    for first, data, offsets in slices(text):
        w = Words(data, offsets)
        lower = Words(data, offsets, lower=True).hashes()
        n = len(w.starts)
        tail = np.zeros(n, np.uint64)
        for k in range(1, 5):  # the marks among the last four bytes
            at = np.maximum(w.ends - k, w.starts)
            byte = w.data[at].astype(np.uint64) if n else tail
            tail = tail * np.uint64(256) + byte * (_MARK[w.data[at]] & (w.ends - k >= w.starts)).astype(np.uint64) if n else tail
        capitals = np.concatenate([[0], np.cumsum(_UPPER[w.data])])
        up, size = capitals[w.ends] - capitals[w.starts], w.ends - w.starts
        case = np.where(up == 0, 0, np.where(up * 2 > size, 2, 1)).astype(np.uint64)
        again = np.zeros(n, np.uint64)
        again[1:] = lower[1:] == lower[:-1]
        again[w.ptr[:-1][w.ptr[:-1] < n]] = 0
        form = mix(mix(tail + np.uint64(1)) * _K + case * np.uint64(2) + again + np.minimum(size, 3).astype(np.uint64) * np.uint64(16) * (tail > 0))
        yield first, w, (lower >> np.uint64(51)).astype(np.int64), BUCKETS + (form >> np.uint64(54)).astype(np.int64)


def _contexts(batches) -> np.ndarray:
    """Sums of the index vectors of each bucket's neighbours: the words beside it and its own form (or word)."""
    total = np.zeros((BUCKETS + FORMS) * DIM)
    for b in batches:
        for _, w, word, form in _buckets(b.column("text")):
            n = len(word)
            if not n:
                continue
            inner = np.ones(n, bool)
            inner[w.ptr[:-1][w.ptr[:-1] < n]] = False
            right = np.flatnonzero(inner)
            of = np.concatenate([word[right], word[right - 1], form[right], word])
            by = np.concatenate([word[right - 1], word[right], form[right - 1], form])
            for k in range(NONZERO):
                total += np.bincount(of * DIM + POSITION[by, k], SIGN[by, k], len(total))
    return total


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A unit vector for each bucket: half its own index vector, half its contexts."""
    sums = summed(docs.select("text"), _contexts, (BUCKETS + FORMS) * DIM).reshape(-1, DIM)
    sums -= sums.mean(0)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (INDEX / np.sqrt(NONZERO) + sums / np.maximum(norm, 1e-9)).astype(np.float32)


def _pooled(text, vectors: np.ndarray):
    """(first row, document vectors): means over words, over forms, and the scaled logarithm of the length."""
    for first, w, word, form in _buckets(text):
        rows = len(w.ptr) - 1
        out = np.zeros((rows, 2 * DIM + 1), np.float32)
        count = np.diff(w.ptr)
        for a in range(0, rows, 256):
            z = min(a + 256, rows)
            part = slice(w.ptr[a], w.ptr[z])
            row = np.repeat(np.arange(z - a), count[a:z])
            per = np.maximum(count[a:z], 1)[:, None]
            words = np.bincount(row * BUCKETS + word[part], minlength=(z - a) * BUCKETS).reshape(z - a, BUCKETS).astype(np.float32)
            forms = np.bincount(row * FORMS + form[part] - BUCKETS, minlength=(z - a) * FORMS).reshape(z - a, FORMS).astype(np.float32)
            out[a:z, :DIM] = words @ vectors[:BUCKETS] / per
            out[a:z, DIM : 2 * DIM] = forms @ vectors[BUCKETS:] / per
        out[:, -1] = np.log1p(count) / 8
        yield first, out


class Network:
    """Two layers with tanh between, and a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature: float = 1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> "Network":
        """Adam on the cross-entropy of four fifths of the rows; the temperature by the other fifth."""
        rng = np.random.default_rng(7)
        order = rng.permutation(len(x))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        cut = max(1, len(x) * 4 // 5)
        net = cls(x[:cut].mean(0), x[:cut].std(0) + 1e-2, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))
        names = ("w1", "b1", "w2", "b2")
        m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        z = (x - net.mean) / net.scale
        for _ in range(epochs):
            for at in np.split(rng.permutation(cut), range(batch, cut, batch)):
                hidden = np.tanh(z[at] @ net.w1 + net.b1)
                error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -40, 40))) - y[at]) / len(at)
                back = error[:, None] * net.w2 * (1 - hidden**2)
                gradient = {"w1": z[at].T @ back, "b1": back.sum(0), "w2": hidden.T @ error, "b2": error.sum(keepdims=True)}
                t += 1
                for k in names:
                    g = gradient[k] + decay * getattr(net, k)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    setattr(net, k, getattr(net, k) - rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
        if len(x) > cut:
            logits = net.logits(x[cut:])
            loss = lambda s: np.mean(np.logaddexp(0, logits / s) - y[cut:] * logits / s)
            net.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))
        return net


def train(docs: DataFrame, labels: DataFrame, vectors, most: dict[int, int] | None = None) -> Network:
    """A network from at most ``most[label]`` (default ``SAMPLE``) labelled documents outside the held-out fold."""

    def run(batches):
        for b in batches:
            label = b.column("label").to_numpy()
            for first, x in _pooled(b.column("text"), vectors.value):
                yield pa.RecordBatch.from_arrays([pa.array(label[first : first + len(x)].astype(np.int32)), pa.array(list(map(bytes, x.astype("<f4"))), pa.binary())], ["label", "x"])

    sample = labelled(docs, labels, "quality", most or SAMPLE).select("text", F.col("label").cast("int").alias("label"))
    rows = sample.mapInArrow(run, "label int, x binary").toArrow().sort_by("x")
    if not len(rows):
        zero = np.zeros
        return Network(zero(2 * DIM + 1), np.ones(2 * DIM + 1), zero((2 * DIM + 1, HIDDEN)), zero(HIDDEN), zero(HIDDEN), zero(1))
    x = np.stack([np.frombuffer(v.as_buffer(), "<f4") for v in rows.column("x").combine_chunks()])
    return Network.train(x, rows.column("label").to_numpy())


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    network = context.broadcast(train(docs, labels, vectors))

    def run(batches):
        for b in batches:
            for first, x in _pooled(b.column("text"), vectors.value):
                p = network.value(x)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(p)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")

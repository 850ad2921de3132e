"""Toxicity by a linear-chain conditional random field (operator 1).

Token labels come from the training documents: words and word beginnings that tell toxic documents
from the others mark tokens of toxic documents as toxic. A two-state chain with these features is
trained on windows of tokens; forward-backward marginals give each token's probability, runs of
toxic tokens give the offending offsets, and a document's marginals give its score.

A score depends on the text alone. Null text counts as empty; empty texts get the score of a text
without any toxic token. Repeated rows are scored alike. Very long texts are tagged whole. An empty table gives an
empty result; without labelled documents nothing is toxic. Extra columns are ignored (``keep_clean`` keeps them,
whatever their names).
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import HELD_OUT, fold, labelled
from .words import NOT_ALNUM, Words, slices

#: Labelled documents of each label that training reads at most.
SAMPLE = {0: 12_000, 1: 4_000}
#: Lengths in bytes of the word beginnings that are features; 0 is the whole word.
HEADS = (0, 4, 5, 6, 7)
LEAST_ODDS, LEAST_EVIDENCE = 4.0, 25.0
THRESHOLD = 0.3
WINDOW = 24


def _tokens(text):
    for first, data, offsets in slices(text, 2 << 20):
        w = Words(data, offsets, lower=True, between=NOT_ALNUM)
        yield first, w, [w.hashes(seed=k, head=k or None) for k in HEADS]


def _document_features(batches):
    """(feature, label) once for each document that has it."""
    for b in batches:
        label = b.column("label").to_numpy()
        for first, w, hashes in _tokens(b.column("text")):
            found = [np.unique(np.concatenate([h[a:z] for h in hashes])) for a, z in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
            marks = np.repeat(label[first : first + len(found)], [len(f) for f in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(marks)], ["feature", "label"])


class Lexicon:
    """Sorted feature hashes with their log-odds, behind a small table that most tokens fail."""

    def __init__(self, features: np.ndarray, odds: np.ndarray):
        order = np.argsort(features)
        self.features, self.odds = features[order], odds[order].astype(np.float32)
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.features >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.float32)
        at = np.flatnonzero(self.may[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(at) and len(self.features):
            where = np.minimum(np.searchsorted(self.features, hashes[at]), len(self.features) - 1)
            out[at] = np.where(self.features[where] == hashes[at], self.odds[where], 0)
        return out


def _contexts(lexicon):
    """(feature, context, label) of known features; the context is the words on both sides."""

    def run(batches):
        for b in batches:
            label = b.column("label").to_numpy().astype(np.int32)
            for first, w, hashes in _tokens(b.column("text")):
                word, row = hashes[0], np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
                around = np.zeros(len(word), np.uint64)
                same = row[1:] == row[:-1]
                around[1:] += np.where(same, word[:-1], 0) * np.uint64(3)
                around[:-1] += np.where(same, word[1:], 0) * np.uint64(5)
                for h in hashes:
                    at = np.flatnonzero(lexicon.value(h))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(around[at].view(np.int64)), pa.array(label[first + row[at]])], ["feature", "context", "label"])

    return run


def _telling(counted: DataFrame, toxic: int, clean: int) -> Lexicon:
    """Features (feature, t, c) that are toxic far more often than chance: by odds, and by the counts' log-likelihood ratio."""
    t, c, share = F.col("t"), F.col("c"), toxic / (toxic + clean)
    odds = F.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1)))
    evidence = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0))
    rows = counted.where("t >= 3").withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE))
    rows = rows.select("feature", "odds").toArrow()  # as many as the bounded sample has
    return Lexicon(rows.column("feature").to_numpy().view(np.uint64), rows.column("odds").to_numpy())


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Features of toxic documents: told by the documents that have them, then by their distinct contexts.

    Copies of one toxic document repeat all its words, but always in the same contexts.
    """
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    rows = sample.select("text", F.col("label").cast("int").alias("label"))
    sums = [F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")]
    first = _telling(rows.mapInArrow(_document_features, "feature long, label int").groupBy("feature").agg(*sums), toxic, clean)
    seen = rows.mapInArrow(_contexts(sample.sparkSession.sparkContext.broadcast(first)), "feature long, context long, label int")
    return _telling(seen.groupBy("feature", "context").agg(F.max("label").alias("label")).groupBy("feature").agg(*sums), toxic, clean)


def _strengths(lexicon: Lexicon, hashes: list[np.ndarray]) -> np.ndarray:
    """Two features of each token: log-odds of its whole word and of its strongest beginning."""
    return np.stack([lexicon(hashes[0]), np.maximum.reduce([lexicon(h) for h in hashes[1:]])], 1)


def _training_windows(lexicon):
    def run(batches):
        for b in batches:
            label = b.column("label").to_numpy()
            for first, w, hashes in _tokens(b.column("text")):
                f = _strengths(lexicon.value, hashes)
                marks, windows = [], []
                for i in range(len(w.ptr) - 1):
                    doc = f[w.ptr[i] : w.ptr[i + 1]]
                    if len(doc) < WINDOW:
                        doc = np.concatenate([doc, np.zeros((WINDOW - len(doc), 2), np.float32)])
                    starts, end = {0}, 0
                    for h in np.flatnonzero(doc.max(1) > 0).tolist():  # every token with a feature is in some window
                        if h >= end:
                            start = min(max(0, h - WINDOW // 2), len(doc) - WINDOW)
                            starts.add(start)
                            end = start + WINDOW
                    marks += [int(label[first + i])] * len(starts)
                    windows += [doc[s : s + WINDOW].astype("<f4").tobytes() for s in sorted(starts)]
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int32()), pa.array(windows, pa.binary())], ["label", "window"])

    return run


class Crf:
    """Two states (clean, toxic): emission weights of the toxic state, and transition scores."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray):
        self.weights, self.transition = weights, transition

    @staticmethod
    def features(strengths: np.ndarray) -> np.ndarray:
        """Bias, whole word known, beginning known, and the stronger log-odds (scaled)."""
        s = np.asarray(strengths, np.float64)
        return np.stack([np.ones(s.shape[:-1]), s[..., 0] > 0, s[..., 1] > 0, s.max(-1) / 8], -1)

    def forward_backward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sequences of equal length (n, length, features): marginals, pair marginals, log partition."""
        e = np.zeros((*x.shape[:2], 2))
        e[..., 1] = x @ self.weights
        n, length = x.shape[:2]
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            alpha[:, t] = e[:, t] + np.logaddexp(alpha[:, t - 1, 0, None] + self.transition[0], alpha[:, t - 1, 1, None] + self.transition[1])
        for t in range(length - 2, -1, -1):
            after = e[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.logaddexp(after[:, 0, None] + self.transition[:, 0], after[:, 1, None] + self.transition[:, 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        pairs = alpha[:, :-1, :, None] + self.transition + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        return np.exp(alpha + beta - z[:, None, None]), np.exp(pairs), z

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> "Crf":
        """Maximum likelihood of the labelled tokens (each sequence counts ``times``) by full-batch gradient ascent with momentum."""
        crf = cls(np.zeros(x.shape[-1]), np.zeros((2, 2)))
        tokens = times.sum() * y.shape[1]
        observed = np.einsum("n,nt,ntf->f", times, y, x)
        bigrams = np.zeros((2, 2))
        np.add.at(bigrams, (y[:, :-1].ravel(), y[:, 1:].ravel()), np.repeat(times, y.shape[1] - 1))
        speed_w, speed_t = np.zeros_like(crf.weights), np.zeros((2, 2))
        for _ in range(steps):
            marginal, pairs, _ = crf.forward_backward(x)
            speed_w = 0.9 * speed_w + (observed - np.einsum("n,nt,ntf->f", times, marginal[..., 1], x)) / tokens - decay * crf.weights
            speed_t = 0.9 * speed_t + (bigrams - np.einsum("n,ntab->ab", times, pairs)) / tokens - decay * crf.transition
            crf.weights, crf.transition = crf.weights + rate * speed_w, crf.transition + rate * speed_t
        return crf

    def settles(self) -> int:
        """Tokens without a feature after which the messages of both directions no longer change (in doubles)."""
        e = float(np.exp(self.features(np.zeros((1, 2))) @ self.weights)[0])
        (cc, ct), (tc, tt) = np.exp(self.transition).tolist()
        f, b = e, 1.0
        for t in range(1, 100_000):
            after = e * b
            f2, b2 = e * (ct + f * tt) / (cc + f * tc), (tc + after * tt) / (cc + after * ct)
            if abs(f2 - f) <= 4e-16 * f and abs(b2 - b) <= 4e-16 * b:
                return t
            f, b = f2, b2
        return 100_000

    def marginals(self, strengths: np.ndarray) -> np.ndarray:
        """Toxic probability of each token of one document; messages as ratios toxic : clean."""
        if not len(strengths):
            return np.zeros(0)
        e = np.exp(self.features(strengths) @ self.weights).tolist()
        (cc, ct), (tc, tt) = np.exp(self.transition).tolist()
        n = len(e)
        f, r = [0.0] * n, e[0]
        f[0] = r
        for t in range(1, n):
            r = f[t] = e[t] * (ct + r * tt) / (cc + r * tc)
        b, out = 1.0, [0.0] * n
        for t in range(n - 1, -1, -1):
            odds = f[t] * b
            out[t] = odds / (1 + odds)
            after = e[t] * b
            b = (tc + after * tt) / (cc + after * ct)
        return np.array(out)


class Model:
    def __init__(self, lexicon: Lexicon, crf: Crf, calibration: np.ndarray):
        self.lexicon, self.crf, self.calibration = lexicon, crf, calibration
        self.settled = 2 * crf.settles() + 1
        self.plain = lru_cache(4096)(lambda n: float(crf.marginals(np.zeros((n, 2), np.float32)).max(initial=0)))

    def __reduce__(self):
        return Model, (self.lexicon, self.crf, self.calibration)

    def summary(self, strengths: np.ndarray) -> tuple[float, float, np.ndarray | None]:
        """Largest marginal, toxic tokens expected among those over a half, and the marginals if any token has a feature."""
        if not strengths.any():
            # Without features all tokens are alike: beyond the length at which messages settle the largest marginal stays.
            return self.plain(min(len(strengths), self.settled)), 0.0, None
        p = self.crf.marginals(strengths)
        return float(p.max()), float(p[p > 0.5].sum()), p

    def score(self, largest: float, expected: float) -> float:
        a, b, c = self.calibration
        return float(1 / (1 + np.exp(-(a + b * _logit(largest) + c * np.log1p(expected)))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _summaries(model):
    def run(batches):
        m = model.value
        for b in batches:
            label = b.column("label").to_numpy()
            for first, w, hashes in _tokens(b.column("text")):
                f = _strengths(m.lexicon, hashes)
                found = [m.summary(f[a:z])[:2] for a, z in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(label[first : first + len(found)].astype(np.int32)), *(pa.array([x[k] for x in found], pa.float64()) for k in (0, 1))], ["label", "largest", "expected"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, decay: float = 1e-2) -> np.ndarray:
    """Newton's method for logistic regression with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) / len(y) + decay * w)
    return w


def train(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None) -> Model:
    """A model from at most ``most[label]`` (default ``SAMPLE``) labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    sample = labelled(docs, labels, "toxic", most or SAMPLE).withColumn("label", F.col("label").cast("int"))
    lexicon = learn_lexicon(sample)
    rows = sample.select("text", "label").mapInArrow(_training_windows(spark.sparkContext.broadcast(lexicon)), "label int, window binary")
    rows = rows.groupBy("label", "window").agg(F.count(F.lit(1)).alias("count_all")).toArrow()
    if not len(rows):
        return Model(lexicon, Crf(np.array([-6.0, 4.0, 4.0, 2.0]), np.zeros((2, 2))), np.array([0.0, 1.0, 0.0]))
    rows = rows.sort_by([("label", "ascending"), ("window", "ascending")])
    s = np.stack([np.frombuffer(w.as_buffer(), "<f4").reshape(WINDOW, 2) for w in rows.column("window").combine_chunks()])
    y = ((s.max(-1) > 0) & (rows.column("label").to_numpy() == 1)[:, None]).astype(int)
    crf = Crf.train(Crf.features(s), y, rows.column("count_all").to_numpy().astype(float))
    model = Model(lexicon, crf, np.array([0.0, 1.0, 0.0]))
    found = sample.select("text", "label").mapInArrow(_summaries(spark.sparkContext.broadcast(model)), "label int, largest double, expected double").toArrow()
    x = np.array([[1.0, _logit(a), np.log1p(b)] for a, b in zip(found.column("largest").to_pylist(), found.column("expected").to_pylist(), strict=True)])
    model.calibration = _logistic(x, found.column("label").to_numpy().astype(float))
    return model


def _spans(w: Words, i: int, p: np.ndarray | None) -> list[dict]:
    """Byte offsets in the UTF-8 text of runs of tokens over a half."""
    out: list[dict] = []
    if p is not None:
        base = w.offsets[i]
        for t in np.flatnonzero(p > 0.5):
            a, z = int(w.starts[w.ptr[i] + t] - base), int(w.ends[w.ptr[i] + t] - base)
            if out and t and p[t - 1] > 0.5:
                out[-1]["end"] = z
            else:
                out.append({"start": a, "end": z})
    return out


def _score(model, threshold: float):
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        m = model.value
        for b in batches:
            for first, w, hashes in _tokens(b.column("text")):
                f = _strengths(m.lexicon, hashes)
                scores, found = [], []
                for i in range(len(w.ptr) - 1):
                    largest, expected, p = m.summary(f[w.ptr[i] : w.ptr[i + 1]])
                    scores.append(m.score(largest, expected))
                    found.append(_spans(w, i, p))
                s = np.array(scores)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(s)), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(found, spans)], ["doc_id", "score", "predicted", "spans"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, spans (start and end bytes of toxic runs in the UTF-8 text) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int, spans array<struct<start:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(_score(shared, threshold), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of each row of ``docs``."""
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.arrow_udf("int")
    def predicted(text: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], ["doc_id", "text"])
        return pa.concat_arrays([r.column("predicted") for r in _score(shared, THRESHOLD)([rows])] or [pa.array([], pa.int32())])

    return docs.where(predicted("text") == 0)

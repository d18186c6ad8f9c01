"""A quality classifier learned from trusted positives and unlabelled text.

Positive-unlabelled learning: no negative label is used. The share of good texts among the unlabelled (the class prior) is estimated from the data, and a small network minimises the non-negative unbiased risk

    prior * E_positive[loss(f, good)] + max(0, E_unlabelled[loss(f, bad)] - prior * E_positive[loss(f, bad)]).

With the logistic loss, sigmoid(f) estimates the probability that a text is good. The features are shares of kinds of bytes and of repetition over the whole text, so that they do not depend on the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = len(PUNCTUATION) + 14


@dataclass(frozen=True)
class Config:
    positives: int = 4000  # trusted positives fitted on, about; at most twice as many
    unlabelled: int = 8000  # the same of unlabelled texts
    hidden: int = 16
    epochs: int = 400
    rate: float = 0.01
    decay: float = 1e-4
    halvings: int = 3
    errors: float = 1.0  # standard errors by which the prior lies below its bound from above
    threshold: float = 0.3
    seed: int = 11


def features(text: str) -> np.ndarray:
    """Of the whole text. An empty one has zeros."""
    out = np.zeros(N_FEATURES)
    data = text.encode("utf-8", "replace")
    words = data.split()
    if not words:
        return out
    n, k = len(data), len(words)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[: len(PUNCTUATION)] = h[np.frombuffer(PUNCTUATION, np.uint8)] / n
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    long_words = sum(len(w) > 24 for w in words)
    rest = (
        h[65:91].sum() / n,
        h[97:123].sum() / n,
        h[48:58].sum() / n,
        h[32] / n,
        h[10] / n,
        h[128:].sum() / n,
        h[:32].sum() / n,
        same / k,
        len(set(words)) / k,
        len(set(lines)) / len(lines),
        (n - k) / k / 20,
        long_words / k,
        np.log1p(k) / 10,
        h[:128].max(initial=0) / n,
    )
    out[len(PUNCTUATION) :] = rest
    return out


def squash(x: np.ndarray) -> np.ndarray:
    """Small shares matter: a log scale from a thousandth."""
    return np.log(np.maximum(x, 0) + 1e-3)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((squash(x) - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2[0]


def adam(params: list[np.ndarray], gradient, epochs: int, rate: float) -> None:
    """In place."""
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    for t in range(1, epochs + 1):
        for i, g in enumerate(gradient()):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def network(z: np.ndarray, params: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(z @ params[0] + params[1])
    return hidden, hidden @ params[2] + params[3][0]


def backward(z: np.ndarray, hidden: np.ndarray, d: np.ndarray, params: list[np.ndarray], decay: float) -> list[np.ndarray]:
    inner = np.outer(d, params[2]) * (1 - hidden**2)
    return [z.T @ inner + decay * params[0], inner.sum(0), hidden.T @ d + decay * params[2], np.array([d.sum()])]


def start(rng: np.random.Generator, width: int, hidden: int) -> list[np.ndarray]:
    return [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]


def estimate_prior(zp: np.ndarray, zu: np.ndarray, config: Config, rng: np.random.Generator) -> float:
    """Share of positives among the unlabelled: the mean over several random halvings of a bound from above, less its standard error. Nothing is known of negatives here."""
    bounds = [_bound(zp, zu, config, rng) for _ in range(config.halvings)]
    return float(np.clip(np.mean([b * (1 - config.errors * e) for b, e in bounds]), 0.02, 0.98))


def _bound(zp: np.ndarray, zu: np.ndarray, config: Config, rng: np.random.Generator) -> tuple[float, float]:
    """A bound from above of the share of positives among the unlabelled, and its relative standard error.

    A network tells positives from unlabelled texts on one half. On the other half, the share of the unlabelled above any threshold, over that of the positives, bounds the prior from above; the bound that is least with its standard error added is taken, so that a threshold above which little lies isn't chosen by chance.
    """
    zp, zu = rng.permutation(zp), rng.permutation(zu)
    a, b = len(zp) // 2, len(zu) // 2
    z = np.concatenate([zp[:a], zu[:b]])
    y = np.r_[np.ones(a), np.zeros(b)]
    weight = np.r_[np.full(a, 0.5 / max(a, 1)), np.full(b, 0.5 / max(b, 1))]
    params = start(rng, z.shape[1], config.hidden)

    def gradient():
        hidden, f = network(z, params)
        return backward(z, hidden, weight * (sigmoid(f) - y), params, config.decay)

    adam(params, gradient, config.epochs // 2, config.rate)
    p, u = (np.sort(network(x, params)[1]) for x in (zp[a:], zu[b:]))
    if not len(p) or not len(u):
        return 0.5, 0.0
    cuts = np.quantile(p, np.linspace(0.02, 0.75, 74))
    n_p, n_u = (len(x) - np.searchsorted(x, cuts) for x in (p, u))
    bound = (n_u / len(u)) / (n_p / len(p))
    error = np.sqrt(1 / n_p + 1 / np.maximum(n_u, 1))
    least = np.argmin(bound * (1 + error))
    return float(bound[least]), float(min(error[least], 1.0))


def train(positive: np.ndarray, unlabelled: np.ndarray, config: Config = Config()) -> Model | None:
    """None unless there are both positive and unlabelled texts."""
    if not len(positive) or not len(unlabelled):
        return None
    rng = np.random.default_rng(config.seed)
    both = squash(np.concatenate([positive, unlabelled]))
    mean, scale = both.mean(0), both.std(0) + 1e-3
    zp, zu = (np.clip((squash(x) - mean) / scale, -6, 6) for x in (positive, unlabelled))
    prior = estimate_prior(zp, zu, config, rng)
    z = np.concatenate([zp, zu])
    is_p = np.r_[np.ones(len(zp)), np.zeros(len(zu))]
    params = start(rng, z.shape[1], config.hidden)

    def gradient():
        hidden, f = network(z, params)
        good = sigmoid(f)
        of_p, of_u = is_p / len(zp), (1 - is_p) / len(zu)
        softplus = np.logaddexp(0, f)  # the loss of calling a text bad
        negative_risk = softplus @ of_u - prior * (softplus @ of_p)
        d_negative = good * of_u - prior * good * of_p
        # Below zero the negative part has overfitted: step back from it, and leave the positive part alone.
        d = prior * (good - 1) * of_p + d_negative if negative_risk >= 0 else -d_negative
        return backward(z, hidden, d, params, config.decay)

    adam(params, gradient, config.epochs, config.rate)
    return Model(mean, scale, *params, prior)


def sample(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> tuple[np.ndarray, np.ndarray]:
    """Features of bounded samples of trusted positives (quality 1) and of unlabelled texts, taken from documents with the ids that may be learned from.

    Features are made where the texts are, and only they are gathered. A document labelled both 1 and 0 is a positive, as no negative label is read; null ids and labels count for nothing, null texts as empty.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    out = pa.schema([("kind", pa.int32()), ("x", pa.list_(pa.float64()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield common.like(out, [batch.column(0).to_pylist(), [features(t).tolist() for t in common.texts(batch.column(1))]])

    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    n_good, n_all = good.count(), docs.count()
    good = common.hash_sample(good, F.col("doc_id"), config.seed, config.positives / max(n_good, 1)).limit(2 * config.positives)
    p = docs.join(F.broadcast(good), "doc_id", "left_semi").select(F.lit(1).alias("kind"), "text")
    u = common.hash_sample(docs, F.col("doc_id"), config.seed + 1, config.unlabelled / max(n_all, 1)).select(F.lit(0).alias("kind"), "text")
    rows = []
    for part, bound in ((p, config.positives), (u, config.unlabelled)):
        rows += part.mapInArrow(apply, "kind int, x array<double>").limit(2 * bound).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), N_FEATURES)
    kind = np.array([r["kind"] for r in rows], int)
    order = np.lexsort(np.c_[x, kind].T) if len(rows) else []
    x, kind = x[order], kind[order]
    return x[kind == 1], x[kind == 0]


def probabilities(model: Model | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    if not texts:
        return np.zeros(0)
    return sigmoid(model.logit(np.stack([features(t) for t in texts])))


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row; other columns aren't read. A null text counts as empty. Without a model every score is 0.5.

    Texts of any length are read whole. Repeated ids and null ids are rows of their own; equal texts have equal scores. An empty table has no row.
    """
    common.prepare(docs.sparkSession)
    out = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield common.like(out, [batch.column(0).to_pylist(), probabilities(model, common.texts(batch.column(1))).tolist()])

    found = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("t"))
    return found.mapInArrow(apply, "id long, score double").withColumnRenamed("id", id_column)


def keep(docs: DataFrame, model: Model | None, threshold: float = Config.threshold, text_column: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns, whatever their ids; rows of one id are judged each by its own text, null texts as empty ones. Without a model all rows stay. An empty table stays empty."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index(text_column)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(model, common.texts(batch.column(at))) >= threshold))

    return docs.mapInArrow(apply, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model | None:
    may = common.id_bucket(F.col("doc_id"), 5) != 0
    return train(*sample(docs.where(may).select("doc_id", "text"), labels.where(may), config), config)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= F.lit(Config.threshold)).cast("int").alias("predicted"))

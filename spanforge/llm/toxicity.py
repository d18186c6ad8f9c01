"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only documents have labels. A sentence's probability of being toxic is a logistic function of its words; a document's is the noisy-or of its sentences, 1 - prod(1 - p). The weights are trained in numpy by gradients through the noisy-or, from document labels, so that the sentence scores then say where a document offends.

A sentence's features are its words and the beginnings of its words, so that inflected and compounded forms share evidence. Features that are commoner in toxic documents are found by counting over the labelled sample on the executors, and what comes to the driver for training is those features of each sentence that has any.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Config:
    toxic: int = 3000  # labelled documents fitted on, about; at most twice as many
    clean: int = 6000
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    least: int = 4  # documents that a feature must be in
    features: int = 4000
    z: float = 4.0  # by so many standard errors a feature must be commoner in toxic documents
    leak: float = -11.0  # log-odds of a sentence without evidence
    epochs: int = 250
    rate: float = 0.1
    decay: float = 1e-6
    threshold: float = 0.7
    sentence_threshold: float = 0.5
    seed: int = 13


def word_features(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    return [f"{word}.", *(word[:n] for n in prefixes if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float]
    leak: float
    prefixes: tuple[int, ...]


class Scorer:
    """Keeps the weights of words that it has seen, a bounded number."""

    def __init__(self, model: Model | None):
        self.model = model
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 300_000:
                self.known.clear()
            get = self.model.weights.get
            w = self.known[word] = sum(get(x, 0.0) for x in word_features(word, self.model.prefixes))
        return w

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences with any evidence."""
        found = []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m[0].lower()))
            z = sum(map(self.weight, sorted(words)))
            if z:
                found.append((m.start(), m.end(), float(1 / (1 + np.exp(-np.clip(z + self.model.leak, -50, 50))))))
        return found

    def document(self, found: list[tuple[int, int, float]]) -> float:
        """Noisy-or. Sentences without evidence count as clean."""
        return float(1 - np.exp(sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in found)))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        if self.model is None or not text:
            return 0.0, []
        found = self.sentences(text)
        return self.document(found), found


class Features:
    """Those of words that it has seen, a bounded number."""

    def __init__(self, prefixes: tuple[int, ...]):
        self.prefixes = prefixes
        self.known: dict[str, list[str]] = {}

    def of(self, sentence: str) -> set[str]:
        found: set[str] = set()
        for w in WORD.findall(sentence.lower()):
            of_word = self.known.get(w)
            if of_word is None:
                if len(self.known) > 300_000:
                    self.known.clear()
                of_word = self.known[w] = word_features(w, self.prefixes)
            found.update(of_word)
        return found


def strength(in_toxic: float, in_clean: float, n1: float, n0: float) -> float:
    """How many standard errors commoner a feature is in toxic documents, at equal numbers of both."""
    p = (in_toxic + in_clean) / (n1 + n0)
    return (in_toxic / n1 - in_clean / n0) / np.sqrt(p * (1 - p) + 1e-9)


def choose(counts: list[tuple[str, int, int]], n1: int, n0: int, config: Config) -> dict[str, float]:
    """Strengths of the chosen features, the strongest first. counts: (feature, toxic documents with it, clean ones)."""
    enough = config.z / np.sqrt(n1 * n0 / (n1 + n0))
    found = {f: strength(a, b, n1, n0) for f, a, b in counts if a + b >= config.least}
    best = sorted((f for f, z in found.items() if z >= enough), key=lambda f: (-found[f], f))[: config.features]
    return {f: found[f] for f in best}


def evidence(text: str, index: dict[str, int], features: Features) -> list[list[int]]:
    """The chosen features of each sentence that has any."""
    found = []
    for m in SENTENCE.finditer(text):
        ids = sorted(index[f] for f in features.of(m[0]) if f in index)
        if ids:
            found.append(ids)
    return found


def learn(bags: list[list[list[int]]], toxic: list[int], strengths: dict[str, float], config: Config) -> Model:
    """Weights by gradients through the noisy-or. bags: each document's sentences, as numbers of features."""
    y = np.array(toxic, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    rows, cols, owner = [], [], []
    for i, bag in enumerate(bags):
        for ids in bag:
            rows += [len(owner)] * len(ids)
            cols += ids
            owner.append(i)
    rows, cols, owner = np.array(rows, int), np.array(cols, int), np.array(owner, int)
    # Each kind of document weighs as much as it does in a corpus with a tenth of toxic ones.
    weight = np.where(y == 1, 0.1 / n1, 0.9 / n0)
    w = 2 * np.array(list(strengths.values()), float)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, config.epochs + 1):
        g = gradient(w, rows, cols, owner, y, weight, config.leak) + config.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= config.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(x) for f, x in zip(strengths, w) if abs(x) > 1e-3}, config.leak, config.prefixes)


def gradient(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray, leak: float) -> np.ndarray:
    """Of the weighted log-loss of documents: rows and cols are the sentence and feature of each piece of evidence, owner the document of each sentence."""
    z = np.bincount(rows, w[cols], len(owner)) + leak
    p = 0.5 * (1 + np.tanh(z / 2))
    clean = np.exp(np.bincount(owner, -np.logaddexp(0, z), len(y)))
    # d loss / d z of a sentence: p for a clean document, -p * clean / (1 - clean) for a toxic one.
    factor = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * weight
    return np.bincount(cols, (factor[owner] * p)[rows], len(w))


def train(texts: list[str], toxic: list[int], config: Config = Config()) -> Model | None:
    """From texts at hand, as fit() does from tables. None without a toxic and a clean document."""
    n1 = sum(toxic)
    if not 0 < n1 < len(toxic):
        return None
    features = Features(config.prefixes)
    seen: list[Counter] = [Counter(), Counter()]
    for t, label in zip(texts, toxic):
        seen[label].update(features.of(t))
    strengths = choose([(f, seen[1][f], seen[0][f]) for f in sorted(seen[0].keys() | seen[1].keys())], n1, len(toxic) - n1, config)
    index = {f: i for i, f in enumerate(strengths)}
    return learn([evidence(t, index, features) for t in texts], toxic, strengths, config)


def sample(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """(text, y): a bounded sample of labelled documents, those of either kind picked by a hash of the id. A document with both labels counts as toxic; equal rows count once; null texts and ids don't."""
    one = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [common.hash_sample(one.where(F.col("y") == y), F.col("doc_id"), config.seed, bound / max(counts.get(y, 0), 1)).limit(2 * bound) for y, bound in ((1, config.toxic), (0, config.clean))]
    picked = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.where(F.col("text").isNotNull()).join(picked, "doc_id").select("doc_id", "text", "y").distinct().select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model | None:
    """A model of the labelled documents whose ids may be learned from. None without a toxic and a clean one. Their whole texts are read on the executors."""
    spark = docs.sparkSession
    common.prepare(spark)
    may = common.id_bucket(F.col("doc_id"), 3) != 1
    sampled = common.stored(sample(docs.where(may).select("doc_id", "text"), labels.where(may), config))
    n1, n = sampled.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < n1 < n:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen = Features(config.prefixes), Counter()
        for batch in batches:
            for text, y in zip(common.texts(batch.column(0)), batch.column(1).to_pylist()):
                seen.update((f, y) for f in features.of(text))
            if len(seen) > 300_000:
                yield common.like(_COUNTS, [[f for f, _ in seen], [y for _, y in seen], list(seen.values())])
                seen.clear()
        yield common.like(_COUNTS, [[f for f, _ in seen], [y for _, y in seen], list(seen.values())])

    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    counts = sampled.mapInArrow(count, "f string, y int, n long").groupBy("f").agg(of(1).alias("a"), of(0).alias("b"))
    # only features that are commoner in toxic documents can be chosen, the strongest of them
    likely = counts.where((F.col("a") + F.col("b") >= config.least) & (F.col("a") / n1 > F.col("b") / (n - n1)))
    p = (F.col("a") + F.col("b")) / F.lit(float(n))
    z = (F.col("a") / n1 - F.col("b") / (n - n1)) / F.sqrt(p * (F.lit(1.0) - p) + F.lit(1e-9))
    rows = likely.orderBy(z.desc(), "f").limit(2 * config.features).collect()
    strengths = choose([(r["f"], r["a"], r["b"]) for r in rows], n1, n - n1, config)
    sent = common.Shared(spark, {f: i for i, f in enumerate(strengths)})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(config.prefixes)
        for batch in batches:
            yield common.like(_BAGS, [batch.column(1).to_pylist(), [evidence(t, sent.value, features) for t in common.texts(batch.column(0))]])

    bags = sorted((r["y"], r["bag"]) for r in sampled.mapInArrow(look, "y int, bag array<array<int>>").collect())
    return learn([b for _, b in bags], [y for y, _ in bags], strengths, config)


_COUNTS = pa.schema([("f", pa.string()), ("y", pa.int32()), ("n", pa.int64())])
_BAGS = pa.schema([("y", pa.int32()), ("bag", pa.list_(pa.list_(pa.int32())))])


def score(docs: DataFrame, model: Model | None, config: Config = Config(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, spans) of every row: spans are the sentences at or above the sentence threshold, as (start, stop, score) in characters.

    Null and empty texts have score 0; without a model all have. Texts of any length are read whole. Repeated ids and null ids are rows of their own; equal texts have equal scores. An empty table has no row. Other columns aren't read.
    """
    common.prepare(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
    out = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("spans", span)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.score(t) for t in common.texts(batch.column(1))]
            spans = [[{"start": a, "stop": b, "score": p} for a, b, p in f if p >= config.sentence_threshold] for _, f in found]
            yield common.like(out, [batch.column(0).to_pylist(), [s for s, _ in found], spans])

    found = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("t"))
    return found.mapInArrow(apply, "id long, score double, spans array<struct<start:long,stop:long,score:double>>").withColumnRenamed("id", id_column)


def keep(docs: DataFrame, model: Model | None, threshold: float = Config.threshold, text_column: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with all their columns, whatever their ids; rows of one id are judged each by its own text. Null and empty texts stay, as do all rows without a model. An empty table stays empty."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index(text_column)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t)[0] < threshold for t in common.texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= F.lit(Config.threshold)).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))

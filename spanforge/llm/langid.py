"""Language identification by a byte convolutional network.

Filters of several widths slide over the UTF-8 bytes of fixed-length windows; each filter's largest response in a window goes to a softmax. The network is trained in numpy on a bounded sample of labelled windows and applied to every byte of every text, in batches of windows. A text's probabilities come from the mean of its windows' log-probabilities, weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters, and some numbers such as fractions, which aren't.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass(frozen=True)
class Config:
    window: int = 256  # bytes
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 8  # of each width
    embedding: int = 6
    sample_per_language: int = 1500  # labelled windows, at most about twice as many
    window_chars: int = 200  # of a training window
    epochs: int = 14
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x e
    kernel: np.ndarray  # (widest x e) x all filters; narrow filters end in zeros
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    window: int

    @property
    def widest(self) -> int:
        return self.kernel.shape[0] // self.embed.shape[1]

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Every position's bytes, embedded and side by side: windows x positions x (widest * e)."""
        x = self.embed[windows]
        n, length, e = x.shape
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, length - self.widest + 1, self.widest * e), s)
        return np.ascontiguousarray(view)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), 256):
            c = self.columns(windows[at : at + 256])
            pooled = (c.reshape(-1, c.shape[2]) @ self.kernel).reshape(c.shape[0], c.shape[1], -1).max(1)
            logits = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
            logits -= logits.max(1, keepdims=True)
            parts.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def cut_windows(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts as zero-padded windows, with each window's text and number of bytes."""
    sizes = np.array([len(x) for x in data], np.int64)
    counts = -(-sizes // length)
    pad = counts * length - sizes
    flat = np.frombuffer(b"".join(x + bytes(p) for x, p in zip(data, pad.tolist())), np.uint8).reshape(-1, length)
    owner = np.repeat(np.arange(len(data)), counts)
    filled = np.full(len(flat), length, np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    filled[last] -= pad[counts > 0]
    return flat, owner, filled


def train(samples: list[str], labels: list[str], config: Config = Config()) -> Network | None:
    """Adam on cross-entropy. None without a labelled text."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(config.seed)
    n, e, widest = len(languages), config.embedding, max(config.widths)
    encoded = [x.encode("utf-8", "replace")[: config.window] for x in samples]
    x = np.zeros((len(encoded), config.window), np.uint8)
    for i, b in enumerate(encoded):
        x[i, : len(b)] = np.frombuffer(b, np.uint8)
    y = np.searchsorted(languages, labels)
    mask = np.concatenate([np.repeat((np.arange(widest) < w).repeat(e)[:, None], config.filters, 1) for w in config.widths], 1)
    total = mask.shape[1]
    net = Network(languages, rng.normal(0, 0.5, (256, e)).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(total, np.float32), rng.normal(0, 0.2, (total, n)).astype(np.float32), np.zeros(n, np.float32), config.window)
    names = ("embed", "kernel", "bias", "out", "out_bias")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    step = 0
    balance = len(y) / (n * np.bincount(y, minlength=n).clip(1))
    for _ in range(config.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            xb, yb = x[rows], y[rows]
            c = net.columns(xb)
            response = c @ net.kernel
            where = response.argmax(1)
            pooled = np.take_along_axis(response, where[:, None, :], 1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            logits = hidden @ net.out + net.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            d = p * balance[yb][:, None] / len(yb)
            back = (d @ net.out.T) * (pooled > 0)
            chosen = c[np.arange(len(yb))[:, None], where]  # texts x filters x (widest * e)
            g = {"out": hidden.T @ d, "out_bias": d.sum(0), "bias": back.sum(0), "kernel": np.einsum("nf,nfk->kf", back, chosen) * mask}
            g_embed = np.zeros_like(net.embed)
            to_columns = (back[:, :, None] * net.kernel.T[None]).reshape(len(yb), total, widest, e)
            spots = where[:, :, None] + np.arange(widest)
            np.add.at(g_embed, xb[np.arange(len(yb))[:, None, None], spots].ravel(), to_columns.reshape(-1, e))
            g["embed"] = g_embed
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                move = config.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    return net


def predict(net: Network | None, data: list[str]) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text; "und" and 0 where there is no letter or no network."""
    langs, scores = ["und"] * len(data), [0.0] * len(data)
    if net is None:
        return langs, scores
    rows = [i for i, x in enumerate(data) if has_letter(x)]
    group: list[int] = []
    held = 0

    def flush() -> None:
        windows, owner, filled = cut_windows([data[i].encode("utf-8", "replace") for i in group], net.window)
        logs = net.log_probabilities(windows) * filled[:, None]
        sums = np.stack([np.bincount(owner, logs[:, k], len(group)) for k in range(logs.shape[1])], 1)
        mean = sums / np.bincount(owner, filled, len(group))[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, k, row in zip(group, p.argmax(1), p):
            langs[i], scores[i] = net.languages[k], float(row[k])

    for i in rows:
        group.append(i)
        held += len(data[i])
        if held > 1 << 20:
            flush()
            group, held = [], 0
    if group:
        flush()
    return langs, scores


def sample(docs: DataFrame, config: Config = Config()) -> tuple[list[str], list[str]]:
    """A bounded, repeatable sample of labelled windows, alike in size for each language.

    docs needs doc_id, text and lang. Rows are picked by a hash of the text, so that extra copies add nothing. Of each picked text one window of window_chars characters is fitted on, which begins at a place that the hash picks: a bound of the sample, not of what is identified. Null languages and texts without a letter aren't learned from; a text under two languages is learned as both.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    scale = 1 << 30
    limit = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, int(scale * min(1.0, config.sample_per_language / n)))])
    h = F.xxhash64(F.col("text"), F.lit(config.seed))
    room = F.greatest(F.length("text") - F.lit(config.window_chars), F.lit(0)) + F.lit(1)
    picked = known.where(F.pmod(h, F.lit(scale)) < limit[F.col("lang")]).select("lang", F.substring("text", (F.pmod(F.shiftrightunsigned(h, 30), room) + F.lit(1)).cast("int"), F.lit(config.window_chars)).alias("text"))
    rows = picked.distinct().limit(2 * config.sample_per_language * len(counts)).collect()
    rows = sorted((r["lang"], r["text"]) for r in rows if has_letter(r["text"]))
    return [t for _, t in rows], [lang for lang, _ in rows]


def identify(docs: DataFrame, net: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; columns besides these two aren't read.

    A null text has no letter, and texts without one are "und" with score 0, as all are without a network. Of languages equally likely the first by name is taken. Texts of any length are read whole. Repeated ids and null ids are rows of their own. An empty table has no row.
    """
    common.prepare(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(net, common.texts(batch.column(1)))
            yield common.like(schema, [batch.column(0).to_pylist(), langs, scores])

    found = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("t"))
    return found.mapInArrow(apply, "id long, lang_pred string, score double").withColumnRenamed("id", id_column)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(*sample(docs.where(common.id_bucket(F.col("doc_id"), 5) != 0)))
    out = identify(docs, net)
    return out.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")

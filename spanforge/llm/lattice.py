"""Language-model scoring by subword lattice likelihood.

The model is a unigram distribution over the pieces of an existing subword vocabulary, a byte for each byte value, and an end. A text's probability sums over all of its segmentations into pieces, by a forward recursion in log space. No piece spans a space, so the lattice of a text falls apart into those of its words, and each different word is worked out once.

The vocabulary's own scores give the first distribution: pieces are taken to follow a power law in the order of their scores (files of pair merges have ranks for scores, not log-probabilities). One pass of expectation-maximisation over the counted words of the training texts then fits it to the corpus. The vocabulary itself isn't changed.

Words are counted over the whole corpus. The commonest words, a bounded number, are broadcast with their scores; all others are joined by a shuffle, in which no word can be hot, as the common ones are gone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
START = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Config:
    vocabulary: str = VOCABULARY  # a sentencepiece model; only the driver reads it
    common_words: int = 150_000  # broadcast, at most
    counted_at_once: int = 400_000  # different words a task holds before it passes their counts on,
    counted_bytes: int = 64 << 20  # or so many bytes of text, whichever comes first: words may be long
    passes: int = 1  # of expectation-maximisation


def words(text: str) -> list[bytes]:
    """In UTF-8; bytes are split at the ASCII white space 0x20 and 0x09 to 0x0D."""
    return text.encode("utf-8", "replace").translate(LOWER).split()


Trie = dict[str, tuple["Trie", int]]


@dataclass
class Lattice:
    """trie: for each character what may follow it, and the number of the piece that ends there, or -1. Numbers 0 to 255 are bytes, 256 is the end and 257 the bare mark of a word's start."""

    trie: Trie
    logs: list[float]
    spelling: dict[str, float] = field(default_factory=dict)

    @property
    def end(self) -> float:
        return self.logs[256]

    def with_logs(self, logs) -> Lattice:
        return Lattice(self.trie, [float(x) for x in logs])

    def spelled(self, char: str) -> float:
        """Log-probability of a character as bytes."""
        found = self.spelling.get(char)
        if found is None:
            if len(self.spelling) > 100_000:
                self.spelling.clear()
            found = self.spelling[char] = sum(self.logs[b] for b in char.encode("utf-8", "replace"))
        return found

    def edges(self, s: str) -> list[tuple[int, int, int, float]]:
        """(from, to, piece, log-probability) by their start. Each character may be spelled (piece -1); the mark of the start is a piece of its own."""
        out = []
        root, logs, n = self.trie, self.logs, len(s)
        for i in range(n):
            out.append((i, i + 1, -1, self.spelled(s[i])) if i else (0, 1, 257, logs[257]))
            node = root
            for j in range(i, n):
                step = node.get(s[j])
                if step is None:
                    break
                node, k = step
                if k >= 0:
                    out.append((i, j + 1, k, logs[k]))
        return out

    def forward(self, word: str) -> float:
        """Natural logarithm of the word's probability, over all segmentations."""
        s = START + word
        n = len(s)
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        root, logs, exp, log1p, spelling = self.trie, self.logs, math.exp, math.log1p, self.spelling
        for i in range(n):
            a = alpha[i]
            if i:
                c = s[i]
                x = spelling.get(c)
                x = a + (self.spelled(c) if x is None else x)
            else:
                x = logs[257]
            b = alpha[i + 1]
            alpha[i + 1] = x if b is None else b + log1p(exp(x - b)) if b >= x else x + log1p(exp(b - x))
            node = root
            j = i
            while j < n:
                step = node.get(s[j])
                if step is None:
                    break
                j += 1
                node, k = step
                if k >= 0:
                    x = a + logs[k]
                    b = alpha[j]
                    alpha[j] = x if b is None else b + log1p(exp(x - b)) if b >= x else x + log1p(exp(b - x))
        return alpha[n]

    def expect(self, word: str, weight: float, totals: np.ndarray | list[float]) -> None:
        """Adds the expected number of uses of each piece, times the weight: forward and backward over the same edges."""
        s = START + word
        n = len(s)
        edges = self.edges(s)
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for i, j, _, p in edges:
            x = alpha[i] + p
            b = alpha[j]
            alpha[j] = x if b is None else b + log1p(exp(x - b)) if b >= x else x + log1p(exp(b - x))
        # The weight that passes through each place goes back along the edges into it, by their shares of its forward sum.
        passes = [0.0] * (n + 1)
        passes[n] = weight
        for i, j, k, p in reversed(edges):
            x = passes[j]
            if x:
                x *= exp(alpha[i] + p - alpha[j])
                passes[i] += x
                if k >= 0:
                    totals[k] += x
                else:
                    for b in s[i].encode("utf-8", "replace"):
                        totals[b] += x


def load(config: Config = Config()) -> Lattice:
    """The file's pieces with the distribution that its scores give."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=config.vocabulary)
    scored = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            if START not in piece[1:] and piece == piece.encode().translate(LOWER).decode() and len(piece.encode().split()) == 1:
                scored.append((-model.get_score(i), piece))
    return from_pieces([p for _, p in sorted(scored)])


def from_pieces(pieces: list[str]) -> Lattice:
    """Pieces from the commonest to the rarest. Piece r weighs 1 / (r + 10); all bytes together, the end and the bare mark of a start weigh as much as some pieces."""
    trie: Trie = {}
    weights = [0.002] * 256 + [0.05, 0.05]
    for piece in pieces:
        if piece == START:
            continue
        node = trie
        for c in piece[:-1]:
            if c not in node:
                node[c] = ({}, -1)
            node = node[c][0]
        below = node[piece[-1]][0] if piece[-1] in node else {}
        node[piece[-1]] = (below, len(weights))
        weights.append(1 / (len(weights) - 258 + 10))
    total = sum(weights)
    return Lattice(trie, [math.log(w / total) for w in weights])


def count_words(docs: DataFrame, train, config: Config, id_column: str, text_column: str) -> DataFrame:
    """(word, c, n): times in training documents, and in all. One row a word."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("n", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_train, others = Counter(), Counter()
        held = 0

        def emit() -> pa.RecordBatch:
            both = list(of_train.keys() | others.keys())
            out = common.like(schema, [both, [of_train[w] for w in both], [of_train[w] + others[w] for w in both]])
            of_train.clear()
            others.clear()
            return out

        for batch in batches:
            for text, learn in zip(common.texts(batch.column(0)), batch.column(1).to_pylist()):
                (of_train if learn else others).update(words(text))
                held += len(text)
                if held > config.counted_bytes or len(of_train) + len(others) > config.counted_at_once:
                    yield emit()
                    held = 0
        yield emit()

    parts = docs.select(F.col(text_column).alias("t"), train.alias("learn")).mapInArrow(apply, "word string, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(counted: DataFrame, ends: int, lattice: Lattice, config: Config) -> Lattice:
    """Expectation-maximisation over the counted training words; every piece gets one use besides. What comes to the driver is a row for each piece."""
    size = len(lattice.logs)
    schema = pa.schema([("k", pa.int64()), ("x", pa.float64())])
    for _ in range(config.passes):
        sent = common.Shared(counted.sparkSession, lattice)

        def apply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            totals = [0.0] * size
            model = sent.value
            for batch in batches:
                for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    model.expect(word, c, totals)
            used = [k for k, x in enumerate(totals) if x]
            yield common.like(schema, [used, [totals[k] for k in used]])

        rows = counted.where(F.col("c") > 0).select("word", "c").mapInArrow(apply, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        totals = np.ones(size)
        for r in rows:
            totals[r["k"]] += r["x"]
        totals[256] += ends
        lattice = lattice.with_logs(np.log(totals / totals.sum()))
    return lattice


def score(docs: DataFrame, train, config: Config = Config(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    train is a condition: which rows to learn from. Tokens are words and one end for each text. base_score is the add-one log10 probability of the tokens, score that of the lattice model. A null text is empty: only its end counts. Repeated ids are rows of their own. Without a training row no token is known and the pieces keep their first distribution. Other columns aren't read.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    slim = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("t"), F.coalesce(train, F.lit(False)).alias("learn"))
    counted = common.stored(count_words(slim, F.col("learn"), config, "id", "t"))
    ends = slim.where("learn").count()
    facts = counted.agg(F.sum("c").alias("tokens"), F.count_if(F.col("c") > 0).alias("types")).first()
    tokens, types = (facts["tokens"] or 0) + ends, (facts["types"] or 0) + (ends > 0)
    below = math.log10(tokens + types + 1)
    lattice = fit(counted, ends, load(config), config)
    sent = common.Shared(spark, lattice)

    scored_schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("known", pa.bool_()), ("base", pa.float64()), ("log", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            ws, c = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            logs = np.array([model.forward(w) for w in ws]) / math.log(10)
            yield common.like(scored_schema, [ws, batch.column(2).to_pylist(), c > 0, np.log10(c + 1.0) - below, logs])

    scored = common.stored(counted.mapInArrow(apply, "word string, n long, known boolean, base double, log double"))

    # The commonest words: all that occur at least so often that no more than common_words do.
    level = (F.floor(F.log2("n") * 8)).cast("int")
    held, least = 0, None
    for r in sorted(scored.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["level"]):
        held += r["words"]
        if held > config.common_words:
            break
        least = r["level"]
    top = scored.where(level >= F.lit(least)).collect() if least is not None else []
    table = common.Shared(spark, {r["word"].encode(): (r["known"], r["base"], r["log"]) for r in top})
    end = (ends > 0, math.log10(ends + 1) - below, lattice.end / math.log(10))

    rows_schema = pa.schema([("row", pa.int64()), ("word", pa.string()), ("times", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("log", pa.float64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        # Rows of a text meet again under a number that a rerun of the task gives again.
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = batch.column(0)
            rare_rows, rare_words, rare_times = [], [], []
            first, sums = row, []
            for text in common.texts(batch.column(1)):
                found = words(text)
                n_known, base, log = int(end[0]), end[1], end[2]
                before = len(rare_words)
                for w, k in Counter(found).items():
                    hit = known.get(w)
                    if hit is None:
                        rare_words.append(w)
                        rare_times.append(k)
                    else:
                        n_known += k * hit[0]
                        base += k * hit[1]
                        log += k * hit[2]
                rare_rows += [row] * (len(rare_words) - before)
                sums.append((len(found) + 1, n_known, base, log))
                row += 1
            # A space is in no word, so these rows meet no word in the join below, and rows like them are spread.
            texts_ = [*range(first, row)]
            yield common.like(rows_schema, [texts_, [f" {r}" for r in texts_], [0] * len(texts_), ids.to_pylist(), *([x[i] for x in sums] for i in range(4))])
            n = len(rare_words)
            for at in range(0, n, 100_000):
                m = min(100_000, n - at)
                zero, none = pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.int64())
                flat = pa.array(np.zeros(m))
                yield pa.RecordBatch.from_arrays([pa.array(rare_rows[at : at + m], pa.int64()), pa.array(rare_words[at : at + m], pa.string()), pa.array(rare_times[at : at + m], pa.int64()), none, zero, zero, flat, flat], schema=rows_schema)

    parts = slim.select("id", "t").mapInArrow(split, "row long, word string, times long, id long, n_tokens long, n_known long, base double, log double")
    rare = scored.where(level < F.lit(least)) if least is not None else scored
    rare = rare.select("word", "known", F.col("base").alias("w_base"), F.col("log").alias("w_log"))
    joined = parts.join(rare, "word", "left").select(
        "row",
        "id",
        "n_tokens",
        (F.col("n_known") + F.when(F.col("known"), F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("times") * F.coalesce("w_base", F.lit(0.0))).alias("base"),
        (F.col("log") + F.col("times") * F.coalesce("w_log", F.lit(0.0))).alias("log"),
    )
    sums = joined.groupBy("row").agg(F.max("id").alias("id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "log")])
    return sums.select(F.col("id").alias(id_column), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("log").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, common.id_bucket(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", common.held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token counts are raked: scaled in turn so that the sums over each source, each language and each topic meet their targets, until none moves. A cell's fitted tokens over its actual ones weigh its documents, and documents are sampled with probabilities in proportion to their weights, calibrated so that the expected number of tokens is a given share of all: probabilities stop at 1, and what that leaves over is spread over the rest.

Sampling compares a probability with a hash of the document's id, so that a rerun of a task, or another order of rows, picks the same documents.

Cells are fitted as arrays on the driver while there are few. A dimension of very many values, such as hosts as sources, is fitted where it lies: a fitted cell is its tokens times one factor for each of its values, so a table with one row a value, which holds its cells, finds its own factors from those of the other dimensions, and only sums by the other dimensions' values come back.

Topics are clusters of texts: spherical k-means over hashed word counts, trained on all texts, whose counts are stored once and read in each round.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .decontam import WORDS

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Config:
    share: float = 0.5  # of all tokens that the sample is expected to have
    #: Target share of the tokens of each value of a dimension. Where a dimension isn't given, its present shares to the power `temper`, normalised: large ones shrink, small ones grow.
    targets: dict[str, dict[str | None, float]] = field(default_factory=dict)
    temper: float = 0.7
    rounds: int = 200
    tolerance: float = 1e-9
    topics: int = 6
    buckets: int = 128  # of hashed words
    cells: int = 500_000  # most combinations of values that are fitted on the driver; more are fitted in tables
    seed: int = 17


def counts(text: str, buckets: int, cache: dict[bytes, int]) -> np.ndarray:
    """Hashed word counts of the whole text."""
    words = text.encode("utf-8", "replace").translate(WORDS).split()
    if len(cache) > 300_000:
        cache.clear()
    get = cache.get
    ids = []
    for w in words:
        k = get(w)
        if k is None:
            k = cache[w] = zlib.crc32(w) % buckets
        ids.append(k)
    return np.bincount(np.array(ids, int), minlength=buckets)


def vector(text: str, buckets: int, cache: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Square roots of hashed word counts at length 1, and the number of words, of the whole text."""
    found = counts(text, buckets, cache)
    n = int(found.sum())
    if not n:
        return np.zeros(buckets), 0
    x = np.sqrt(found)
    return x / np.linalg.norm(x), n


def train_topics(x: np.ndarray, config: Config = Config()) -> np.ndarray:
    """Centres, one a row. Fewer texts than topics give as many centres as texts."""
    x = x[np.abs(x).sum(1) > 0]
    if not len(x):
        return np.zeros((1, config.buckets))
    rng = np.random.default_rng(config.seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(min(config.topics, len(x)) - 1):
        far = 1 - np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(np.argmax(far * rng.random(len(x))))])
    c = np.array(centres)
    for _ in range(30):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.array([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))])
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return c


def topics(docs: DataFrame, config: Config = Config()) -> np.ndarray:
    """As train_topics() over every text with words. Word counts are stored; each round reads them, and only sums by centre come back. The rounds end when the centres stand."""
    spark = docs.sparkSession
    common.prepare(spark)
    stored = pa.schema([("counts", pa.binary()), ("u", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            found = [(counts(t, config.buckets, cache), u) for t, u in zip(common.texts(batch.column(0)), batch.column(1).to_pylist())]
            found = [(c.astype("<i4").tobytes(), u) for c, u in found if c.any()]
            yield common.like(stored, [[c for c, _ in found], [u for _, u in found]])

    number = F.shiftrightunsigned(F.xxhash64("text", F.lit(config.seed)), 11) / F.lit(float(1 << 53))
    texts = common.stored(docs.where("text IS NOT NULL").select("text", number.alias("u")).mapInArrow(count, "counts binary, u double"))

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        x = np.sqrt(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(-1, config.buckets))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    best = pa.schema([("score", pa.float64()), ("x", pa.list_(pa.float64()))])
    sums = pa.schema([("k", pa.int32()), ("x", pa.list_(pa.float64()))])

    def furthest(c: np.ndarray) -> Callable:
        """Of each part, the text that is furthest from the centres, by chance; without any, the first by chance."""

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = (-1.0, None)
            for batch in batches:
                if batch.num_rows:
                    x, u = vectors(batch), np.array(batch.column(1).to_pylist())
                    score = np.round(np.maximum(1 - np.max(x @ c.T, axis=1), 0), 9) * u if len(c) else u
                    i = int(np.argmax(score))
                    top = max(top, (float(score[i]), x[i].tolist()), key=lambda y: (y[0], y[1] or []))
            if top[1]:
                yield common.like(best, [[top[0]], [top[1]]])

        return apply

    def moved(c: np.ndarray) -> Callable:
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(c), np.zeros(len(c), int)
            for batch in batches:
                if batch.num_rows:
                    x = vectors(batch)
                    near = np.argmax(np.round(x @ c.T, 9), axis=1)
                    of = (near == np.arange(len(c))[:, None]).astype(float)
                    total += of @ x
                    n += of.sum(1).astype(int)
            yield common.like(sums, [np.flatnonzero(n).tolist(), total[n > 0].tolist()])

        return apply

    c = np.zeros((0, config.buckets))
    while len(c) < config.topics:
        found = texts.mapInArrow(furthest(c), "score double, x array<double>").collect()
        top = max(found, key=lambda r: (r["score"], r["x"]), default=None)
        if top is None or (len(c) and not top["score"] > 0):
            break
        c = np.vstack([c, top["x"]])
    if not len(c):
        return np.zeros((1, config.buckets))
    for _ in range(30):
        total = np.zeros_like(c)
        for r in texts.select("counts").mapInArrow(moved(c), "k int, x array<double>").collect():
            total[r["k"]] += r["x"]
        total = np.where(np.abs(total).sum(1, keepdims=True) > 0, total, c)
        last, c = c, np.round(total / np.linalg.norm(total, axis=1, keepdims=True), 12)
        if np.abs(c - last).max() < 1e-9:
            break
    return c


def nearest(vectors: list[np.ndarray], centres: np.ndarray, config: Config) -> list[str]:
    """Names of the topics; of equally near ones the first."""
    x = np.array(vectors).reshape(-1, config.buckets)
    return [f"t{k}" for k in np.argmax(np.round(x @ centres.T, 9), axis=1).tolist()]


def describe(docs: DataFrame, centres: np.ndarray, config: Config = Config()) -> DataFrame:
    """(id, source, lang, topic, tokens, u) of every row, topic as text, u the number that it is sampled by. A null text has no words and the first topic."""
    schema = pa.schema([("id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("topic", pa.string()), ("tokens", pa.int64()), ("u", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            found = [vector(t, config.buckets, cache) for t in common.texts(batch.column(1))]
            near = nearest([f[0] for f in found], centres, config)
            yield common.like(schema, [batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), near, [f[1] for f in found], batch.column(4).to_pylist()])

    slim = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"), F.col("lang").cast("string"), draw(config).alias("u"))
    return slim.mapInArrow(apply, "id long, source string, lang string, topic string, tokens long, u double")


def tempered(shares: dict, temper: float) -> dict:
    raised = {k: v**temper for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def _order(value: str | None) -> tuple[bool, str]:
    return value is not None, value or ""


def rake(cells: dict[tuple, float], targets: dict[int, dict], rounds: int = 200, tolerance: float = 1e-9) -> dict[tuple, float]:
    """Fitted cells whose marginal shares meet the targets as far as the cells allow; they sum to 1.

    cells: tokens by (value of each dimension); those without tokens stay at zero. targets: for each dimension's place, a share for each value; values without a target get nothing, and targets of values without tokens are spread over the others.
    """
    keys = sorted(cells, key=lambda c: tuple(map(_order, c)))
    x = np.array([float(cells[k]) for k in keys])
    if not x.sum():
        return {k: 0.0 for k in keys}
    x = x / x.sum()
    parts = []
    for d, target in sorted(targets.items()):
        values = sorted({k[d] for k in keys}, key=_order)
        place = {v: i for i, v in enumerate(values)}
        of = np.array([place[k[d]] for k in keys])
        have = np.bincount(of, x, len(values))
        want = np.where(have > 0, [max(target.get(v, 0.0), 0.0) for v in values], 0.0)
        if want.sum() > 0:
            parts.append((of, want / want.sum()))
    for _ in range(rounds):
        moved = 0.0
        for of, want in parts:
            have = np.bincount(of, x, len(want))
            factor = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            moved = max(moved, np.abs(want - have).max())
            x = x * factor[of]
            x = x / x.sum() if x.sum() else x
        if moved < tolerance:
            break
    return dict(zip(keys, x.tolist()))


def calibrate(cells: dict[tuple, float], fitted: dict[tuple, float], share: float) -> dict[tuple, float]:
    """Sampling probability of each cell: in proportion to fitted over actual tokens, at most 1, and such that the expected tokens are `share` of all where the cells with any weight have so many."""
    keys = list(cells)
    n = np.array([float(cells[k]) for k in keys])
    w = np.array([fitted[k] / cells[k] if cells[k] else 0.0 for k in keys])
    wanted = min(share * n.sum(), n[w > 0].sum())
    p, full = np.zeros(len(keys)), np.zeros(len(keys), bool)
    while wanted > 0:
        rest = (n * w)[~full].sum()
        if rest <= 0:
            break
        scale = (wanted - n[full].sum()) / rest
        p = np.where(full, 1.0, w * scale)
        over = ~full & (p > 1)
        if not over.any():
            break
        full |= over
    return dict(zip(keys, np.clip(p, 0, 1).tolist()))


def _targets(present: dict[int, dict], config: Config) -> dict[int, dict]:
    return {i: config.targets.get(d) or tempered(present[i], config.temper) for i, d in enumerate(DIMENSIONS)}


def weigh(counted: DataFrame, config: Config = Config()) -> dict[tuple, tuple[float, float]] | DataFrame:
    """Weight and probability of each cell. counted: (source, lang, topic, n).

    A dictionary where there are at most config.cells, else a table (source, lang, topic, weight, probability).
    """
    counted = common.stored(counted)
    rows = counted.limit(config.cells + 1).collect()
    if len(rows) > config.cells:
        return _weigh_in_tables(counted, config)
    cells = {tuple(r[d] for d in DIMENSIONS): float(r["n"]) for r in rows}
    total = sum(cells.values()) or 1.0
    present: dict[int, dict] = {}
    for i in range(len(DIMENSIONS)):
        present[i] = {}
        for k in sorted(cells, key=lambda c: tuple(map(_order, c))):
            present[i][k[i]] = present[i].get(k[i], 0.0) + cells[k] / total
    fitted = rake(cells, _targets(present, config), config.rounds, config.tolerance)
    chance = calibrate(cells, fitted, config.share)
    return {k: (fitted[k] * total / cells[k] if cells[k] else 0.0, chance[k]) for k in cells}


def _weigh_in_tables(counted: DataFrame, config: Config) -> DataFrame:
    """The same fit with one dimension, that of the most values, left in a table of a row a value."""
    spark = counted.sparkSession
    many = max(range(len(DIMENSIONS)), key=lambda i: counted.select(F.col(DIMENSIONS[i])).distinct().count())
    rest = [i for i in range(len(DIMENSIONS)) if i != many]
    total = float(counted.agg(F.sum("n")).first()[0] or 0) or 1.0
    small = {i: {r[0]: float(r[1]) / total for r in counted.groupBy(DIMENSIONS[i]).agg(F.sum("n")).collect()} for i in rest}
    given = config.targets.get(DIMENSIONS[many])
    grouped = counted.groupBy(F.col(DIMENSIONS[many]).alias("v")).agg(F.collect_list(F.struct(*[F.col(DIMENSIONS[i]).cast("string").alias(f"d{j}") for j, i in enumerate(rest)], F.col("n").cast("double").alias("n"))).alias("cells"), F.sum("n").cast("double").alias("n"))
    if given:
        wanted = spark.createDataFrame([(v, float(t)) for v, t in given.items()], "w string, want double")
        grouped = grouped.join(wanted, F.col("v").cast("string").eqNullSafe(F.col("w")), "left").withColumn("want", F.when(F.col("n") > 0, F.greatest(F.coalesce("want", F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
    else:
        grouped = grouped.withColumn("want", F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(total), F.lit(config.temper))).otherwise(0.0))
    grouped = common.stored(grouped.select("v", "cells", "want"))
    scale = float(grouped.agg(F.sum("want")).first()[0] or 0)
    want = {}
    for i in rest:
        target = config.targets.get(DIMENSIONS[i]) or tempered(small[i], config.temper)
        has = {v: max(target.get(v, 0.0), 0.0) if x > 0 else 0.0 for v, x in small[i].items()}
        norm = sum(has.values())
        want[i] = {v: x / norm for v, x in has.items()} if norm else None
    factors = [{v: 1.0 for v in small[i]} for i in rest]

    def own(row, factors):
        """A value's own factor, and its cells under all factors."""
        parts = [c["n"] / total * factors[0][c["d0"]] * factors[1][c["d1"]] for c in row["cells"]]
        have = sum(parts)
        if not scale:
            return 1.0, parts
        a = row["want"] / scale / have if have else 0.0
        return a, [a * x for x in parts]

    sums = pa.schema([("v", pa.string()), ("x", pa.float64())])

    def totals(j: int) -> dict:
        """Sums by the values of a small dimension, when the large one is met."""
        sent = common.Shared(spark, [dict(f) for f in factors])

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict = {}
            for batch in batches:
                for row in batch.to_pylist():
                    for c, x in zip(row["cells"], own(row, sent.value)[1]):
                        found[c[f"d{j}"]] = found.get(c[f"d{j}"], 0.0) + x
            yield common.like(sums, [list(found), list(found.values())])

        got = grouped.mapInArrow(apply, "v string, x double").groupBy("v").agg(F.sum("x").alias("x")).collect()
        return {r["v"]: r["x"] for r in got}

    for _ in range(config.rounds):
        moved = 0.0
        for j, i in enumerate(rest):
            if want[i] is None:
                continue
            have = totals(j)
            moved = max(moved, max(abs(want[i][v] - have.get(v, 0.0)) for v in want[i]))
            factors[j] = {v: f * (want[i][v] / have[v] if have.get(v) else 0.0) for v, f in factors[j].items()}
        if moved < config.tolerance:
            break

    sent = common.Shared(spark, [dict(f) for f in factors])
    each = pa.schema([("v", pa.string()), ("d0", pa.string()), ("d1", pa.string()), ("n", pa.float64()), ("w", pa.float64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row["v"], c["d0"], c["d1"], c["n"], x * total / c["n"] if c["n"] else 0.0) for row in batch.to_pylist() for c, x in zip(row["cells"], own(row, sent.value)[1])]
            yield common.like(each, [[r[k] for r in out] for k in range(5)])

    fitted = common.stored(grouped.withColumn("v", F.col("v").cast("string")).mapInArrow(spread, "v string, d0 string, d1 string, n double, w double"))
    reach = fitted.agg(F.sum(F.when(F.col("w") > 0, F.col("n")))).first()[0] or 0.0
    wanted, factor, cut = min(config.share * total, reach), 0.0, float("inf")
    while wanted > 0:
        # cells above the cut are taken whole; the cut falls until no more reach probability 1
        full, some = fitted.agg(F.sum(F.when(F.col("w") >= cut, F.col("n"))), F.sum(F.when(F.col("w") < cut, F.col("n") * F.col("w")))).first()
        if not some:
            break
        factor = (wanted - (full or 0.0)) / some
        lower = 1 / factor if factor > 0 else cut
        if lower >= cut or not fitted.where((F.col("w") < cut) & (F.col("w") > lower)).limit(1).count():
            break
        cut = lower
    chance = F.when(F.col("w") >= cut, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("w") * F.lit(factor)))
    names = {DIMENSIONS[many]: "v", DIMENSIONS[rest[0]]: "d0", DIMENSIONS[rest[1]]: "d1"}
    return fitted.select(*[F.col(names[d]).alias(d) for d in DIMENSIONS], F.col("w").alias("weight"), chance.alias("probability"))


def draw(config: Config, id_column: str = "doc_id", text_column: str = "text"):
    """A number in [0, 1) for each row, by its id, or by its text where that is null: rows with equal ones get the same."""
    of = F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text "), F.col(text_column)), F.lit("")), F.lit(config.seed))
    return F.shiftrightunsigned(of, 11) / F.lit(float(1 << 53))


def _cells_table(spark, chance) -> DataFrame:
    """(c_source, c_lang, c_topic, weight, probability), broadcast where it is small."""
    if isinstance(chance, DataFrame):
        return chance.withColumnsRenamed({d: f"c_{d}" for d in DIMENSIONS})
    known = [(*k, *v) for k, v in chance.items()]
    table = spark.createDataFrame(known, "c_source string, c_lang string, c_topic string, weight double, probability double")
    return F.broadcast(table) if len(known) <= 100_000 else table


def _same() -> object:
    on = [F.col(d).eqNullSafe(F.col(f"c_{d}")) for d in DIMENSIONS]
    return on[0] & on[1] & on[2]


def _fitted(docs: DataFrame, config: Config):
    centres = topics(docs, config)
    told = common.stored(describe(docs, centres, config))
    return centres, told, weigh(told.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("n")), config)


def mixed(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, sampled) of every row.

    docs needs doc_id, text, source and lang. Null sources and languages are values of their own. Documents without words are in no cell's count; they get the probability of their cell, or 0 in a cell without any token. A row is sampled if its probability is above a number that a hash of its id gives, or of its text where the id is null; so repeated rows are sampled together, and rows of one id in different cells each by their own probability. Of topics equally near, the first is taken. Texts of any length are counted whole. An empty table has no row. Other columns aren't read.
    """
    _, told, chance = _fitted(docs, config)
    rows = told.join(_cells_table(docs.sparkSession, chance), _same())
    return rows.select(F.col("id").alias("doc_id"), *DIMENSIONS, "tokens", "weight", "probability", (F.col("u") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of docs that mixed() marks as sampled, with all their columns, whatever their ids.

    Topics are found again where the rows are, so that texts aren't shuffled.
    """
    spark = docs.sparkSession
    centres, _, chance = _fitted(docs, config)
    at = {c: docs.columns.index(c) for c in ("text", "source", "lang")}
    with_number = docs.select("*", draw(config).alias("__spanforge_u"))
    if isinstance(chance, DataFrame):
        marked = T.StructType([*docs.schema.fields, T.StructField("__spanforge_u", T.DoubleType()), T.StructField("__spanforge_t", T.StringType())])

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[bytes, int] = {}
            for batch in batches:
                near = nearest([vector(t, config.buckets, cache)[0] for t in common.texts(batch.column(at["text"]))], centres, config)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.string())], names=[*batch.schema.names, "__spanforge_t"])

        rows = with_number.mapInArrow(mark, marked)
        table = chance.withColumnsRenamed({d: f"__spanforge_{d}" for d in DIMENSIONS}).withColumnRenamed("probability", "__spanforge_p").drop("weight")
        on = rows["source"].cast("string").eqNullSafe(F.col("__spanforge_source")) & rows["lang"].cast("string").eqNullSafe(F.col("__spanforge_lang")) & (F.col("__spanforge_t") == F.col("__spanforge_topic"))
        return rows.join(table, on).where(F.col("__spanforge_u") < F.col("__spanforge_p")).select(*[rows[c] for c in docs.columns])
    sent = common.Shared(spark, {k: p for k, (_, p) in chance.items()})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            near = nearest([vector(t, config.buckets, cache)[0] for t in common.texts(batch.column(at["text"]))], centres, config)
            cells = zip(*(batch.column(at[c]).cast(pa.string()).to_pylist() for c in ("source", "lang")), near)
            u = batch.column(len(batch.columns) - 1).to_pylist()
            keep = pa.array([x < sent.value.get(c, 0.0) for x, c in zip(u, cells)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(keep)

    return with_number.mapInArrow(pick, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))

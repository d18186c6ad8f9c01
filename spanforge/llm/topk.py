"""Exact top-k search by inner product, with the three-phase uniform threshold method.

A vector's dimensions are cut into m blocks; a block ranks rows by its share of the score, so each partition holds m local score lists for each query.

1. A small part of the rows, picked by a hash of their ids, is scored whole, and each partition gathers the list of its k best for each query. The k-th best of all is a floor: no row below it can be among a query's k best.
2. The floors, one number for each query, are broadcast as a safe cutoff. A row that reaches the floor has a share of at least floor / m, the uniform threshold, in some list. All lists but the last are looked at, and entries are collected that reach the threshold in one of them, or may in the last by the length of its vectors, and whose sum so far may still reach the floor by that length.
3. For these entries alone the missing share is worked out, which gives their exact scores, and those that reach the floor go on: at most k of a partition, and of all partitions only as many as the floor lets through.

The rows are looked at in waves, each sixteen times as large as all before it, with the floors of the waves before it. So every row is scored once, and of each wave about 16 k entries a query are sent, however many partitions there are. Nothing is approximate.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Config:
    k: int = 20
    blocks: int = 4  # of dimensions
    queries: int = 16_384  # sent to the executors at once
    query_tile: int = 1024  # scored at once
    tile: int = 2048  # rows scored at once
    first: int = 4096  # rows of the first wave, about
    growth: int = 16  # of a wave over all before it
    sparse: float = 0.05  # share of entries up to which they are resolved one by one


def _cuts(width: int, blocks: int) -> list[slice]:
    edges = [width * i // blocks for i in range(blocks + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, in order of id; shorter vectors end in zeros."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    column = batch.column(1)
    sizes = np.diff(column.offsets.to_numpy())
    x = np.zeros((len(ids), width))
    values = column.flatten().to_numpy(zero_copy_only=False)
    x[np.arange(width)[None, :] < sizes[:, None]] = values
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q.T, exact for integers: doubles while all sums fit them, else 64-bit integers."""
    if x.size and q.size and np.abs(x).max() * np.abs(q).max() * x.shape[1] >= 2.0**53:
        return np.einsum("ik,jk->ij", x.astype(np.int64), q.astype(np.int64))
    return x @ q.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to smaller ids."""
    if len(ids) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = scores >= floor
        ids, scores = ids[few], scores[few]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class _Tiles:
    """The rows of a partition in tiles of a bounded size."""

    def __init__(self, batches: Iterator[pa.RecordBatch], width: int, tile: int):
        self.batches, self.width, self.tile = batches, width, tile

    def __iter__(self):
        ids, xs, held = [], [], 0
        for batch in self.batches:
            i, x = _matrix(batch, self.width)
            ids.append(i)
            xs.append(x)
            held += len(i)
            if held >= self.tile:
                yield np.concatenate(ids), np.concatenate(xs)
                ids, xs, held = [], [], 0
        if held:
            yield np.concatenate(ids), np.concatenate(xs)


def _merge(best: dict[int, tuple[np.ndarray, np.ndarray]], j: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    if j in best:
        ids, scores = np.concatenate([best[j][0], ids]), np.concatenate([best[j][1], scores])
    best[j] = _best(ids, scores, k)


_SCHEMA = pa.schema([("j", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
_SPARK_SCHEMA = "j long, ids array<long>, scores array<long>"


def _emit(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    js = sorted(best)
    return common.like(_SCHEMA, [js, [best[j][0].tolist() for j in js], [best[j][1].astype(np.int64).tolist() for j in js]])


def collected(x: np.ndarray, q: np.ndarray, floors: np.ndarray, cuts: list[slice]) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: (which entries of rows x queries may reach the floors, their sums over all blocks but the last)."""
    threshold = floors / len(cuts)
    length = np.sqrt((x[:, cuts[-1]] ** 2).sum(1))[:, None] * np.sqrt((q[:, cuts[-1]] ** 2).sum(1))[None, :] * (1 + 1e-12)
    sums = np.zeros((len(x), len(q)))
    enough = length >= threshold
    for c in cuts[:-1]:
        share = _product(x[:, c], q[:, c])
        enough |= share >= threshold
        sums += share
    return enough & (sums + length >= floors), sums


def resolved(x: np.ndarray, q: np.ndarray, entries: np.ndarray, sums: np.ndarray, last: slice, sparse: float) -> np.ndarray:
    """Phase 3: exact scores of the collected entries, minus infinity elsewhere."""
    scores = np.full(sums.shape, -np.inf)
    if entries.mean() > sparse or np.abs(x).max(initial=0) >= 2.0**24 or np.abs(q).max(initial=0) >= 2.0**24:
        scores[entries] = (sums + _product(x[:, last], q[:, last]))[entries]
    else:
        r, j = np.nonzero(entries)
        scores[r, j] = sums[r, j] + np.einsum("ij,ij->i", x[r, last], q[j, last])
    return scores


def sufficient(batches: Iterator[pa.RecordBatch], qids: np.ndarray, q: np.ndarray, floors: np.ndarray, config: Config) -> Iterator[pa.RecordBatch]:
    """The k best rows of a partition for each query, of those that reach its floor."""
    cuts = _cuts(q.shape[1], config.blocks)
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for ids, x in _Tiles(batches, q.shape[1], config.tile):
        exact = x.size and np.abs(x).max() * np.abs(q).max(initial=0) * x.shape[1] >= 2.0**53
        for at in range(0, len(qids), config.query_tile):
            part = slice(at, at + config.query_tile)
            if exact:  # sums that doubles can't hold go through as whole numbers
                scores = _product(x, q[part]).astype(np.int64)
                hit = scores >= floors[part]
            else:
                entries, sums = collected(x, q[part], floors[part], cuts)
                scores = resolved(x, q[part], entries, sums, cuts[-1], config.sparse)
                hit = entries & (scores >= floors[part])
            at_query, at_row = np.nonzero(hit.T)
            for j, r in zip(*_groups(at_query, at_row)):
                r = r[ids[r] != qids[at + j]]
                if len(r):
                    _merge(best, int(at + j), ids[r], scores[r, j], config.k)
    yield _emit(best)


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values by key; keys are in order."""
    distinct, starts = np.unique(keys, return_index=True)
    return distinct, np.split(values, starts[1:]) if len(distinct) else []


def integers(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): components as floor(scale * x). Vectors that are null, or hold null or non-finite components, are left out, as are rows with a null id."""
    x = F.col(vector_column)
    fine = F.col(id_column).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")).alias("v"))


def top_k(vectors: DataFrame, is_query, config: Config = Config(), scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all other rows, fewer if there are fewer; ties go to the smaller id.

    is_query is a condition on id_column. Vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id. Vectors of unequal length are compared as if the shorter ended in zeros. Repeated rows with an equal id are candidates each, one query together, and don't match their own id; an id with different vectors is a query for each. An empty table has no row. Queries go in blocks of about config.queries; only a block is ever on the driver or sent out. Other columns aren't read.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = integers(vectors, scale, id_column, vector_column)
    asked = integers(vectors.where(is_query), scale, id_column, vector_column).distinct()
    known = asked.count()
    width, n = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not known or not width:
        return spark.createDataFrame([], schema)
    n_blocks = -(-known // config.queries)
    path = f"{common.shared_dir(spark).rstrip('/')}/spanforge-{uuid.uuid4().hex}"
    for block in range(n_blocks):
        here = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).orderBy("id", "v").collect()
        qids = np.array([r["id"] for r in here], np.int64)
        q = np.zeros((len(here), width))
        for i, r in enumerate(here):
            q[i, : len(r["v"])] = r["v"]
        _block(rows, n, qids, q, config).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def waves(n: int, config: Config) -> list[tuple[float, float]]:
    """Shares of the rows, from and to, of each wave."""
    ends, end = [], float(config.first)
    while end < n:
        ends.append(end / n)
        end *= config.growth
    ends.append(1.0)
    return list(zip([0.0, *ends[:-1]], ends))


def _block(rows: DataFrame, n: int, qids: np.ndarray, q: np.ndarray, config: Config) -> DataFrame:
    spark = rows.sparkSession
    sent = common.Shared(spark, (qids, q))
    floors = np.full(len(qids), -np.inf)
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    best = None
    every = waves(n, config)
    for number, (low, high) in enumerate(every):
        floors_sent = common.Shared(spark, floors)

        def look(batches, floors_sent=floors_sent):
            yield from sufficient(batches, *sent.value, floors_sent.value, config)

        here = rows if len(every) == 1 else rows.where((place >= low) & (place < high))
        found = here.mapInArrow(look, _SPARK_SCHEMA).select("j", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("j", F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))
        both = found if best is None else best.unionByName(found)
        best = both.withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= config.k)
        if number < len(every) - 1:
            best = common.stored(best).drop("rank")
            for r in best.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= config.k).collect():
                floors[r["j"]] = r["floor"]
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(qids)], "j long, query_id long")
    return best.join(F.broadcast(names), "j").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best_first():
    from pyspark.sql import Window

    return Window.partitionBy("j").orderBy(F.col("score").desc(), F.col("vec_id"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

"""Benchmark decontamination as a prefix-filtered set join.

An item is a sequence of words; its windows are runs of ten words (an item with fewer is one window). A window is a set of shingles of five words, each with its offset. A document contains a window only if it has all of its shingles, so it must have the rarest: with full containment the necessary prefix, in order of rarity, is one shingle. Rarity is counted over all documents. Documents are probed for these prefix shingles only. A shingle's place and its offset give the one place where the window could begin; windows that would begin before the document or run past its end are dropped (positional and length bounds), and the rest are verified word by word.

The benchmark is indexed in blocks of bounded size, and the documents are read once for each block; one block is all that is ever on the driver or sent out. A document's words found so far travel with it from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lower-cases A-Z; every byte that isn't part of a word becomes a space. UTF-8 bytes from 0x80 on are.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEPARATOR = b"\x01"
PRIME = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Config:
    window: int = 10
    shingle: int = 5
    block_chars: int = 4_000_000  # of item text that is indexed at once, about


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORDS).split()


@dataclass
class Index:
    """Windows of a block of items, and the shingles to probe for."""

    vocabulary: dict[bytes, int]  # words from 1 on
    lengths: np.ndarray  # of each distinct window
    windows: np.ndarray  # word numbers, zero-padded
    item_starts: np.ndarray  # of each window's items in items
    items: list[str]
    shingle_of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by shingle length: sorted codes, each entry's window, its offset
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None  # the same with one entry a window


def _codes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    code = np.zeros(len(at), np.uint64)
    for j in range(n):
        code = code * np.uint64(PRIME) + ids[at + j].astype(np.uint64)
    return code ^ (code >> np.uint64(31))


def build(items: list[tuple[str, str]], config: Config = Config()) -> Index:
    vocabulary: dict[bytes, int] = {}
    of_window: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        for a in range(max(1, len(ids) - config.window + 1) if ids else 0):
            of_window.setdefault(tuple(ids[a : a + config.window]), set()).add(item)
    order = sorted(of_window)
    lengths = np.array([len(w) for w in order], np.int64)
    windows = np.zeros((len(order), config.window), np.int64)
    for i, w in enumerate(order):
        windows[i, : len(w)] = w
    starts = np.cumsum([0, *(len(of_window[w]) for w in order)])
    names = [x for w in order for x in sorted(of_window[w])]
    entries: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for n in np.unique(lengths).tolist():
        rows = np.nonzero(lengths == n)[0]
        s = min(config.shingle, n)
        for offset in range(n - s + 1):
            part = windows[rows, offset : offset + s]
            code = _codes(part.ravel(), np.arange(len(rows)) * s, s)
            entries.setdefault(s, []).append((code, rows, np.full(len(rows), offset)))
    shingle_of = {}
    for s, parts in entries.items():
        code, window, offset = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((offset, window, code))
        shingle_of[s] = (code[by], window[by], offset[by])
    return Index(vocabulary, lengths, windows, starts, names, shingle_of)


def with_prefix(index: Index, counts: dict[int, dict[int, int]]) -> Index:
    """Keeps, for each window, its rarest shingle; counts are by shingle length and code. Ties go to the earlier offset."""
    chosen = {}
    for s, (code, window, offset) in index.shingle_of.items():
        seen = np.array([counts.get(s, {}).get(c, 0) for c in code.tolist()], np.int64)
        by = np.lexsort((offset, seen, window))
        first = by[np.r_[True, window[by][1:] != window[by][:-1]]]
        first = first[np.lexsort((window[first], code[first]))]
        chosen[s] = (code[first], window[first], offset[first])
    return replace(index, prefix=chosen)


class Group:
    """Some documents as one sequence of word numbers: 0 for words that no item has, -1 between documents."""

    def __init__(self, texts: list[str], index: Index):
        joined = (b" " + SEPARATOR + b" ").join(t.encode("utf-8", "replace").translate(WORDS) for t in texts)
        tokens = joined.split()
        lookup = index.vocabulary | {SEPARATOR: -1}
        self.ids = np.fromiter(map(lookup.get, tokens, repeat(0)), np.int64, len(tokens))
        breaks = np.nonzero(self.ids == -1)[0]
        self.starts = np.r_[0, breaks + 1]
        self.stops = np.r_[breaks, len(tokens)]
        self.n_words = self.stops - self.starts
        self.known = np.r_[0, np.cumsum(self.ids > 0)]

    def places(self, n: int) -> np.ndarray:
        """Where n words that items have follow each other."""
        if len(self.ids) < n:
            return np.zeros(0, np.int64)
        return np.nonzero(self.known[n:] - self.known[:-n] == n)[0]

    def probe(self, s: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles among the sorted codes, and the first index of their code."""
        at = self.places(s)
        code = _codes(self.ids, at, s)
        k = np.searchsorted(codes, code)
        hit = k < len(codes)
        hit[hit] = codes[k[hit]] == code[hit]
        return at[hit], k[hit]

    def find(self, index: Index) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of all occurrences."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, (codes, window, offset) in index.prefix.items():
            at, first = self.probe(s, codes)
            if not len(at):
                continue
            many = np.searchsorted(codes, codes[first], "right") - first
            at = np.repeat(at, many)
            entry = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            w, start = window[entry], at - offset[entry]
            doc = np.searchsorted(self.starts, at, "right") - 1
            fits = (start >= self.starts[doc]) & (start + index.lengths[w] <= self.stops[doc])
            w, start = w[fits], start[fits]
            same = np.ones(len(w), bool)
            for j in range(index.windows.shape[1]):
                inside = j < index.lengths[w]
                same[inside] &= self.ids[start[inside] + j] == index.windows[w[inside], j]
            starts.append(start[same])
            found.append(w[same])
        return np.concatenate(starts), np.concatenate(found)

    def ranges(self, start: np.ndarray, window: np.ndarray, index: Index) -> tuple[list[list[list[int]]], list[list[str]]]:
        """For each document: the hit words as disjoint [start, stop), and the items found, sorted."""
        hits: list[list[list[int]]] = [[] for _ in self.starts]
        items: list[set[str]] = [set() for _ in self.starts]
        order = np.argsort(start, kind="stable")
        docs = np.searchsorted(self.starts, start[order], "right") - 1
        for d, a, w in zip(docs.tolist(), start[order].tolist(), window[order].tolist()):
            a -= int(self.starts[d])
            b = a + int(index.lengths[w])
            mine = hits[d]
            if mine and a <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], b)
            else:
                mine.append([a, b])
            items[d].update(index.items[index.item_starts[w] : index.item_starts[w + 1]])
        return hits, [sorted(x) for x in items]


def groups(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of a bounded size, with the number of the first."""
    first, held, some = 0, 0, []
    for i, t in enumerate(texts):
        some.append(t)
        held += len(t)
        if held >= chars:
            yield first, some
            first, held, some = i + 1, 0, []
    if some:
        yield first, some


def merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def rarity(docs: DataFrame, sent, text_column: str) -> dict[int, dict[int, int]]:
    """How often each shingle of the index occurs in all documents, by length and code. Only shingles of a block of items are counted, so the result is as bounded as the block."""
    out = pa.schema([("s", pa.int64()), ("k", pa.int64()), ("n", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        totals = {s: np.zeros(len(x[0]), np.int64) for s, x in index.shingle_of.items()}
        for batch in batches:
            for _, some in groups(common.texts(batch.column(0))):
                group = Group(some, index)
                for s, total in totals.items():
                    total += np.bincount(group.probe(s, index.shingle_of[s][0])[1], minlength=len(total))
        for s, total in totals.items():
            k = np.nonzero(total)[0]
            yield common.like(out, [[s] * len(k), k.tolist(), total[k].tolist()])

    rows = docs.select(text_column).mapInArrow(apply, "s long, k long, n long").groupBy("s", "k").agg(F.sum("n").alias("n")).collect()
    codes = {s: x[0].tolist() for s, x in sent.value.shingle_of.items()}
    counts: dict[int, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["s"], {})[codes[r["s"]][r["k"]]] = r["n"]
    return counts


def blocks(docs: DataFrame, items: DataFrame, config: Config, item_column: str, item_text: str, text_column: str) -> Iterator[object]:
    """Broadcast indexes of the benchmark, block by block."""
    spark = docs.sparkSession
    total = items.agg(F.sum(F.length(item_text)).alias("n")).first()["n"] or 0
    n = max(1, -(-total // config.block_chars))
    for b in range(n):
        here = items.where(F.col(item_text).isNotNull() & F.col(item_column).isNotNull() & (F.pmod(F.xxhash64(item_column), F.lit(n)) == b))
        rows = here.select(F.col(item_column).cast("string").alias("i"), F.col(item_text).alias("t")).collect()
        index = build(sorted((r["i"], r["t"]) for r in rows), config)
        yield common.Shared(spark, with_prefix(index, rarity(docs, common.Shared(spark, index), text_column)))


_FOUND = "hits array<array<int>>, items array<string>"


def contamination(docs: DataFrame, items: DataFrame, config: Config = Config(), id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, hits, items) of every document: hits are the words covered by item windows, as disjoint [start, stop) in order, and items the ids of items with a window there, sorted as strings.

    Null texts have no words; items with a null id or text, or without words, have no windows. Repeated ids are rows of their own. Of shingles equally rare the earlier is probed for, which changes no result. Texts of any length are read whole. An empty table has no row; without an item nothing is hit. Other columns aren't read.
    """
    common.prepare(docs.sparkSession)
    now = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("t"))
    found = None
    carried = pa.schema([("id", pa.int64()), ("t", pa.string()), ("n_words", pa.int64()), ("hits", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])

    def step(sent):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                texts = common.texts(batch.column(1))
                n_words: list[int] = []
                hits: list = []
                names: list = []
                for _, some in groups(texts):
                    group = Group(some, index)
                    h, i = group.ranges(*group.find(index), index)
                    n_words += group.n_words.tolist()
                    hits += h
                    names += i
                if batch.num_columns > 2:
                    hits = [merge(a, b) for a, b in zip(hits, batch.column(3).to_pylist())]
                    names = [sorted({*a, *b}) for a, b in zip(names, batch.column(4).to_pylist())]
                yield common.like(carried, [batch.column(0).to_pylist(), texts, n_words, hits, names])

        return apply

    def slim(sent):
        inner = step(sent)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in inner(batches):
                yield batch.drop_columns(["t"])

        return apply

    previous = None
    for sent in blocks(now, items, config, item_column, item_text, "t"):
        if previous is not None:
            now = common.stored(now.mapInArrow(step(previous), f"id long, t string, n_words long, {_FOUND}"))
        previous = sent
    found = now.mapInArrow(slim(previous), f"id long, n_words long, {_FOUND}")
    return found.withColumnRenamed("id", id_column)


def keep_clean(docs: DataFrame, items: DataFrame, config: Config = Config(), text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any item window, with all their columns, whatever their ids; rows of one id are judged each by its own text, and repeated rows alike. Null and empty texts stay. Texts of any length are read whole. Without an item all documents stay; an empty table stays empty."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index(text_column)

    def step(sent):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, some in groups(common.texts(batch.column(at))):
                    group = Group(some, index)
                    starts, _ = group.find(index)
                    clean[first + np.searchsorted(group.starts, starts, "right") - 1] = False
                yield batch.filter(pa.array(clean))

        return apply

    now = docs
    for sent in blocks(docs, items, config, item_column, item_text, text_column):
        now = now.mapInArrow(step(sent), docs.schema)
    return now


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, rn, w, len(w) AS n FROM (
    SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[a : a + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT rn, a, size, array_to_string(w[a : a + size - 1], ' ') AS s
  FROM (SELECT rn, w, size, unnest(range(1, n - size + 2)) AS a FROM d JOIN sizes ON n >= size)
), found AS (
  SELECT rn, a, size, item FROM places JOIN windows USING (size, s)
), hit AS (
  SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(a, a + size)) AS p FROM (SELECT DISTINCT rn, a, size FROM found)) GROUP BY rn
), named AS (
  SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM found) GROUP BY rn
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN named USING (rn)
"""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import common, lattice

SF = "/root/testdata/sf0.001"


def all_paths(model, word):
    """Probability of a word by listing every segmentation."""
    s = lattice.START + word

    def rest(i):
        if i == len(s):
            return 1.0
        total = math.exp(model.logs[257] if i == 0 else model.spelled(s[i])) * rest(i + 1)
        return total + sum(math.exp(model.logs[k]) * rest(i + len(p)) for p, k in PIECES.items() if s.startswith(p, i))

    return rest(0)


PIECES = {p: 258 + i for i, p in enumerate(["a", "b", "ab", "▁a", "▁ab", "ba", "bab", "aba", "é"])}


def tiny():
    return lattice.from_pieces(list(PIECES))


@pytest.mark.parametrize("word", ["a", "ab", "ababab", "é", "zé1", "babba", "▁a"])
def test_forward_is_the_sum_over_segmentations(word):
    model = tiny()
    assert math.isclose(math.exp(model.forward(word)), all_paths(model, word), rel_tol=1e-9)


def test_expected_uses_add_up():
    model = tiny()
    totals = [0.0] * len(model.logs)
    model.expect("ababé", 3.0, totals)
    # numeric derivative of log P by each piece's log-probability is its expected number of uses
    for k in (257, PIECES["ab"], PIECES["▁a"], 0xC3):
        moved = list(model.logs)
        moved[k] += 1e-6
        slope = (model.with_logs(moved).forward("ababé") - model.forward("ababé")) / 1e-6
        assert math.isclose(totals[k], 3 * slope, rel_tol=1e-3, abs_tol=1e-6)


def test_learning_helps():
    words = {"abab": 50, "ba": 20}
    model = tiny()
    before = sum(c * model.forward(w) for w, c in words.items())
    for _ in range(3):
        totals = [1e-6] * len(model.logs)
        for w, c in words.items():
            model.expect(w, c, totals)
        x = np.array(totals)
        model = model.with_logs(np.log(x / x.sum()))
    assert sum(c * model.forward(w) for w, c in words.items()) > before


def test_query_against_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    counts = Counter()
    ends = 0
    for r in rows:
        if learn(r["doc_id"]):
            counts.update(lattice.words(r["text"]))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    model = lattice.load()
    totals = np.ones(len(model.logs))
    for w, c in counts.items():
        model.expect(w.decode(), c, totals)
    totals[256] += ends
    model = model.with_logs(np.log(totals / totals.sum()))
    out = {r["doc_id"]: r for r in lattice.query(spark, SF).collect()}
    assert len(out) == len(rows)
    for r in rows:
        found = lattice.words(r["text"])
        got = out[r["doc_id"]]
        assert got["n_tokens"] == len(found) + 1 and got["train_tokens"] == n
        assert got["n_known"] == sum(counts[w] > 0 for w in found) + 1 and got["held_out"] == (not learn(r["doc_id"]))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in found) + math.log10((ends + 1) / (n + v + 1))
        assert math.isclose(got["base_score"], base, rel_tol=1e-9)
        assert math.isclose(got["score"], (sum(model.forward(w.decode()) for w in found) + model.end) / math.log(10), rel_tol=1e-6)


def test_rare_words_by_the_join_score_alike(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    train = common.id_bucket(F.col("doc_id"), 7) != 2
    wide = {r["doc_id"]: r for r in lattice.score(docs, train).collect()}
    for few in (0, 50):
        for r in lattice.score(docs, train, lattice.Config(common_words=few, counted_at_once=100)).collect():
            assert r["n_known"] == wide[r["doc_id"]]["n_known"] and math.isclose(r["score"], wide[r["doc_id"]]["score"], rel_tol=1e-9)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "x"), (4, "\x00   " + "y" * 30_000)], "doc_id long, text string").withColumn("word", F.lit("a"))
    out = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in lattice.score(docs, F.col("doc_id") == 3).collect())
    assert out == [(0, 2, 1), (1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (4, 4, 1)]
    none = lattice.score(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)
    assert lattice.score(docs.limit(0), F.lit(True)).count() == 0

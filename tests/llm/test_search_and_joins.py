import random

import numpy as np
from oracle import assert_same
from pyspark.sql import functions as F

from spanforge.llm import decontam, topk

SF = "/root/testdata/sf0.01"


def test_topk_against_sql(spark):
    assert_same(topk.query(spark, SF), topk.SQL, SF)


def plain_top(rows, k):
    fine = {i: np.floor(64 * np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    out = []
    for q in sorted(i for i in fine if i % 20 == 0):
        scores = sorted((-int(fine[q] @ fine[i]), i) for i in fine if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def test_topk_ties_odd_vectors_and_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-0.5, 0.25, 0.5)) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)]  # many ties
    rows += [(400, None), (401, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (420, [float("nan")] * 6), (421, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).withColumn("rank", F.lit("clash"))
    for config in (topk.Config(k=7), topk.Config(k=7, queries=3, blocks=1, tile=10, query_tile=2), topk.Config(k=500), topk.Config(k=7, first=10, growth=3, sparse=1.0, blocks=3)):
        out = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, config).collect())
        assert out == plain_top(rows, config.k)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 40"), F.col("vec_id") % 20 == 0).count() == 0


def test_only_entries_that_may_reach_the_floor_are_collected():
    rng = np.random.default_rng(0)
    x, q = np.floor(64 * rng.normal(0, 0.125, (400, 64))), np.floor(64 * rng.normal(0, 0.125, (30, 64)))
    true = x @ q.T
    floors = np.sort(true, axis=0)[-20]
    cuts = topk._cuts(64, 4)
    entries, sums = topk.collected(x, q, floors, cuts)
    assert entries[true >= floors].all() and entries.mean() < 0.7
    for sparse in (0.0, 1.0):
        scores = topk.resolved(x, q, entries, sums, cuts[-1], sparse)
        assert (scores[entries] == true[entries]).all() and np.isneginf(scores[~entries]).all()
    assert topk.waves(100, topk.Config(first=10, growth=3)) == [(0.0, 0.1), (0.1, 0.3), (0.3, 0.9), (0.9, 1.0)]
    assert topk.waves(5, topk.Config()) == [(0.0, 1.0)]


def test_large_components_stay_exact():
    x = np.full((2, 4), 2.0**27 + 1)
    assert topk._product(x, x)[0, 0] == 4 * (2**27 + 1) ** 2


def test_decontamination_against_sql(spark):
    assert_same(decontam.query(spark, SF), decontam.SQL, SF)


def plain_contamination(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = decontam.words(t or "")
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = decontam.words(t or ""), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "D", "été", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice((1, 2, 3, 6, 9, 10, 11, 14)))) for i in range(12)] + [(50, None), (51, " .,! "), (52, "c D"), (53, "c D")]
    docs = [(i, text(rng.randrange(60))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, items[3][1].upper() + "!?" + items[7][1]), (102, "z\x01z " + items[7][1]), (103, text(20_000))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for config in (decontam.Config(), decontam.Config(block_chars=40), decontam.Config(shingle=2)):
        out = sorted(((r["doc_id"], r["n_words"], sum(y - x for x, y in r["hits"]), r["items"]) for r in decontam.contamination(d, b, config).collect()), key=str)
        assert out == plain_contamination(docs, items)
    kept = decontam.keep_clean(d, b, decontam.Config(block_chars=40))
    clean = [i for i, _, n, _ in plain_contamination(docs, items) if n == 0]
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(clean)


def test_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.contamination(d, b).collect()] == [(1, 2, [], [])]
    assert decontam.contamination(d.limit(0), b).count() == 0

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import mixing

SF = "/root/testdata/sf0.01"


def test_raked_margins_meet_their_targets():
    cells = {(s, l, t): float(1 + i) for i, (s, l, t) in enumerate((s, l, t) for s in ("a", "b", None) for l in ("x", "y") for t in ("0", "1"))}
    targets = {0: {"a": 0.5, "b": 0.3, None: 0.2}, 1: {"x": 0.6, "y": 0.4}, 2: {"0": 0.1, "1": 0.9}}
    fitted = mixing.rake(cells, targets)
    for d, target in targets.items():
        for v, share in target.items():
            assert math.isclose(sum(x for k, x in fitted.items() if k[d] == v), share, rel_tol=1e-6)
    # raking keeps the odds ratios of the cells
    odds = lambda c: c["a", "x", "0"] * c["b", "y", "0"] / (c["a", "y", "0"] * c["b", "x", "0"])
    assert math.isclose(odds(fitted), odds(cells), rel_tol=1e-6)


def test_empty_cells_and_missing_targets():
    assert mixing.rake({}, {0: {"a": 1.0}}) == {}
    assert mixing.rake({("a",): 0.0}, {0: {"a": 1.0}}) == {("a",): 0.0}
    fitted = mixing.rake({("a",): 3.0, ("b",): 1.0}, {0: {"a": 0.5, "gone": 0.5}})
    assert fitted == {("a",): 1.0, ("b",): 0.0}


def test_calibration_expects_the_wanted_tokens():
    cells = {("a",): 900.0, ("b",): 100.0}
    p = mixing.calibrate(cells, {("a",): 0.5, ("b",): 0.5}, 0.5)
    assert p["b",] == 1.0 and math.isclose(900 * p["a",] + 100, 500)
    assert mixing.calibrate(cells, {("a",): 0.0, ("b",): 1.0}, 0.5) == {("a",): 0.0, ("b",): 1.0}


def test_query_against_a_plain_version(spark):
    rows = mixing.query(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    # what describes a document: all its words, and the centre nearest to the square roots of its hashed word counts
    config = mixing.Config()
    centres = mixing.topics(docs, config)
    given = {r["doc_id"]: r for r in docs.collect()}
    for r in rows:
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (given[r["doc_id"]]["text"] or "").encode().lower())
        x = [0.0] * config.buckets
        for w in words:
            x[zlib.crc32(w) % config.buckets] += 1
        size = math.sqrt(sum(x)) or 1.0
        near = [round(sum(math.sqrt(a) / size * b for a, b in zip(x, c)), 9) for c in centres.tolist()]
        assert r["tokens"] == len(words) and abs(near[int(r["topic"][1:])] - max(near)) < 1e-8
        assert (r["source"], r["lang"]) == (given[r["doc_id"]]["source"], given[r["doc_id"]]["lang"])
    cells = {}
    for r in rows:
        k = (r["source"], r["lang"], r["topic"])
        cells[k] = cells.get(k, 0.0) + r["tokens"]
    total = sum(cells.values())
    shares = [{v: sum(x for k, x in cells.items() if k[d] == v) / total for v in {k[d] for k in cells}} for d in range(3)]
    targets = [mixing.tempered(s, 0.7) for s in shares]
    x = {k: v / total for k, v in cells.items()}
    for _ in range(300):
        for d in range(3):
            have = {}
            for k, v in x.items():
                have[k[d]] = have.get(k[d], 0.0) + v
            x = {k: v * targets[d][k[d]] / have[k[d]] for k, v in x.items()}
    for r in rows:
        k = (r["source"], r["lang"], r["topic"])
        assert math.isclose(r["weight"], x[k] * total / cells[k], rel_tol=1e-6)
    assert math.isclose(sum(r["tokens"] * r["probability"] for r in rows), total / 2, rel_tol=1e-9)
    sampled = sum(r["tokens"] for r in rows if r["sampled"])
    spread = math.sqrt(sum(r["tokens"] ** 2 * r["probability"] * (1 - r["probability"]) for r in rows))
    assert abs(sampled - total / 2) < 4 * spread
    again = {r["doc_id"]: r["sampled"] for r in mixing.query(spark, SF).collect()}
    assert again == {r["doc_id"]: r["sampled"] for r in rows}


def test_topics_part_different_texts():
    cache = {}
    x = np.array([mixing.vector(t, 64, cache)[0] for t in ["red blue green"] * 10 + ["one two three four"] * 10])
    near = np.argmax(x @ mixing.train_topics(x, mixing.Config(topics=2, buckets=64)).T, axis=1)
    assert len(set(near[:10])) == 1 and len(set(near[10:])) == 1 and near[0] != near[-1]


def test_sample_is_what_is_marked(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(200).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(50)).unionByName(docs.limit(30).withColumn("source", F.lit(None).cast("string")))
    docs = docs.unionByName(odd).repartition(4)
    marked = mixing.mixed(docs).where("sampled").collect()
    for config in (mixing.Config(), mixing.Config(cells=3)):
        kept = mixing.sample(docs, config)
        assert kept.columns == docs.columns
        assert Counter((r["doc_id"], r["source"], r["lang"]) for r in kept.collect()) == Counter((r["doc_id"], r["source"], r["lang"]) for r in marked)
    assert sum(r["doc_id"] is None for r in marked) > 10


def test_fit_in_tables_is_that_of_arrays(spark):
    rng = random.Random(3)
    rows = [(f"s{i}" if i else None, lang, topic, rng.choice((0, 1, 5, 200))) for i in range(12) for lang in ("a", "b", None) for topic in ("t0", "t1") if rng.random() < 0.9]
    counted = spark.createDataFrame(rows, "source string, lang string, topic string, n long").repartition(3)
    for targets in ({}, {"lang": {"a": 0.5, "b": 0.2, None: 0.3}}):
        few = mixing.weigh(counted, mixing.Config(targets=targets))
        many = {(r["source"], r["lang"], r["topic"]): (r["weight"], r["probability"]) for r in mixing.weigh(counted, mixing.Config(targets=targets, cells=5, tolerance=1e-5)).collect()}
        assert few.keys() == many.keys()
        for k, (w, p) in few.items():
            assert math.isclose(w, many[k][0], rel_tol=1e-3, abs_tol=1e-4) and math.isclose(p, many[k][1], rel_tol=1e-3, abs_tol=1e-4), (k, few[k], many[k])


def test_many_values_cost_little():
    cells = {(f"s{i}", "x", f"t{i % 5}"): 1.0 + i % 7 for i in range(30_000)}
    fitted = mixing.rake(cells, {0: {k[0]: 1 / 30_000 for k in cells}}, rounds=3)
    assert math.isclose(sum(fitted.values()), 1.0)


def test_ties_go_to_the_first_topic():
    config = mixing.Config(buckets=4)
    assert mixing.nearest([np.array([1.0, 0, 0, 0]), np.zeros(4)], np.array([[0.5, 0, 0, 0], [0.5, 0, 0, 0]]), config) == ["t0", "t0"]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "s", None), (3, "a b", "s", "en"), (3, "a b", "s", "en"), (None, "c", "s", "en"), (4, "w " * 50_000, "t", "fr")], "doc_id long, text string, source string, lang string").withColumn("weight", F.lit(1))
    out = mixing.mixed(docs).collect()
    assert len(out) == 6 and all(0 <= r["probability"] <= 1 for r in out)
    assert mixing.sample(docs).columns == docs.columns
    # all tokens are wanted: every row with words stays, the one without an id too
    kept = mixing.sample(docs, mixing.Config(share=1.0, temper=1.0)).collect()
    assert Counter(r["doc_id"] for r in kept)[None] == 1 and sum(r["doc_id"] == 3 for r in kept) == 2
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0


def test_topics_are_trained_on_all_texts(spark):
    """One text in a thousand is of another topic, which a sample of 3,000 of 6,000 need not meet, and each moves the centres."""
    words = [f"plain{i % 40} words{i % 7}" for i in range(6000)]
    of = lambda more: spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate([*words, *more])], "doc_id long, text string, source string, lang string")
    config = mixing.Config(topics=2)
    without = mixing.topics(of([]), config)
    for i in range(6):
        centres = mixing.topics(of([f"rare{i} thing{i} quite different" for _ in range(1)]), config)
        assert centres.shape != without.shape or np.abs(centres - without).max() > 1e-6

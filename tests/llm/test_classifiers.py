import math
import re

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import common, puquality, toxicity

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def _held_out(spark, out, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = out.where("held_out").join(labels, "doc_id").select(label, "predicted", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return np.array([r[label] for r in rows]), np.array([r["predicted"] for r in rows])


def test_quality_held_out(spark):
    y, p = _held_out(spark, puquality.query(spark, SF), "quality")
    assert (p[y == 1] == 1).mean() > 0.98 and (p[y == 0] == 0).mean() > 0.9


def test_toxicity_held_out(spark):
    out = toxicity.query(spark, SF)
    y, p = _held_out(spark, out, "toxic")
    assert (p[y == 0] == 0).mean() > 0.98 and (p[y == 1] == 1).mean() > 0.75


def _tables(spark):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    return docs, common.table(spark, SMALL, "labels"), {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def plain_quality(text, model):
    """Features and network of one text, by counting characters and by loops."""
    data = text.encode()
    words, lines = data.split(), data.split(b"\n")
    x = [0.0] * puquality.N_FEATURES
    if words:
        n, k = len(data), len(words)
        share = lambda test: sum(map(test, data)) / n
        x = [data.count(bytes([c])) / n for c in puquality.PUNCTUATION]
        x += [share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57), data.count(b" ") / n, data.count(b"\n") / n, share(lambda c: c >= 128), share(lambda c: c < 32)]
        x += [sum(a == b for a, b in zip(words, words[1:])) / k, len(set(words)) / k, len(set(lines)) / len(lines), (n - k) / k / 20, sum(len(w) > 24 for w in words) / k, math.log(1 + k) / 10, max(data.count(bytes([c])) for c in range(128)) / n]
    z = [min(max((math.log(v + 1e-3) - m) / s, -6), 6) for v, m, s in zip(x, model.mean, model.scale)]
    hidden = [math.tanh(sum(a * w for a, w in zip(z, model.w1[:, h])) + model.b1[h]) for h in range(len(model.b1))]
    return 1 / (1 + math.exp(-(sum(a * w for a, w in zip(hidden, model.w2)) + model.b2[0])))


def test_quality_query_against_loops(spark):
    docs, labels, texts = _tables(spark)
    model = puquality.fit(docs, labels)
    out = puquality.query(spark, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        p = plain_quality(texts[r["doc_id"]], model)
        assert math.isclose(r["score"], p, abs_tol=1e-9) and r["predicted"] == int(p >= 0.3)


def plain_toxicity(text, model):
    clean = 1.0
    for sentence in re.findall(r"[^.!?\n]+", text):
        words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
        z = sum(model.weights.get(f, 0.0) for w in words for f in [w + ".", *(w[:n] for n in model.prefixes if n <= len(w))])
        clean *= 1 - (1 / (1 + math.exp(-(z + model.leak))) if z else 0.0)
    return 1 - clean


def test_toxicity_query_against_loops(spark):
    docs, labels, texts = _tables(spark)
    model = toxicity.fit(docs, labels)
    out = toxicity.query(spark, SMALL).collect()
    assert len(out) == len(texts) and model is not None
    for r in out:
        p = plain_toxicity(texts[r["doc_id"]], model)
        assert math.isclose(r["score"], p, abs_tol=1e-9) and (abs(p - 0.7) < 1e-9 or r["predicted"] == int(p >= 0.7))


def test_toxicity_fit_from_tables_is_that_from_texts(spark):
    docs, labels, _ = _tables(spark)
    may = common.id_bucket(F.col("doc_id"), 3) != 1
    rows = sorted((r["y"], r["text"]) for r in toxicity.sample(docs.where(may), labels.where(may)).collect())
    a, b = toxicity.fit(docs, labels), toxicity.train([t for _, t in rows], [y for y, _ in rows])
    assert a.weights.keys() == b.weights.keys() and all(math.isclose(a.weights[f], b.weights[f], rel_tol=1e-6, abs_tol=1e-6) for f in a.weights)


def test_toxicity_gradient_is_that_of_the_loss():
    rows, cols, owner = np.array([0, 0, 1, 2, 3, 3]), np.array([0, 1, 2, 0, 1, 2]), np.array([0, 0, 1, 2])
    y, weight = np.array([1.0, 1.0, 0.0]), np.array([0.2, 0.3, 0.5])

    def loss(w):
        z = np.bincount(rows, w[cols], len(owner)) - 1.0
        clean = np.array([np.prod(1 - 1 / (1 + np.exp(-z[owner == i]))) for i in range(3)])
        return -(weight * np.where(y == 1, np.log(1 - clean), np.log(clean))).sum()

    w = np.array([0.3, -0.2, 0.7])
    numeric = [(loss(w + h) - loss(w - h)) / 2e-6 for h in 1e-6 * np.eye(3)]
    assert np.allclose(toxicity.gradient(w, rows, cols, owner, y, weight, -1.0), numeric, atol=1e-6)


def test_repeated_ids_and_long_texts_are_judged_by_their_own_text(spark):
    bad = "you idiot. " + "a fine day. " * 20_000
    docs = spark.createDataFrame([(1, bad), (1, "a fine day"), (None, bad), (1, bad)], "doc_id long, text string")
    model = toxicity.train(["you idiot", "a day"] * 5, [1, 0] * 5, toxicity.Config(z=1.0))
    assert [r["text"] for r in toxicity.keep(docs, model).collect()] == ["a fine day"]
    assert sorted((r["doc_id"] or 0, r["score"] > 0.5) for r in toxicity.score(docs, model).collect()) == [(0, True), (1, False), (1, True), (1, True)]


def test_both_labels_on_one_document(spark):
    docs = spark.createDataFrame([(i, f"text {i} idiot" if i % 2 else f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r["text"]: r["y"] for r in toxicity.sample(docs, labels).collect()}
    assert rows["text 1 idiot"] == 1 and len(rows) == 40
    positive, unlabelled = puquality.sample(docs, labels)
    assert len(positive) == 20 and len(unlabelled) == 40


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (9000, 5)), rng.normal(4, 1, (3000, 5))
    unlabelled = np.concatenate([good[4500:], bad[:1500]])
    prior = puquality.estimate_prior(good[:4500], unlabelled, puquality.Config(errors=0.0), np.random.default_rng(2))
    assert abs(prior - 0.75) < 0.05


def test_risk_never_rewards_calling_positives_bad():
    x = np.abs(np.random.default_rng(3).normal(0.2, 0.05, (400, puquality.N_FEATURES)))
    model = puquality.train(x[:200], x[200:], puquality.Config(epochs=50))
    assert puquality.sigmoid(model.logit(x)).mean() > 0.5


def test_noisy_or_and_spans():
    model = toxicity.train(["you idiot. fine day", "a fine day", "an idiot here", "nice work. fine"] * 6, [1, 0, 1, 0] * 6, toxicity.Config(z=1.0))
    score, found = toxicity.Scorer(model).score("A fine day. Such an idiot! Good.")
    assert score >= 0.7
    (start, stop, p), = [f for f in found if f[2] >= 0.5]
    assert "A fine day. Such an idiot! Good."[start:stop].strip() == "Such an idiot!"
    assert np.isclose(score, 1 - np.prod([1 - q for _, _, q in found]))
    assert toxicity.Scorer(model).score("") == (0.0, [])
    assert toxicity.train(["a"], [0]) is None


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 60_000, "c"), (3, "same", "d"), (None, "\n.", "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (puquality, toxicity):
        model = module.fit(docs, labels)
        assert model is None
        assert module.score(docs, model).count() == 5
        assert module.keep(docs, model).columns == docs.columns
        assert module.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0.0


def test_keep_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([(i, "the plain words of a text " * 5, [i]) for i in range(20)], "doc_id long, text string, extra array<long>")
    kept = toxicity.keep(docs, toxicity.train(["you idiot", "a day"] * 5, [1, 0] * 5, toxicity.Config(z=1.0)))
    assert sorted(r["extra"][0] for r in kept.collect()) == list(range(20))

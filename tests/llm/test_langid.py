import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import common, langid

SF = "/root/testdata/sf0.01"


def test_windows_cover_every_byte():
    data = [b"", b"abc", b"x" * 300, "é".encode() * 128]
    windows, owner, filled = langid.cut_windows(data, 256)
    assert filled.sum() == sum(map(len, data))
    assert owner.tolist() == [1, 2, 2, 3]
    whole = b"".join(w[:n].tobytes() for w, n in zip(windows, filled))
    assert whole == b"".join(data)


def test_pooled_response_is_that_of_plain_loops():
    rng = np.random.default_rng(0)
    net = langid.train(["aaab baab", "zzyx yzzy"] * 8, ["p", "q"] * 8, langid.Config(epochs=1))
    windows = rng.integers(0, 256, (3, net.window)).astype(np.uint8)
    plain = []
    for w in windows:
        x = net.embed[w]
        best = np.max([x[i : i + net.widest].ravel() @ net.kernel for i in range(len(w) - net.widest + 1)], axis=0)
        logits = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
        plain.append(logits - np.log(np.exp(logits).sum()))
    assert np.allclose(net.log_probabilities(windows), plain, atol=1e-4)


def test_query_against_plain_loops(spark):
    """All windows of each text, one position at a time."""
    small = "/root/testdata/sf0.001"
    docs = common.table(spark, small, "documents").select("doc_id", "text", "lang")
    net = langid.train(*langid.sample(docs.where(common.id_bucket(F.col("doc_id"), 5) != 0)))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.query(spark, small).collect()}
    rows = docs.collect()
    assert len(out) == len(rows)
    for r in rows[::3]:
        data = (r["text"] or "").encode()
        if not any(c.isalpha() for c in r["text"] or ""):
            assert out[r["doc_id"]] == ("und", 0.0)
            continue
        total = np.zeros(len(net.languages))
        for a in range(0, len(data), net.window):
            part = data[a : a + net.window]
            x = net.embed[list(part.ljust(net.window, b"\0"))]
            best = np.full(net.kernel.shape[1], -np.inf)
            for i in range(net.window - net.widest + 1):
                best = np.maximum(best, x[i : i + net.widest].ravel() @ net.kernel)
            logits = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
            total += len(part) * (logits - np.log(np.exp(logits).sum()))
        p = np.exp(total / len(data) - (total / len(data)).max())
        p /= p.sum()
        lang, score = out[r["doc_id"]]
        assert abs(p[net.languages.index(lang)] - p.max()) < 1e-4 and abs(score - p.max()) < 1e-3


def test_numbers_are_no_letters(spark):
    net = langid.train(["ab", "cd"], ["x", "y"], langid.Config(epochs=1))
    assert langid.predict(net, ["½ ² Ⅷ ① 12", "½ a"])[0][0] == "und"
    assert langid.predict(net, ["½ a"])[0][0] != "und"
    docs = spark.createDataFrame([(1, "½ ²", "x"), (2, "abc", "x")], "doc_id long, text string, lang string")
    assert langid.sample(docs)[0] == ["abc"]


def test_ties_go_to_the_first_language():
    net = langid.train(["ab", "ab"], ["y", "x"], langid.Config(epochs=1))
    net.out[:], net.out_bias[:] = 0, 0
    assert langid.predict(net, ["ab"]) == (["x"], [0.5])


def test_held_out_accuracy(spark):
    out = langid.query(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(docs, "doc_id").where("lang IS NOT NULL")
    n, right = held.select(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n > 0.97
    assert out.count() == docs.count()


def test_odd_rows(spark):
    net = langid.train(["the and of", "der die das"] * 8, ["en", "de"] * 8, langid.Config(epochs=3))
    rows = [(1, None, "x", "k"), (2, "", None, "k"), (3, "123 !?", None, "k"), (4, "the of " * 50_000, None, "k"), (4, "der", None, "k"), (None, "die", None, "k")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score string"), net).collect()
    assert len(out) == 6
    by_text = sorted((r["doc_id"] or 0, r["lang_pred"], 0 <= r["score"] <= 1) for r in out)
    assert [x[1] for x in by_text if x[0] in (1, 2, 3)] == ["und"] * 3 and all(x[2] for x in by_text)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty, langid.train(*langid.sample(empty))).count() == 0


@pytest.mark.parametrize("text", ["\x00\x01é", "\ud800 lone", "a" * 256, "b" * 255])
def test_any_text_has_a_result(text):
    net = langid.train(["ab", "cd"], ["x", "y"], langid.Config(epochs=1))
    (lang,), (score,) = langid.predict(net, [text])
    assert lang in ("x", "y", "und") and 0 <= score <= 1

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same
from pyspark.sql import functions as F

from spanforge.llm import chat

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    assert_same(chat.query(spark, SF), chat.SQL, SF)


def test_no_python_in_the_plan(spark, capsys):
    chat.query(spark, SF).explain()
    said = capsys.readouterr().out
    assert not any(x in said for x in ("Python", "Pandas", "Arrow"))


PIECES = st.lists(st.sampled_from(["<", "|", ">", "\\", "[", "INST]", "/", "s>", "end", "<|end|>", "<|role:user|>\n", "</s>", "<<SYS>>", "é", "\n", "a"]), max_size=12).map("".join)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=6))
def test_escapes_are_reversible(spark, turns):
    rows = [(1, i, role or "assistant", text) for i, (role, text) in enumerate(turns)]
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    last = examples.orderBy(F.desc("target")).select(chat.parse(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in last] == [(r[2], r[3]) for r in rows]
    escaped = spark.createDataFrame([(t,) for _, t in turns], "t string").select(chat.escape(F.col("t")).alias("e")).collect()
    assert not any(x in r["e"] for r in escaped for x in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_masks_and_order(spark):
    rows = [(7, 1, "assistant", "b"), (7, 0, "user", "a"), (7, 2, "user", None), (7, 3, "assistant", "d|>"), (7, 4, "user", "e"), (8, 0, "user", "x"), (9, None, "assistant", ""), (9, 0, None, "q"), (None, 0, "assistant", "n")]
    given_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    examples = chat.expand(given_).orderBy("conv_id", "target").collect()
    seven = [r for r in examples if r["conv_id"] == 7]
    assert [r["target"] for r in seven] == [1, 3, 4]
    assert [r["formatted"][r["loss_start"] : r["loss_stop"]] for r in seven] == ["b", "d|\\>", ""]
    out = {r["conv_id"]: r for r in chat.digest(chat.expand(given_)).collect()}
    text = "user\na\nassistant\nb\nuser\n\nassistant\nd|>\nuser\ne\n"
    assert out[7]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert (out[7]["n_turns"], out[7]["loss_chars"], out[7]["loss_sha256"]) == (5, 4, hashlib.sha256(b"bd|>").hexdigest())
    assert out[8]["loss_chars"] == 0 and out[9]["n_turns"] == 2 and out[None]["loss_chars"] == 1


@pytest.mark.parametrize("schema", ["conv_id long, turn long, role string, text string"])
def test_empty(spark, schema):
    assert chat.digest(chat.expand(spark.createDataFrame([], schema))).count() == 0

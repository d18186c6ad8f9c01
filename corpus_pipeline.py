"""A corpus pipeline: five stages over `documents`, each reading what the one before it wrote.

Each stage takes (spark, docs, sf_dir), works on all of docs, and returns a DataFrame; all but the last return the columns of documents. Models are fitted on documents of the table itself, by the labels that lie beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import common, decontam, mixing, puquality, simhash, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return puquality.keep(docs, puquality.fit(docs, common.table(spark, sf_dir, "labels")))


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: those that share at least 0.8 of their five-word shingles, by their SimHash fingerprints."""
    return simhash.keep_one_of_similar(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights."""
    return mixing.sample(docs)


STAGES = [("quality", quality), ("toxicity", clean_speech), ("near_duplicates", near_duplicates), ("decontamination", no_benchmark), ("mixing", mix)]

#: The classifiers can't be told in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written and read by the next; when that has written its own, they and all else that it wrote on the way are deleted."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with common.discarded(spark) as written:
            docs = common.stored(stage(spark, docs, sf_dir))
            mine = written.pop()
        if before:
            common.remove(spark, before)
        before = mine
    return STAGES[-1][1](spark, docs, sf_dir)

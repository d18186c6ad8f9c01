import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import common, decontam, mixing, puquality, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_run_against_plain_stages(spark):
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    rows = {r["doc_id"]: r for r in docs.collect()}
    left = set(rows)

    def now():
        return spark.createDataFrame([rows[i] for i in sorted(left)], docs.schema)

    model = puquality.fit(docs, labels)
    p = puquality.probabilities(model, [rows[i]["text"] for i in sorted(left)])
    left = {i for i, x in zip(sorted(left), p) if x >= 0.3}
    scorer = toxicity.Scorer(toxicity.fit(now(), labels))
    left = {i for i in left if scorer.score(rows[i]["text"])[0] < 0.7}

    # all pairs of texts that share a band are compared, by the whole fingerprints; the least id of each group stays
    config = simhash.Similar()
    make = simhash.Sketches(config)
    sketches = {i: make.banded(rows[i]["text"] or "") for i in sorted(left)}
    by_band = {}
    for i, (bands, _) in sketches.items():
        for r, key in enumerate(bands.tolist()):
            by_band.setdefault((r, key), []).append(i)
    parent = {i: i for i in left}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in {pair for same in by_band.values() for pair in itertools.combinations(same, 2)}:
        if np.bitwise_count((sketches[i][1] ^ sketches[j][1]).view(np.uint64)).sum() <= config.bits():
            u, v = sorted((root(i), root(j)))
            parent[v] = u
    left = {i for i in left if parent[i] == i}

    windows = set()
    for r in common.table(spark, SF, "benchmark").collect():
        w = decontam.words(r["text"])
        windows |= {tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = lambda w: any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))
    left = {i for i in left if not dirty(decontam.words(rows[i]["text"]))}

    sampled = {r["doc_id"] for r in mixing.mixed(now()).where("sampled").collect()}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == sampled
    assert 0 < len(sampled) < len(left) < len(rows)


def test_stages_keep_columns_and_work_on_empty_tables(spark):
    docs = common.table(spark, SF, "documents")
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.columns == docs.columns and out.count() == 0


def test_planted_documents(spark):
    """Copies, benchmark passages and toxic documents go; a clean one stays up to the sampling."""
    docs = common.table(spark, SF, "documents")
    clean = docs.where("n_chars BETWEEN 800 AND 2000 AND source = 'src1'").limit(1).collect()[0]
    passage = common.table(spark, SF, "benchmark").orderBy(F.desc(F.length("text"))).first()["text"]
    planted = [(10**9 + 1, clean["text"]), (10**9 + 2, clean["text"].replace("a", "o") + " " + passage)]
    more = spark.createDataFrame([(i, t, clean["lang"], clean["source"], len(t)) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    now = docs.unionByName(more)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, now, SF).select("doc_id").collect()}
    assert 10**9 + 1 not in kept
    kept = {r["doc_id"] for r in corpus_pipeline.no_benchmark(spark, now, SF).select("doc_id").collect()}
    assert 10**9 + 2 not in kept and 10**9 + 1 in kept

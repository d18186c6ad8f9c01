import itertools
import random

import xxhash
from pyspark.sql import functions as F

from spanforge.llm import simhash
from spanforge.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: id -> fingerprint"""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in fps}


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    expected = plain_components(fps)
    out = simhash.query(spark, SF).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in out} == fps
    assert {r["doc_id"]: r["component_id"] for r in out} == expected
    assert all(len(r["fingerprint"]) == 16 for r in out) and len(out) == len(rows)


def test_spark_hash_is_the_same(spark):
    texts = ["a b c", "é ü", "x" * 100]
    mine = [simhash.fingerprint(t) for t in texts]
    theirs = [r[0] % 2**64 for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert mine[0] == theirs[0] and mine[1] == theirs[1] and mine[2] == theirs[2]


def _clouds(rng, n):
    """Chains and balls of near fingerprints, with far ones between."""
    fps = {}
    for c in range(12):
        now = rng.getrandbits(64)
        for _ in range(n // 12):
            fps[len(fps)] = now
            for _ in range(rng.choice((1, 2, 2, 3))):
                now ^= 1 << rng.randrange(64)
    return fps


def test_links_in_small_and_large_buckets(spark):
    rng = random.Random(4)
    fps = _clouds(rng, 240)
    base = rng.getrandbits(64)
    for _ in range(150):  # a ball that shares keys
        x = base
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        fps[len(fps)] = x
    expected = plain_components(fps)
    for bucket in (1, 8, 10_000):
        first = {}
        for i, x in sorted(fps.items()):
            first.setdefault(x, i)
        nodes = spark.createDataFrame([([x - (x >> 63 << 64)], i) for x, i in first.items()], "fps array<long>, first long")
        found = {r["node"]: r["component"] for r in components(simhash.links(nodes, simhash.Config(bucket=bucket))).collect()}
        assert {i: found.get(first[x], first[x]) for i, x in fps.items()} == expected


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, i) for i in range(1001, 1200)]
    rng = random.Random(1)
    edges = chain + star + [(5000, 5000)]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {0, 1000} and len(found) == 101 + 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_first_of_each(spark):
    docs = spark.createDataFrame([(5, "one two three four", 1), (3, "One two  three four", 2), (9, None, 3), (8, "", 4), (7, "quite another text here", 5), (7, "quite another text here", 6), (None, "one two three four", 7), (2, "w " * 40_000, 8)], "doc_id long, text string, component long")
    out = {(r["doc_id"], r["component"]) for r in simhash.classes(docs).collect()}
    assert out == {(5, 3), (3, 3), (9, 8), (8, 8), (7, 7), (None, 3), (2, 2)}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, 2, 3, 7, 8]
    assert simhash.classes(docs.limit(0)).count() == 0


def _jaccard(a, b):
    x, y = (({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for w in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_keep_one(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, close, apart = [], [], []
    for g in range(40):
        base = [word() for _ in range(rng.choice((60, 150, 400)))]
        rows.append((g * 10, " ".join(base)))
        for n in range(1, 6):
            changed = list(base)
            for _ in range(rng.randrange(max(2, len(base) // 12))):
                changed[rng.randrange(len(base))] = word()
            j = _jaccard(base, changed)
            (close if j >= 0.85 else apart if j < 0.6 else []).append(g * 10 + n)
            rows.append((g * 10 + n, " ".join(changed)))
    rows += [(900, None), (901, ""), (902, "one two"), (902, "one two"), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit("clash"))
    for config in (simhash.Similar(), simhash.Similar(bucket=2)):
        out = simhash.keep_one_of_similar(df, config)
        assert out.columns == df.columns
        kept = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect())
        assert len(kept) == len(set(kept)) and {-1, 900, 902} | {g * 10 for g in range(40)} <= set(kept) and 901 not in kept
        assert len(close) > 40 and sum(i in kept for i in close) / len(close) < 0.03
        assert len(apart) > 20 and sum(i in kept for i in apart) / len(apart) > 0.9
    assert simhash.keep_one_of_similar(df.limit(0)).count() == 0


def test_different_texts_of_one_id_are_judged_apart(spark):
    text = lambda n: " ".join(f"{chr(97 + n)}{i}" for i in range(10))
    rows = [(3, text(0)), (7, text(0)), (7, text(1)), (17, text(2)), (17, text(3)), (17, text(2)), (None, text(4)), (None, text(4)), (23, text(4)), (22, None), (21, "")]
    kept = simhash.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, text(4)), (-1, text(4)), (3, text(0)), (7, text(1)), (17, text(2)), (17, text(3)), (21, ""), (23, text(4))]


def test_a_group_hangs_together_by_a_text_in_its_middle(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, unlike = [], 0
    for g in range(12):
        base = [word() for _ in range(300)]
        texts = []
        for _ in range(20):
            changed = list(base)
            for i in rng.sample(range(300), 5):
                changed[i] = word()
            texts.append(changed)
        unlike += sum(_jaccard(a, b) < 0.75 for a, b in itertools.combinations(texts, 2))
        texts.insert(10, base)  # copies are like this one, not each other
        rows += [(g * 100 + n, " ".join(x)) for n, x in enumerate(texts)]
    assert unlike > 12 * 150
    kept = {r["doc_id"] for r in simhash.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {g * 100 for g in range(12)} <= kept and len(kept) <= 24


def test_near_copies_among_many_orders_of_one_word_set(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    rows = []
    for g in range(160):
        order = rng.sample(words, 120)
        near = list(order)
        near[50], near[51] = near[51], near[50]
        assert _jaccard(order, near) > 0.85
        rows += [(g, " ".join(order)), (1000 + g, " ".join(near))]
    kept = {r["doc_id"] for r in simhash.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(160))


def test_passages_appended_and_removed(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, close, apart = [], [], []
    for g in range(60):
        base = [word() for _ in range(rng.choice((80, 200, 600)))]
        rows.append((g * 10, " ".join(base)))
        for n, share in enumerate((0.06, 0.1, 0.14, 0.6), 1):
            size = int(len(base) * share)
            at = rng.randrange(len(base) - size)
            changed = [base + [word() for _ in range(size)], base[:at] + base[at + size :], base[:at] + [word() for _ in range(size)] + base[at:]][(g + n) % 3]
            j = _jaccard(base, changed)
            (close if j >= 0.84 else apart if j < 0.66 else []).append(g * 10 + n)
            rows.append((g * 10 + n, " ".join(changed)))
    assert len(close) > 120 and len(apart) > 50
    for config in (simhash.Similar(), simhash.Similar(bucket=1)):
        kept = {r["doc_id"] for r in simhash.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()}
        assert {g * 10 for g in range(60)} <= kept and set(apart) <= kept
        assert sum(i in kept for i in close) <= 2

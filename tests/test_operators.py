import math
import random
import statistics
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.config import EngineConfig
from spanforge.functions import cigar, coerce, orient, text
from spanforge.operators import classify, fragments, intervals, layout, profiles, sets, stats

SPANS = st.lists(st.tuples(st.integers(1, 60), st.integers(0, 12)).map(lambda x: (x[0], x[0] + x[1])), min_size=1, max_size=12)
FEW = settings(max_examples=12, deadline=None)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def spans(spark, rows, key="k"):
    return frame(spark, [(key, a, b) for a, b in rows], "k string, start long, end long")


def bases(rows):
    return {x for a, b in rows for x in range(a, b + 1)}


def test_micro_merge_and_subtract(spark):
    assert values(intervals.merge_spans(spans(spark, [(1, 5), (6, 9), (11, 12), (4, 7)]), ["k"]), "start", "end") == [(1, 9), (11, 12)]
    # the half-open (0,20) without (2,5) and (8,10), as closed intervals
    left = intervals.subtract(spans(spark, [(1, 20)]), spans(spark, [(3, 5), (9, 10)]), ["k"])
    assert values(left, "start", "end") == [(1, 2), (6, 8), (11, 20)]


@FEW
@given(SPANS)
def test_merged_spans_hold_the_same_bases(spark, rows):
    merged = values(intervals.merge_spans(spans(spark, rows), ["k"]), "start", "end")
    assert bases(merged) == bases(rows) and sum(b - a + 1 for a, b in merged) == len(bases(rows))
    assert all(a2 > b1 + 1 for (_, b1), (a2, _) in zip(merged, merged[1:]))


@FEW
@given(SPANS, SPANS)
def test_subtraction_of_bases(spark, whole, parts):
    a, b = min(whole)
    out = values(intervals.subtract(spans(spark, [(a, b)]), spans(spark, parts), ["k"]), "start", "end")
    assert bases(out) == bases([(a, b)]) - bases(parts) and sum(y - x + 1 for x, y in out) == len(bases(out))


def test_merging_by_bins_is_merging(spark):
    rng = random.Random(2)
    groups = [[(1, 1), (1, 1)], [(5, 50)]] + [[(a := rng.randrange(1, 60), a + rng.randrange(13)) for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    rows = frame(spark, [(k or None, a, b) for k, of in enumerate(groups) for a, b in of], "k int, start long, end long")
    wholes = frame(spark, [(k or None, 3, 50) for k in range(len(groups))], "k int, start long, end long").where("k IS NOT NULL")
    key = lambda df: sorted((r["k"] or -1, r["start"], r["end"]) for r in df.collect())
    for size, gap in ((1, 0), (7, 1)):
        assert key(intervals.merge_spans(rows, ["k"], gap=gap, size=size)) == key(intervals.merge_spans(rows, ["k"], gap=gap))
        assert key(intervals.subtract(wholes, rows, ["k"], size=size)) == key(intervals.subtract(wholes, rows, ["k"]))


def test_very_wide_intervals_cost_few_rows(spark):
    points = frame(spark, [("k", 5), ("k", 10**9), ("k", 2 * 10**12)], "k string, p long")
    wide = frame(spark, [("k", 1, 10, 1), ("k", 3, 10**9, 2), ("k", 2, 10**12, 3), ("k", 9, 4, 4)], "k string, s long, e long, i long")
    found = intervals.point_join(points, wide, ["k"], "p", "s", "e", 1000)
    assert values(found, "p", "i") == [(5, 1), (5, 2), (5, 3), (10**9, 2), (10**9, 3)]
    blocks = frame(spark, [("k", 1, 3), ("k", 10**9, 10**9 + 5)], "k string, a long, b long")
    assert values(intervals.overlap_join(blocks, wide, ["k"], ("a", "b"), ("s", "e"), 1000), "a", "i") == [(1, 1), (1, 2), (1, 3), (10**9, 2), (10**9, 3)]
    assert values(intervals.containment_join(blocks, wide, ["k"], ("a", "b"), ("s", "e"), 1000, stretch=6), "a", "i") == [(1, 1), (1, 2), (1, 3), (10**9, 3)]


def test_long_cigars_cost_in_proportion(spark):
    n = 16_000
    text_ = "".join(f"{1 + i % 3}{'MDMIN'[i % 5]}" for i in range(n))
    plain, at, shifted, spot = [], 7, [], 7
    for i in range(n):
        k, op = 1 + i % 3, "MDMIN"[i % 5]
        if op == "M":
            plain.append((at, at + k - 1))
        if op == "D":
            shifted += range(spot + 1, spot + k + 1)
        at += k if op in "MDN" else 0
        spot += k if op in "MD" else 0
    rows = frame(spark, [(7, text_), (7, "3M")], "pos long, cigar string").repartition(1)
    began = time.time()
    out = rows.select(cigar.blocks(F.col("pos"), F.col("cigar")).alias("b"), cigar.deletions_shifted(F.col("pos"), F.col("cigar")).alias("d")).collect()
    assert time.time() - began < 20
    (long,) = [r for r in out if len(r["b"]) > 1]
    assert [tuple(x) for x in long["b"]] == plain and long["d"] == shifted


def test_ranked_rows_are_numbered_in_order(spark):
    rows = frame(spark, [(i * 7919 % 1000, i) for i in range(1000)], "x long, i long").repartition(5)
    out = {r["x"]: r["row_rank"] for r in layout.ranked(rows, [F.desc("x")]).collect()}
    assert out == {x: 1000 - x for x in range(1000)}
    assert layout.ranked(rows.limit(0), ["x"]).count() == 0


def test_subtraction_without_parts(spark):
    out = intervals.subtract(spans(spark, [(5, 9)]), spans(spark, [], "x"), ["k"])
    assert values(out, "start", "end") == [(5, 9)]


def test_gaps_number_all_neighbours(spark):
    rows = spans(spark, [(1, 4), (5, 6), (10, 12), (12, 20)])
    assert values(intervals.gaps(rows, ["k"]), "number", "start", "end") == [(2, 7, 9)]
    assert values(intervals.gaps(rows, ["k"], keep_empty=True), "number", "start", "end") == [(1, 5, 4), (2, 7, 9), (3, 13, 11)]


@FEW
@given(SPANS, SPANS, st.integers(1, 20), st.integers(0, 7))
def test_joins_against_all_pairs(spark, left, right, size, stretch):
    x = frame(spark, [("k", i, a, b) for i, (a, b) in enumerate(left)], "k string, i long, a long, b long")
    y = frame(spark, [("k", j, c, d) for j, (c, d) in enumerate(right)] + [("other", 99, 1, 90)], "k string, j long, c long, d long")
    pairs = [(i, j) for i in range(len(left)) for j in range(len(right))]
    over = sorted((i, j) for i, j in pairs if left[i][0] <= right[j][1] and right[j][0] <= left[i][1])
    assert values(intervals.overlap_join(x, y, ["k"], ("a", "b"), ("c", "d"), size), "i", "j") == over
    held = sorted((i, j) for i, j in pairs if right[j][0] - stretch // 2 <= left[i][0] and left[i][1] <= right[j][1] + stretch - stretch // 2)
    assert values(intervals.containment_join(x, y, ["k"], ("a", "b"), ("c", "d"), size, stretch), "i", "j") == held
    points = sorted((i, j) for i, j in pairs if right[j][0] <= left[i][0] <= right[j][1])
    assert values(intervals.point_join(x, y, ["k"], "a", "c", "d", size), "i", "j") == points
    bands = sorted((i, j) for i, j in pairs if -3 <= left[i][0] - right[j][0] <= 2)
    anchors = y.withColumn("side", F.lit("+"))
    assert values(intervals.band_join(x, anchors, ["k"], "a", "c", "side", 3, 2), "i", "j") == bands


def test_joins_refuse_clashing_columns_and_skip_nulls(spark):
    x = frame(spark, [("k", 1), (None, 2), ("k", None)], "k string, p long")
    y = frame(spark, [("k", 1, 5), (None, 1, 5), ("k", None, 5), ("k", 9, 3)], "k string, s long, e long")
    assert values(intervals.point_join(x, y, ["k"], "p", "s", "e")) == [("k", 1, 1, 5)]
    with pytest.raises(ValueError, match="both sides"):
        intervals.point_join(x, y.withColumn("p", F.lit(1)), ["k"], "p", "s", "e")


def test_hit_audit_keeps_rows_without_a_hit(spark):
    left = frame(spark, [(1,), (2,), (3,)], "i long")
    hits = frame(spark, [(2, "a"), (3, "b"), (3, "c")], "i long, v string")
    out = intervals.hit_audit(left, hits, ["i"], [F.first("v").alias("v")])
    assert [(r["i"], r["n_hits"], r["outcome"]) for r in out.orderBy("i").collect()] == [(1, 0, "none"), (2, 1, "unique"), (3, 2, "ambiguous")]


def test_micro_runs(spark):
    rows = lambda xs: frame(spark, [("k", x) for x in xs], "k string, p long")
    weights = lambda xs: intervals.runs(rows(xs), ["k"], "p").groupBy("p").agg(F.sum("run_weight").alias("w"))
    assert values(weights([-1, -1, 0, 0])) == [(-1, 1.5), (0, 1.5)]
    out = dict(values(weights([3, 4, 5, 9])))
    assert all(math.isclose(out[k], v) for k, v in {3: 1 / 3, 4: 1 / 3, 5: 1 / 3, 9: 1}.items())


@FEW
@given(st.lists(st.tuples(st.integers(-12, 12), st.integers(-3, 9), st.integers(1, 3)), min_size=1, max_size=10))
def test_range_coverage_against_counting(spark, rows):
    df = frame(spark, [("k", a, a + n, w) for a, n, w in rows], "k string, a int, b int, w long")
    out = values(profiles.range_coverage(df, ["k"], F.col("a"), F.col("b"), -5, 8, F.col("w")), "offset_nt", "coverage_count")
    plain = [(x, sum(w for a, n, w in rows if a <= x <= a + n)) for x in range(-5, 9)]
    assert out == [(x, c) for x, c in plain if c]


def test_micro_starts_to_coverage(spark):
    starts = frame(spark, [("i", o, c) for o, c in ((-5, 1), (-1, 2), (0, 1), (3, 4))], "intron_id string, offset_nt int, read_count long")
    limits = frame(spark, [("i", 2)], "intron_id string, branchpoint_to_3ss_nt long")
    out = profiles.starts_to_coverage(starts, ["intron_id"], limits, "branchpoint_to_3ss_nt", -2, 4)
    assert values(out, "offset_nt", "coverage_count") == [(-2, 1), (-1, 3), (0, 4), (1, 4), (2, 4)]


def test_dense_grid_keeps_empty_groups(spark):
    counts = frame(spark, [("a", 0, 3), ("a", 9, 1)], "sample string, offset_nt int, n long")
    out = profiles.dense(counts, frame(spark, [("a",), ("b",)], "sample string"), ["sample"], ["n"], -1, 1)
    assert values(out, "sample", "offset_nt", "n") == [("a", -1, 0), ("a", 0, 3), ("a", 1, 0), ("b", -1, 0), ("b", 0, 0), ("b", 1, 0)]


def test_micro_replicates(spark):
    df = frame(spark, [("x", 1.0), ("x", 2.0), ("x", 4.0), ("y", 7.0)], "c string, v double")
    out = {r["c"]: r for r in stats.replicate_summary(df, ["c"], ["v"]).collect()}
    assert math.isclose(out["x"]["mean_v"], 7 / 3) and math.isclose(out["x"]["sd_v"], statistics.stdev([1, 2, 4]))
    assert math.isclose(out["x"]["ci95_v"], 3.7948892972, rel_tol=1e-9) and math.isclose(out["x"]["sem_v"], 0.8819171037, rel_tol=1e-9)
    assert (out["y"]["sd_v"], out["y"]["sem_v"], out["y"]["ci95_v"], out["y"]["replicate_count"]) == (0.0, 0.0, 0.0, 1)


def test_missing_cells_are_left_out(spark):
    df = frame(spark, [("x", "1"), ("x", "NA"), ("x", "3"), ("y", "NA"), ("y", "inf")], "c string, v string")
    out = {r["c"]: r for r in stats.replicate_summary(df, ["c"], ["v"], skip_missing=True).collect()}
    assert out["x"]["mean_v"] == 2.0 and out["x"]["replicate_count"] == 3 and out["y"]["mean_v"] is None and out["y"]["sd_v"] is None


def test_t_table_variants(spark):
    df = spark.range(0, 40).select(F.col("id").alias("n"), stats.t_critical(F.col("id")).alias("t"), stats.t_critical(F.col("id"), 10).alias("u"))
    out = {r["n"]: (r["t"], r["u"]) for r in df.collect()}
    assert out[1] == (0.0, 0.0) and out[2] == (12.706, 12.706) and out[11][1] == 2.228 and out[12] == (2.201, 1.96) and out[31][0] == 2.042 and out[32][0] == 1.96


def test_micro_percentile_curve(spark):
    df = frame(spark, [(i, n, int(i > 2)) for i, n in enumerate([1, 2, 3, 4], 1)], "i long, r long, q long")
    out = {r["percentile"]: r for r in stats.threshold_curve(df, "r", F.col("q") > 0, "q", 1, 99, F.lit(0.5)).collect()}
    assert (out[50]["cutoff"], out[50]["selected"], out[50]["covered"], out[50]["value_sum"]) == (2.5, 2, 2, 7) and math.isclose(out[50]["expected"], 1.8125)
    for p in out:
        assert math.isclose(out[p]["cutoff"], np.percentile([1, 2, 3, 4], p), abs_tol=1e-9)


def test_micro_discrete_quantiles_and_mode(spark):
    lengths = [20] * 2 + [25, 35, 50]
    df = frame(spark, [("m", x, i, "ab" if i % 2 else "cd") for i, x in enumerate(lengths[:4])] + [("m", 50, 9, "xx")], "k string, n long, i long, s string")
    out = stats.discrete_quantiles(df, ["k"], "n", [0.1, 0.25, 0.5, 0.75, 0.9]).first()
    assert tuple(out)[1:] == (20, 20, 25, 35, 50)
    assert tuple(stats.most_common(df, ["k"], "s", "i").first()) == ("m", "cd", 2)


def test_welch_and_its_p_value(spark):
    df = frame(spark, [("a", x) for x in (1.0, 2.0, 4.0)] + [("b", x) for x in (5.0, 9.0, 7.0, 8.0)], "g string, v double")
    out = stats.welch_test(df, "g", "v", "a", "b")
    assert math.isclose(out["t"], (7 / 3 - 7.25) / math.sqrt(7 / 9 + 35 / 48), rel_tol=1e-9)
    # Student's t with one degree of freedom is Cauchy's, and with two has a closed form
    assert math.isclose(stats.t_two_sided(1.0, 1), 0.5, rel_tol=1e-12)
    assert math.isclose(stats.t_two_sided(3.0, 2), 1 - 3 / math.sqrt(11), rel_tol=1e-10)
    assert stats.t_two_sided(0.0, 5) == 1.0 and 0.005 < out["p_value"] < 0.02
    assert stats.welch(df.where("v = 1"), "g", "v", "a", "b").first()["t"] is None


def test_area_above_baseline(spark):
    df = frame(spark, [("s", p, float(v)) for p, v in ((-6, 1), (-5, 3), (-4, 4), (0, 8), (2, 2), (5, 1), (20, 50))], "k string, p int, v double")
    out = profiles.area_above_baseline(df, ["k"], "p", "v").first()
    assert out["baseline"] == 2.5 and out["area_under_peak"] == 14 - 7.5


def test_sets_and_checks(spark):
    df = frame(spark, [("f", "s1", 5), ("f", "s2", 1), ("g", "s1", 4), ("g", "s2", 9), ("h", "s1", 0)], "f string, s string, n long")
    assert values(sets.analysis_set(df, "f", "s", F.col("n"), 0, 2)) == [("f",), ("g",)]
    assert values(sets.analysis_set(df, "f", "s", F.col("n"), 4, 2)) == [("g",)]
    assert values(sets.require_single(df.withColumn("w", F.lit(3)), ["w"], "no"), "w") == [(3,)]
    with pytest.raises(Exception, match="two windows"):
        sets.require_single(df, ["n"], "two windows").collect()
    with pytest.raises(Exception, match="repeats"):
        sets.require_unique(df, ["f"], "repeats").collect()
    with pytest.raises(ValueError, match="nothing"):
        sets.row_where(df, F.col("n") == 77, "nothing")
    wide = sets.pivot_samples(df, ["f"], "s", ["s2", "s1"], {"n": "n"})
    assert wide.columns == ["f", "s2_n", "s1_n"] and ("h", 0, 0) in values(wide)
    looked = sets.with_default(df, frame(spark, [("g", 1)], "f string, extra int"), ["f"], {"extra": 0})
    assert sorted(r["extra"] for r in looked.collect()) == [0, 0, 0, 1, 1]
    text_ = df.groupBy().agg(sets.ordered_text("s", F.when(F.col("n") > 3, F.col("n")), "n").alias("t")).first()["t"]
    assert text_ == "s1=4;s1=5;s2=9"


def test_coercions_differ(spark):
    cells = frame(spark, [("",), (None,), ("NA",), ("3.9",), ("nan",)], "v string")
    some = cells.where("v <> 'nan' OR v IS NULL")
    assert [r[0] for r in some.where("v IS NULL OR v <> 'NA'").select(coerce.count_or_zero(F.col("v"))).collect()] == [0, 0, 3]
    assert [r[0] for r in some.select(coerce.count_or_zero_na(F.col("v"))).collect()] == [0, 0, 0, 3]
    assert [r[0] for r in some.select(coerce.count_or_null(F.col("v"))).collect()] == [None, None, None, 3]
    assert [r[0] for r in cells.select(coerce.finite_or_null(F.col("v"))).collect()] == [None, None, None, 3.9, None]
    one = spark.range(1).select(coerce.ratio(F.lit(1), F.lit(0)), coerce.ratio_or_null(F.lit(1), F.lit(0)), coerce.cpm(F.lit(2), F.lit(4)), coerce.percent_of(F.lit(1), F.lit(0)), coerce.fixed(F.lit(0.5)), coerce.fixed(F.lit(None).cast("double"))).first()
    assert tuple(one) == (0.0, None, 500000.0, 0.0, "0.500000", "NA")


def test_micro_cigar(spark):
    c = F.lit("5S10M2D3M100N4M1I2M")
    row = spark.range(1).select(cigar.blocks(F.lit(101), c).alias("b"), cigar.reference_end(F.lit(101), c).alias("e"), cigar.is_spliced(c).alias("s"), cigar.span_md(F.lit(101), c).alias("m"), cigar.deletions_shifted(F.lit(101), c).alias("d"), cigar.is_spliced(F.lit("10M0N5M")).alias("z")).first()
    assert [tuple(b) for b in row["b"]] == [(101, 110), (113, 115), (216, 219), (220, 221)]
    assert (row["e"], row["s"], row["m"], row["d"], row["z"]) == (221, True, 122, [112, 113], False)


def test_orientation(spark):
    row = spark.range(1).select(
        orient.offset(F.lit(8), F.lit(10), F.lit("-")), orient.position_at(F.lit(10), F.lit(2), F.lit("-")), orient.three_prime(F.lit(1), F.lit(9), F.lit("-")), *orient.range_offsets(F.lit(3), F.lit(7), F.lit(10), F.lit("-")), *orient.range_offsets_symmetric_minus(F.lit(3), F.lit(17), F.lit(10), F.lit("-"))
    ).first()
    assert tuple(row) == (2, 8, 1, 3, 7, -7, 7)


def test_attributes_and_names(spark):
    a = 'gene_id "A"; gene_id "B"; tag "x"; tag "MANE_Select"; level 2; note "a b"'
    row = spark.range(1).select(text.gtf_attributes(F.lit(a)).alias("m"), text.gtf_attribute(F.lit(a), "gene_id").alias("g"), text.gtf_attribute(F.lit(a), "id").alias("n"), text.has_tag(F.lit(a), "MANE_Select").alias("t"), text.gtf_attributes(F.lit("ID=x;Name=y z;k v"), True).alias("gff")).first()
    assert row["m"] == {"gene_id": "B", "tag": "MANE_Select", "level": "2", "note": "a b"} and row["g"] == "B" and row["n"] is None and row["t"]
    assert row["gff"] == {"ID": "x", "Name": "y z", "k": "v"}
    kinds = frame(spark, [("Mt tRNA",), ("snoRNA",), ("antisense",), ("unprocessed_pseudogene",), ("protein-coding",), ("TEC",)], "t string").select(text.gene_category(text.normalised_type(F.col("t")))).collect()
    assert [r[0] for r in kinds] == [None, "snoRNA", "lncRNA", "pseudogene", "protein_coding", None]
    places = frame(spark, [("16:1,000-2,000",), ("chr1:5-5",), ("chr1:9-5",), ("x",), ("1:0-4",)], "r string").select(text.region(F.col("r")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in places] == [("chr16", 1000, 2000, "chr16:1000-2000"), ("chr1", 5, 5, "chr1:5-5"), None, None, None]
    assert spark.range(1).select(text.file_safe(F.lit("chr1:5-9 (x)"))).first()[0] == "chr1_5_9_x"


def test_priority_classes(spark):
    tiers = [["m"], ["a", "b"], ["c"]]
    rows = frame(spark, [(["a", "c"],), (["a", "b", "c"],), (["m", "a", "b"],), (["z"],), ([],)], "f array<string>")
    out = [r[0] for r in rows.select(classify.by_priority(F.col("f"), tiers, F.when(F.size("f") > 0, "other").otherwise("none"))).collect()]
    assert out == ["a", "ambiguous", "m", "other", "none"]


def test_packing_is_greedy(spark):
    rng = random.Random(5)
    reads = [("s", f"r{i}", a, a + rng.randrange(1, 9)) for i, a in enumerate(rng.randrange(1, 40) for _ in range(60))]
    out = layout.pack_lanes(frame(spark, reads, "sample string, read_name string, xmin long, xmax long"), ["sample"]).collect()
    ends, plain = [], {}
    for s, n, a, b in sorted(reads, key=lambda r: (r[2], r[3], r[1])):
        lane = next((i for i, e in enumerate(ends) if e < a), len(ends))
        ends[lane:lane + 1] = [b]
        plain[n] = lane + 1
    assert {r["read_name"]: r["pack_lane"] for r in out} == plain


def test_samples_repeat_and_are_capped(spark):
    df = frame(spark, [("s", f"r{i}") for i in range(50)], "k string, n string")
    pick = lambda seed: {r["n"] for r in layout.capped_sample(df, ["k"], F.lit(7), [layout.seeded(seed, "n"), F.col("n")]).collect()}
    assert pick(1) == pick(1) and len(pick(1)) == 7 and pick(1) != pick(2)


def test_unique_predicate(spark):
    df = frame(spark, [(1, 0), (2, 60), (None, 1), (None, 0)], "nh int, mapq int").select(fragments.unique(F.col("nh"), F.col("mapq")))
    assert [r[0] for r in df.collect()] == [True, False, True, False]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        EngineConfig(anchor_upstream=-1)
    with pytest.raises(ValueError):
        EngineConfig(percentile_start=60, percentile_end=50)
    assert EngineConfig.with_anchor_window(4).anchor_downstream == 4


def test_plans_have_no_cross_joins(spark, capsys):
    x = frame(spark, [("k", 1, 2)], "k string, a long, b long")
    intervals.overlap_join(x, x.toDF("k", "c", "d"), ["k"], ("a", "b"), ("c", "d")).explain()
    said = capsys.readouterr().out
    assert "NestedLoop" not in said and "Cartesian" not in said

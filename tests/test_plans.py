import math
import random

import genome
import pytest
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.config import EngineConfig
from spanforge.plans import branchpoint, browser, content_levels, downstream, exports, longread, percentile, premrna, references, rna_content, unmapped
from spanforge.sources import tables

CONFIG = EngineConfig(profile_upstream=20, profile_downstream=5, three_prime_upstream=30, three_prime_downstream=10)


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """These plans are large and their tables tiny: without compiled code and runtime replanning they take a fraction of the time."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    (d / "a.gtf").write_text(genome.GTF)
    (d / "bp.tsv").write_text(genome.BRANCHPOINTS, newline="")
    (d / "s1.sam").write_text("\n".join(genome.SAM) + "\n")
    (d / "s2.sam").write_text("\n".join(x for f in genome.FRAGMENTS[:2] for x in genome.pair(*f)) + "\n")
    out = {"gtf": tables.read_gtf(spark, str(d / "a.gtf")), "branchpoints": tables.read_branchpoints(spark, str(d / "bp.tsv")), "alignments": tables.read_sam(spark, [str(d / "s1.sam"), str(d / "s2.sam")])}
    out["introns"] = references.selected_introns(out["gtf"])
    out["reference"] = references.branchpoint_reference(out["introns"], out["branchpoints"])
    out["samples"] = spark.createDataFrame([("s1", "ILS", 0), ("s2", "DIS", 1), ("s3", "DIS", 1)], schemas.SAMPLES)
    return out


@pytest.fixture(scope="module")
def quantified(made):
    q = branchpoint.Quantified(made["alignments"], made["reference"], made["samples"], CONFIG)
    yield q
    q.close()


def by(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows.collect()}


def test_branchpoint_reference(made):
    rows = by(made["reference"], "intron_id")
    assert {k: (r["intron_start"], r["intron_end"], r["three_prime_ss"], r["branchpoint_position"], r["branchpoint_to_3ss_nt"], r["branchpoint_candidates"], r["branchpoint_type"]) for k, r in rows.items()} == {
        "T1:intron_1": (201, 300, 300, 280, 20, 2, "U2"),
        "T1:intron_2": (401, 500, 500, 470, 30, 1, "U2"),
        "T2:intron_1": (1101, 1200, 1101, 1125, 24, 1, "U12"),
    }
    assert made["reference"].columns == schemas.BRANCHPOINT_REFERENCE.names and rows["T2:intron_1"]["gene_name"] == "G2"
    hits = references.assign_branchpoints(made["introns"], made["branchpoints"])
    assert tuple(references.assignment_counts(made["branchpoints"], hits).first()) == (5, 4, 1, 0)


def test_summary_and_conservation(quantified):
    rows = by(quantified.summary(), "sample")
    one = rows["s1"]
    expected = {"library_fragments": 8, "anchored_fragments": 3, "fragments_without_branchpoint_anchor": 2, "ambiguous_anchor_fragments": 0, "filtered_five_prime_outside_intron": 1, "three_prime_spanning_fragments": 4, "fragments_without_three_prime_coverage_assignment": 2, "exact_branchpoint_fragments": 2, "plus_one_branchpoint_fragments": 1, "zero_or_plus_one_branchpoint_fragments": 3, "anchored_introns_with_reads": 2, "three_prime_introns_with_coverage": 2, "reference_introns": 3, "read1_records_examined": 13, "filtered_secondary_or_supplementary": 1, "profile_window_fragments": 3, "anchor_window_nt": 10}
    expected |= {f"filtered_{k}": 1 for k in ("unmapped_or_mate_unmapped", "improper_pair", "nonunique", "missing_fragment_end", "missing_mate_alignment", "spliced_fragments")}
    assert {k: one[k] for k in expected} == expected
    assert math.isclose(one["anchored_fragments_cpm"], 3e6 / 8) and math.isclose(one["plus_one_branchpoint_percent_anchored"], 100 / 3)
    for r in rows.values():
        before = ["unmapped_or_mate_unmapped", "improper_pair", "nonunique", "missing_fragment_end"]
        assert sum(r[f"filtered_{k}"] for k in before) + r["library_fragments"] == {"s1": 12, "s2": 2, "s3": 0}[r["sample"]]
        after = r["filtered_missing_mate_alignment"] + r["filtered_spliced_fragments"] + r["fragments_without_branchpoint_anchor"] + r["ambiguous_anchor_fragments"] + r["filtered_five_prime_outside_intron"] + r["anchored_fragments"]
        assert after == r["library_fragments"]
    assert rows["s3"]["library_fragments"] == 0 and rows["s3"]["anchored_fragments_cpm"] == 0.0


def test_site_and_offset_tables(quantified):
    offsets = sorted((r["sample"], r["intron_id"], r["offset_nt"], r["read_count"]) for r in quantified.offset_counts().collect())
    assert offsets == [("s1", "T1:intron_1", 0, 1), ("s1", "T1:intron_1", 1, 1), ("s1", "T2:intron_1", 0, 1), ("s2", "T1:intron_1", 0, 1), ("s2", "T1:intron_1", 1, 1)]
    sites = by(quantified.site_counts(), "sample", "intron_id")
    r = sites["s1", "T1:intron_1"]
    assert (r["anchored_fragments"], r["exact_branchpoint_fragments"], r["zero_or_plus_one_branchpoint_percent_anchored"], r["exact_branchpoint_cpm"]) == (2, 1, 100.0, 125000.0)
    first = [r["intron_id"] for r in quantified.site_counts().where("sample = 's1'").collect()]
    assert first == ["T1:intron_1", "T2:intron_1"]  # one exact each, then more anchored first


def test_three_prime_coverage_and_profile(quantified):
    rows = quantified.three_prime_coverage().where("sample = 's1'").collect()
    depth = {(r["intron_id"], r["offset_nt"]): r["coverage_count"] for r in rows}
    ranges = {"T1:intron_1": [(-19, 1), (-50, 2), (-40, 10)], "T2:intron_1": [(-24, 1)]}
    plain = {(i, x): n for i, rs in ranges.items() for x in range(-30, 11) if (n := sum(a <= x <= b for a, b in rs))}
    assert depth == plain and {r["three_prime_spanning_fragments"] for r in rows if r["intron_id"] == "T1:intron_1"} == {3}
    profile = quantified.metaprofile().collect()
    assert len(profile) == 3 * 26 and sum(r["read_count"] for r in profile) == 5
    at = {(r["sample"], r["offset_nt"]): r for r in profile}
    assert at["s1", 0]["read_count"] == 2 and math.isclose(at["s1", 1]["anchored_percent"], 100 / 3)


def test_aggregated_profiles(spark, quantified):
    a = branchpoint.Aggregated(quantified.site_counts(), quantified.offset_counts(), quantified.three_prime_coverage(), quantified.summary(), CONFIG)
    assert a.samples == ["s1", "s2", "s3"]
    introns = a.analysis_introns().collect()
    assert [(r["intron_id"], r["s1_anchored_fragments"], r["s2_anchored_fragments"], r["s3_anchored_fragments"], r["min_anchored_fragments_across_samples"]) for r in introns] == [("T2:intron_1", 1, 0, 0, 0), ("T1:intron_1", 2, 2, 0, 0)]
    profile = by(a.metaprofile_by_sample(), "sample", "offset_nt")
    assert [profile["s1", x]["coverage_count"] for x in (-1, 0, 1, 5)] == [0, 2, 3, 3] and profile["s2", 5]["coverage_anchored_percent"] == 100.0
    condition = by(a.by_condition(a.metaprofile_by_sample()), "condition", "offset_nt")
    r = condition["DIS", 5]
    assert (r["replicate_count"], r["mean_coverage_count"]) == (2, 1.0) and math.isclose(r["sd_coverage_count"], math.sqrt(2)) and math.isclose(r["ci95_coverage_count"], 12.706)
    assert condition["ILS", 0]["ci95_read_count"] == 0.0
    three = by(a.three_prime_by_sample(), "sample", "offset_nt")
    assert three["s1", 0]["coverage_count"] == 4 and math.isclose(three["s1", 2]["coverage_spanning_percent"], 50.0)
    assert by(a.three_prime_by_sample(True), "sample", "offset_nt")["s1", 0]["coverage_count"] == 4
    summary = by(a.summary_by_sample(), "sample")
    assert summary["s1"]["introns_included_in_analysis"] == 2 and summary["s1"]["raw_anchored_fragments"] == 3 and summary["s2"]["three_prime_introns_with_coverage"] == 1
    assert math.isclose(by(a.summary_by_condition(), "condition")["DIS"]["mean_anchored_fragments"], 1.0)
    strict = branchpoint.Aggregated(quantified.site_counts().where("sample <> 's3'"), quantified.offset_counts(), quantified.three_prime_coverage(), quantified.summary().where("sample <> 's3'"), EngineConfig(analysis_min_reads=2))
    assert [r[0] for r in strict.introns.collect()] == ["T1:intron_1"]
    strict.close()
    a.close()


def test_downstream_exon(made):
    d = downstream.Downstream(made["alignments"], made["reference"], made["samples"], EngineConfig(profile_upstream=25, profile_downstream=35))
    rows = by(d.summary_by_sample(), "sample")
    one = rows["s1"]
    assert (one["downstream_exon_spanning_fragments"], one["downstream_exon_spanning_introns"], one["mean_downstream_exon_end_offset_nt"], one["fragments_without_downstream_exon_assignment"], one["profiled_coverage_positions"]) == (1, 1, 10.0, 5, 51)
    assert one["condition_union_downstream_exon_spanning_introns"] == 1 and rows["s2"]["condition_union_downstream_exon_spanning_introns"] == 0
    profile = by(d.metaprofile_by_sample(), "sample", "offset_nt")
    assert [profile["s1", x]["coverage_count"] for x in (-21, -20, 30, 31)] == [0, 1, 1, 0] and profile["s1", -20]["read_start_percent"] == 100.0
    assert by(d.metaprofile_by_condition(), "condition", "offset_nt")["ILS", 0]["mean_coverage_count"] == 1.0
    assert by(d.summary_by_condition(), "condition")["ILS"]["mean_library_fragments"] == 8.0
    d.close()


def test_genes_and_duplicates(spark, made):
    rows = by(references.genes(made["gtf"]), "gene_id")
    one, two = rows["G1"], rows["G2"]
    assert [tuple(s) for s in one["intron_spans"]] == [(201, 300), (401, 500)] and (one["three_prime_end"], one["terminal_exon_start"], one["exonic_length"], one["exon_count"], one["intron_count"], one["transcript_length"]) == (600, 501, 300, 3, 2, 500)
    assert (two["three_prime_end"], two["terminal_exon_start"], two["terminal_exon_end"]) == (1001, 1001, 1100)
    double = made["gtf"].unionByName(made["gtf"].where("feature IN ('transcript', 'exon') AND start >= 1001").withColumn("attributes", F.replace("attributes", F.lit("T2"), F.lit("T9"))))
    with pytest.raises(Exception, match="more than one MANE"):
        references.genes(double).collect()
    assert [tuple(r)[:2] for r in references.small_rna_genes(made["gtf"]).collect()] == [("S1", "sno")]


def gene_pairs():
    lines = genome.pair("exonic", "+", 110, 190) + genome.pair("spliced", "+", 185, 310, mate="2M100N8M") + genome.pair("intronic", "+", 195, 260)
    lines += genome.pair("nothing", "+", 3000, 3100) + genome.pair("small", "+", 310, 349) + genome.pair("minus", "-", 1290, 1210) + genome.pair("end", "+", 570, 595)
    return lines + [x.replace("\t60\t", "\t0\t").replace("\tNH:i:1", "") for x in genome.pair("low", "+", 110, 190)]


def test_premrna(spark, made, tmp_path):
    for s in ("a", "b"):
        (tmp_path / f"{s}.sam").write_text("\n".join(gene_pairs()) + "\n")
    alignments = tables.read_sam(spark, [str(tmp_path / "a.sam"), str(tmp_path / "b.sam")])
    samples = spark.createDataFrame([("a", "ILS", 0), ("b", "DIS", 1)], schemas.SAMPLES)
    config = EngineConfig(premrna_upstream=40, premrna_downstream=5, shared_min_reads=1)
    q = premrna.Quantified(alignments, references.genes(made["gtf"]), references.small_rna_genes(made["gtf"]), samples, config)
    kinds = {r["qname"]: (r["kind"], r["gene_id"]) for r in q.classified.where("sample = 'a'").collect()}
    # the mate of "spliced" covers 301-302 and 403-410: an intron of the gene
    assert kinds == {"exonic": ("mrna", "G1"), "spliced": ("intronic", "G1"), "intronic": ("intronic", "G1"), "nothing": ("no_gene_overlap", None), "small": ("small_ncrna_overlap", "G1"), "minus": ("mrna", "G2"), "end": ("mrna", "G1")}
    counts = by(q.gene_counts(), "sample", "gene_id")
    assert (counts["a", "G1"]["mrna_fragments"], counts["a", "G1"]["intronic_fragments"], counts["a", "G1"]["intronic_to_mrna_ratio"]) == (2, 2, 1.0)
    depth = {r["offset_nt"]: r["coverage_count"] for r in q.coverage().where("sample = 'a' AND gene_id = 'G1'").collect()}
    # mates 570-579 and 586-595 about 600
    assert depth == {x: 1 for x in [*range(-30, -20), *range(-14, -4)]}
    summary = by(q.summary(), "sample")["a"]
    assert (summary["library_fragments"], summary["filtered_nonunique"], summary["assigned_gene_fragments"], summary["genes_with_reads"], summary["profiled_coverage_positions"], summary["reference_genes"]) == (7, 1, 5, 2, 20, 2)
    g = premrna.Aggregated(q.gene_counts(), q.coverage(), q.summary(), config)
    assert [r["gene_id"] for r in g.shared_genes().collect()] == ["G2", "G1"]
    profile = by(g.metaprofile_by_condition(), "condition", "offset_nt")
    assert profile["DIS", -30]["mean_coverage_percent_gene_reads"] == 20.0 and profile["DIS", 5]["mean_coverage_count"] == 0.0
    assert by(g.summary_by_condition(), "condition")["ILS"]["mean_intronic_to_mrna_ratio"] == 2 / 3
    with pytest.raises(ValueError, match="no gene"):
        premrna.Aggregated(q.gene_counts(), q.coverage(), q.summary(), EngineConfig(shared_min_reads=100))
    q.close()


def test_rna_content(spark, made, tmp_path):
    lines = genome.pair("coding", "+", 110, 190) + genome.pair("intron", "-", 1160, 1120) + genome.pair("sno", "+", 335, 390) + genome.pair("lnc", "-", 2090, 2040) + genome.pair("genic", "+", 2120, 2150) + genome.pair("none", "+", 4000, 4050)
    lines += [x.replace("chr1", "chrM") for x in genome.pair("mito", "+", 5, 40)] + [genome.sam_line("gone", 77, "*", 0, 0, "*", "*", 0, 0)]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    alignments = tables.read_sam(spark, str(tmp_path / "a.sam"))
    found = rna_content.classified(alignments, references.rna_categories(made["gtf"]))
    kinds = {r["qname"]: r["category"] for r in found.collect()}
    assert kinds == {"coding": "protein_coding_exon", "intron": "protein_coding_intron", "sno": "snoRNA", "lnc": "lncRNA", "genic": "other_annotated_genic", "none": "intergenic", "mito": "mitochondrial"}
    inputs = spark.createDataFrame([("a", 20, 10)], "sample string, total_input_pairs long, genome_input_pairs long")
    extra = spark.createDataFrame([("a", 4)], "sample string, n long")
    content = rna_content.content(spark, found, inputs, extra, extra)
    rows = content.collect()
    assert [r["category"] for r in rows] == list(rna_content.OUTPUT)
    at = {r["category"]: tuple(r)[2:] for r in rows}
    assert at["genome_unmapped"] == (3, "0.150000", "NA") and at["rRNA"] == (4, "0.200000", "0.235294") and at["miRNA"] == (0, "0.000000", "0.000000")
    with pytest.raises(Exception, match="more pairs are mapped"):
        rna_content.content(spark, found, inputs.withColumn("genome_input_pairs", F.lit(3).cast("long")), extra, extra).collect()
    assert rna_content.distinct_names(alignments).first()["n"] == 7
    broad = by(content_levels.broad(content), "broad_category")
    assert math.isclose(sum(r["percent_mapped"] for r in broad.values()), 100.0) and broad["pre-mRNA"]["percent_total"] == 5.0
    placed = content_levels.label_places(content_levels.broad(content))
    assert math.isclose(max(r["label_x"] + r["percent_mapped"] / 2 for r in placed.collect()), 100.0)
    subtypes = by(content_levels.subtypes(content), "subtype")
    assert set(subtypes) == {"mitochondrial", "snoRNA", "lncRNA", "other annotated/ambiguous"}
    assert content_levels.mapped_pairs(content).first()["mapped_pairs"] == 15


def test_percentile_overlap(spark):
    rows = [("ILS", "i1", 0, f"n{k}", k) for k in (1, 2, 3, 4)] + [("DIS", "d1", 1, "n3", 5), ("DIS", "d2", 2, "n4", 0), ("DIS", "d1", 1, "n9", 5)]
    sites = spark.createDataFrame([(*r, f"g{r[3]}") for r in rows], "condition string, sample string, ordinal int, intron_id string, anchored_fragments long, gene_name string")
    o = percentile.Overlap(sites, "ILS", "DIS", ["gene_name"], EngineConfig(percentile_start=1, percentile_end=99))
    curve = by(o.summary(), "reference_percentile_cutoff")
    r = curve[50]
    assert (r["reference_anchored_fragment_cutoff"], r["reference_introns_at_or_above_cutoff"], r["query_introns_with_any_anchored_fragments"], r["query_covered_percent"], r["total_reference_anchor_positive_introns"], r["random_thinning_fraction"]) == (2.5, 2, 1, 50.0, 4, 1.0)
    introns = o.intron_counts().collect()
    assert [(r["intron_id"], r["query_samples_with_anchored_fragments"]) for r in introns] == [("n4", 0), ("n3", 1), ("n2", 0), ("n1", 0)]
    pie = {r["category"]: r["percent"] for r in exports.pie(o.summary(), "DIS").collect()}
    assert pie == {"observed in DIS": 50.0, "not observed in DIS": 50.0}
    with pytest.raises(ValueError, match="no row of condition"):
        percentile.Overlap(sites, "ILS", "XXX", [])
    with pytest.raises(ValueError, match="no percentile"):
        exports.pie(o.summary(), "DIS", 100)
    assert exports.figure(o.summary(), "percentile").columns == list(exports.FIGURES["percentile"])


def test_unmapped_reads(spark):
    seqs = ["ACGTACGTACGTAA"] * 2 + ["T" * 25, "G" * 35, "T" * 50]
    reads = spark.createDataFrame([("R1", i, s) for i, s in enumerate(seqs)], "mate string, ordinal long, sequence string")
    one, two = unmapped.summary_of_mates(reads).collect()
    assert (one["total_reads"], one["mean_length"], one["p10_length"], one["median_length"], one["p90_length"], one["max_length"], one["reads_le_20"], one["reads_le_40"]) == (5, 27.6, 14, 25, 50, 50, 2, 4)
    assert (one["top_prefix_12"], one["top_prefix_12_count"], one["top_suffix_12"], one["top_suffix_12_count"]) == ("ACGTACGTACGT", 2, "GTACGTACGTAA", 2)
    assert (two["mate"], two["total_reads"], two["top_prefix_12"]) == ("R2", 0, "")


def naive_runs(rows):
    """rows: (position, events) of one read and branchpoint."""
    positions = sorted(p for p, n in rows for _ in range(n))
    weights, at = {}, 0
    for i in range(1, len(positions) + 1):
        if i == len(positions) or positions[i] - positions[i - 1] != 1:
            for p in positions[at:i]:
                weights[p] = weights.get(p, 0.0) + 1 / (i - at)
            at = i
    return weights


def test_run_weights_without_repeating_rows(spark):
    rng = random.Random(8)
    groups = {g: sorted({rng.randrange(14): rng.choice((1, 1, 2, 3, 5)) for _ in range(8)}.items()) for g in range(60)}
    df = spark.createDataFrame([("s", g, 0, p, n) for g, rows in groups.items() for p, n in rows], "sample string, read long, ordinal long, strand_corrected_position int, events long")
    out = {(r["read"], r["strand_corrected_position"]): r["weight"] for r in longread._run_weights(df).collect()}
    for g, rows in groups.items():
        for p, w in naive_runs(rows).items():
            assert math.isclose(out[g, p], w), (g, rows)


def test_long_reads(spark, made, tmp_path):
    selected = spark.createDataFrame([("G1", "T1"), ("G2", "T2")], "gene_id string, transcript_id string")
    introns = references.long_read_introns(made["gtf"], selected)
    assert sorted((r["intron_id"], r["start"], r["end"]) for r in introns.collect()) == [("G1:1", 201, 300), ("G1:2", 401, 500), ("G2:1", 1101, 1200)]
    top = {r["top"]: r["position"] for r in longread.top_branchpoints(introns, made["branchpoints"]).collect()}
    assert top == {"G1:1": 275, "G1:2": 470, "G2:1": 1125}  # of equal scores the first in the file
    assert {r[0] for r in longread.single_introns(introns, longread.top_branchpoints(introns, made["branchpoints"])).collect()} == {"G1:1", "G1:2", "G2:1"}
    read = lambda name, flag, pos, cigar, mapq=60: genome.sam_line(name, flag, "chr1", pos, mapq, cigar, "*", 0, 0)
    lines = [read("a", 0, 251, "20M3D20M"), read("b", 0, 290, "40M"), read("c", 16, 1110, "12M1D20M"), read("low", 0, 251, "20M3D20M", 20), read("second", 256, 251, "20M3D20M"), read("d", 0, 460, "30M")]
    for s in ("x", "y"):
        (tmp_path / f"{s}.sam").write_text("\n".join(lines) + "\n")
    long = longread.LongReads(tables.read_sam(spark, [str(tmp_path / "x.sam"), str(tmp_path / "y.sam")]), introns, made["branchpoints"], EngineConfig(long_three_prime_half_width=20, long_branchpoint_half_width=15))
    spans = {r["rs"]: r["re"] for r in long.reads.where("sample = 'x'").collect()}
    assert spans == {251: 294, 290: 330, 1110: 1143, 460: 490}
    three = by(long.three_prime_coverage(), "protein", "strand_corrected_position")
    # only b reaches a splice site: 290-330 about 300, cut to -10..20, of which 20 is beyond the window
    assert [three["x", p]["score"] for p in (-11, -10, 0, 19)] == [0, 1, 1, 1] and len(three) == 80 and three["x", 0]["normalised_coverage"] == 1.0
    cover = by(long.branchpoint_coverage(), "protein", "strand_corrected_position")
    # a: 251-294 about 275 -> -15..15; c: 1110-1143 about 1125, symmetric -> -15..15; d: 460-490 about 470 -> -10..15
    assert [cover["x", p]["score"] for p in (-15, -11, -10, 0, 15)] == [2, 2, 3, 3, 3]
    rows = by(long.deletion_profile(), "protein", "strand_corrected_position")
    # a deletes 272-274 as 1-based shifted positions, c 1123: about 275, 280 and 1125. a overlaps two branchpoints.
    expected = {}
    for p, bps in ((272, (275, 280)), (273, (275, 280)), (274, (275, 280))):
        for b in bps:
            expected[p - b] = expected.get(p - b, 0) + 2
    expected[1125 - 1123] = expected.get(2, 0) + 1
    assert {k[1]: r["count"] for k, r in rows.items() if k[0] == "x"} == expected
    r = rows["x", -3]
    assert math.isclose(r["normalised_count"], 2 / 3) and math.isclose(r["coverage_normalised"], 2 / 3)
    areas = long.area().collect()
    values = {k[1]: v["coverage_normalised"] for k, v in rows.items() if k[0] == "x"}
    base = sorted(values.values())
    median = (base[(len(base) - 1) // 2] + base[len(base) // 2]) / 2
    assert len(areas) == 2 and math.isclose(areas[0]["baseline"], median) and math.isclose(areas[0]["area_under_peak"], sum(v - median for p, v in values.items() if -4 <= p <= 2))
    told = {(r["scope"], r["metric"]): r["value"] for r in long.diagnostics().collect()}
    assert told["x", "filtered_primary_alignments"] == 4 and told["reference", "introns"] == 3 and told["x", "deletion_reads"] == 2 and told["x", "deletion_normalisation_read_overlaps"] == 3 and told["analysis", "union_covered_introns"] == 3
    long.close()


def test_browser(spark, made):
    genes = references.genes(made["gtf"])
    region = browser.gene_region(genes, "One")
    assert region == {"chrom": "chr1", "start": 1, "end": 700}
    with pytest.raises(ValueError, match="no gene"):
        browser.gene_region(genes, "None")
    samples = made["samples"].withColumn("intronic_fragments", F.lit(2).cast("long"))
    view = browser.View(made["alignments"], genes, made["reference"], samples, region, EngineConfig(max_reads_per_condition=6))
    depth = by(view.coverage(), "condition", "position")
    # s1: both reads of f1 and f2 hold 290 or not, by their ends
    plain = sum(a <= 290 <= a + 9 for n, s, five, three in genome.FRAGMENTS if s == "+" for a in (five, three - 9)) + 2  # and those of no_end
    assert math.isclose(depth["ILS", 290]["mean_coverage_per_million_intronic_reads"], plain * 5e5)
    reads = view.reads().collect()
    assert all(r["xmin"] <= r["xmax"] for r in reads) and len({(r["sample"], r["ymin"], r["xmin"]) for r in reads}) == len(reads)
    marks = view.annotations().collect()
    assert [r["feature_type"] for r in marks] == ["branchpoint"] * 2 + ["exon"] * 3 + ["gene_label"] + ["intron"]
    empty = browser.View(made["alignments"], genes, made["reference"], samples, {"chrom": "chr1", "start": 4000, "end": 4100})
    assert [r["label"] for r in empty.annotations().collect()] == ["no shared genes in region"]
    stat = view.statistics("One").first()
    assert stat["annotated_shared_genes"] == 1 and stat["branchpoint_annotations"] == 2 and stat["region"] == "chr1:1-700"


def test_manifest_and_counts(spark, made, quantified):
    rows = exports.manifest(spark, {"ils_dis_pie": "pie.pdf"}, {"ils_dis_pie": "pie.tsv"}).collect()
    assert len(rows) == 13 and [r["plot_files"] for r in rows if r["table_file"] == "pie.tsv"] == ["pie.pdf"]
    a = branchpoint.Aggregated(quantified.site_counts(), quantified.offset_counts(), quantified.three_prime_coverage(), quantified.summary(), CONFIG)
    d = downstream.Downstream(made["alignments"], made["reference"], made["samples"], CONFIG)
    gene = spark.createDataFrame([("s1", "ILS", 0, "7", 2, 10), ("s9", "ILS", 0, "NA", 2, 10)], "sample string, condition string, condition_ordinal int, assigned_gene_fragments string, shared_genes long, shared_min_total_reads_all_samples long")
    sites = quantified.site_counts().withColumn("ordinal", F.lit(1))
    forth, back = percentile.Overlap(sites, "ILS", "DIS", ["gene_name"]), percentile.Overlap(sites, "DIS", "ILS", ["gene_name"])
    stat = spark.createDataFrame([("chr1:1-9", "One", 1, 2, 3, 4, 5, 300, 1)], "region string, requested_gene string, annotated_shared_genes long, branchpoint_annotations long, candidate_read_alignments long, drawn_distinct_reads long, packed_read_rows long, max_reads_per_condition long, random_seed long")
    counts = exports.plot_counts(a.summary_by_sample(), d.summary_by_sample(), gene, forth.summary(), back.summary(), stat, {"ils_dis_pie": "pie.pdf"})
    assert counts.columns == list(exports.COUNT_COLUMNS)
    rows = counts.collect()
    assert len(rows) == 2 * 4 + 1 + 1 + 3 + 4
    first = next(r for r in rows if r["plot_id"] == "combined_metaprofile_panel" and r["condition"] == "DIS")
    assert first["per_sample_read_counts"] == "s2=2;s3=0" and first["selection"] == "all_anchor_positive_introns_union" and "the -10..+1 nt 3'SS anchor window" in first["notes"]
    gene_row = next(r for r in rows if r["plot_id"] == "proportion_exonic_combined_plot")
    assert gene_row["per_sample_read_counts"] == "s1=7" and gene_row["selection"] == "shared_genes_with_min_10_total_gene_reads_in_every_sample"
    d.close()

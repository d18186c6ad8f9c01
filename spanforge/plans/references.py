"""References made from annotation: introns with branchpoints, genes with spans, RNA categories, long-read introns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.functions import orient, text
from spanforge.operators import intervals, sets
from spanforge.sources import tables

#: Categories of RNA content that annotation gives.
SMALL = ("snoRNA", "scaRNA", "miRNA", "tRNA", "ribozyme", "vaultRNA", "misc_RNA", "snRNA")
ANNOTATION_CATEGORIES = (*SMALL, "lncRNA", "protein_coding_intron", "protein_coding_exon", "pseudogene")


#: Rows of a reference of introns as they are written.
GENOMIC = ("chrom", "intron_start", "intron_end", "transcript_id")


def selected_introns(gtf: DataFrame) -> DataFrame:
    """Introns between the sorted exons of protein-coding MANE Select transcripts; numbered by genomic order on both strands."""
    rows = gtf.where(F.col("feature").isin("transcript", "exon") & F.col("attributes").contains('gene_type "protein_coding"') & text.has_tag(F.col("attributes"), "MANE_Select"))
    rows = tables.attributes(rows, "transcript_id", "gene_id", "gene_name").where("transcript_id IS NOT NULL AND gene_id IS NOT NULL")
    transcripts = rows.where("feature = 'transcript'").select("transcript_id", "gene_id", F.coalesce("gene_name", "gene_id").alias("gene_name"), "chrom", "strand")
    found = intervals.gaps(rows.where("feature = 'exon'").select("transcript_id", "start", "end"), ["transcript_id"])
    introns = found.join(transcripts, "transcript_id")
    named = introns.withColumn("intron_id", F.concat("transcript_id", F.lit(":intron_"), F.col("number").cast("string")))
    return named.withColumnRenamed("number", "intron_number").select(*schemas.INTRONS.names)


def assign_branchpoints(introns: DataFrame, branchpoints: DataFrame) -> DataFrame:
    """Each branchpoint with each intron that holds it."""
    points = branchpoints.select("chrom", "strand", "position", "score", "intron_type", "ordinal")
    return intervals.point_join(points, introns, ["chrom", "strand"], "position", "start", "end")


def assignment_counts(branchpoints: DataFrame, hits: DataFrame) -> DataFrame:
    """(points, assigned, unassigned, ambiguous), one row."""
    audited = intervals.hit_audit(branchpoints.select("ordinal"), hits, ["ordinal"])
    return audited.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("n_hits") > 0).alias("assigned"), F.count_if(F.col("n_hits") == 0).alias("unassigned"), F.count_if(F.col("n_hits") > 1).alias("ambiguous"))


def branchpoint_reference(introns: DataFrame, branchpoints: DataFrame) -> DataFrame:
    """One row for each intron with a branchpoint: its best candidate by score, then nearness to the three-prime end, then the position furthest along, then intron type. Rows are in genomic order."""
    hits = assign_branchpoints(introns, branchpoints)
    ss = orient.three_prime(F.col("start"), F.col("end"), F.col("strand"))
    distance = F.when(F.col("strand") == "+", ss - F.col("position")).otherwise(F.col("position") - ss)
    along = F.when(F.col("strand") == "+", F.col("position")).otherwise(-F.col("position"))
    # The maximum of a struct picks the row in one pass of partial aggregates, without a sort.
    rank = F.struct(F.col("score"), -distance, along)
    best = hits.groupBy("intron_id").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("candidates"))
    tied = hits.withColumn("rank", rank).join(best, "intron_id").where(F.col("rank") == F.col("top")).groupBy("intron_id").agg(F.min("intron_type").alias("branchpoint_type"), F.max("candidates").cast("int").alias("branchpoint_candidates"), F.max("position").alias("branchpoint_position"), F.max("score").alias("branchpoint_score"))
    out = introns.join(tied, "intron_id").withColumn("three_prime_ss", ss)
    out = out.withColumnsRenamed({"start": "intron_start", "end": "intron_end"})
    return out.withColumns({"intron_length": F.col("intron_end") - F.col("intron_start") + 1, "branchpoint_to_3ss_nt": orient.offset(F.col("three_prime_ss"), F.col("branchpoint_position"), F.col("strand"))}).select(*schemas.BRANCHPOINT_REFERENCE.names).orderBy(*GENOMIC)


def genes(gtf: DataFrame) -> DataFrame:
    """One row for each gene with a MANE Select transcript: ends, terminal exon, lengths, merged exons and the introns between them. Raises if a gene has two such transcripts."""
    rows = tables.attributes(gtf.where(F.col("feature").isin("transcript", "exon") & text.has_tag(F.col("attributes"), "MANE_Select")), "gene_id", "gene_type", "transcript_id", "gene_name")
    rows = rows.where((text.normalised_type(F.col("gene_type")) == "protein_coding") & F.col("gene_id").isNotNull() & F.col("transcript_id").isNotNull())
    merged = intervals.merge_spans(rows.where("feature = 'exon'").select("transcript_id", "start", "end"), ["transcript_id"])
    spans = merged.groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exon_spans"))
    transcripts = rows.where("feature = 'transcript'").select("gene_id", F.coalesce("gene_name", "gene_id").alias("gene_name"), "transcript_id", "chrom", "strand", F.col("start").alias("transcript_start"), F.col("end").alias("transcript_end"))
    both = sets.require_unique(transcripts.join(spans, "transcript_id"), ["gene_id"], "a gene has more than one MANE Select transcript")
    n = F.size("exon_spans")
    between = F.transform(F.slice("exon_spans", F.lit(1), n - 1), lambda x, i: F.struct((x["end"] + 1).alias("start"), (F.get(F.col("exon_spans"), i + 1)["start"] - 1).alias("end")))
    plus = F.col("strand") == "+"
    last = F.element_at("exon_spans", F.when(plus, -1).otherwise(1))
    return both.withColumn("intron_spans", F.filter(between, lambda s: s["start"] <= s["end"])).select(
        "gene_id",
        "gene_name",
        "transcript_id",
        "chrom",
        "strand",
        "transcript_start",
        "transcript_end",
        F.when(plus, F.col("transcript_end")).otherwise(F.col("transcript_start")).alias("three_prime_end"),
        last["start"].alias("terminal_exon_start"),
        last["end"].alias("terminal_exon_end"),
        (F.col("transcript_end") - F.col("transcript_start") + 1).alias("transcript_length"),
        F.aggregate("exon_spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"] + 1).alias("exonic_length"),
        n.alias("exon_count"),
        F.size("intron_spans").alias("intron_count"),
        "exon_spans",
        "intron_spans",
    )


def small_rna_genes(gtf: DataFrame) -> DataFrame:
    rows = tables.attributes(gtf.where("feature = 'gene'"), "gene_id", "gene_type", "gene_name")
    category = text.small_rna_category(text.normalised_type(F.col("gene_type")))
    return rows.withColumn("category", category).where("gene_id IS NOT NULL AND category IS NOT NULL").select("gene_id", F.coalesce("gene_name", "gene_id").alias("gene_name"), "chrom", "strand", "start", "end", "category")


def rna_categories(gtf: DataFrame) -> DataFrame:
    """(category, chrom, start, end), merged within each: whole genes of each kind, exons and the rest of protein-coding genes, and "annotated" for any gene."""
    rows = tables.attributes(gtf.where(F.col("feature").isin("gene", "exon")), "gene_id", "gene_type").where("gene_id IS NOT NULL AND gene_type IS NOT NULL")
    kind = text.gene_category(text.normalised_type(F.col("gene_type")))
    rows = rows.withColumn("category", kind)
    whole = rows.where("feature = 'gene'")
    coding = whole.where("category = 'protein_coding'").groupBy("gene_id", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    exons = rows.where("feature = 'exon' AND category = 'protein_coding'").select("gene_id", "chrom", "start", "end").join(coding.select("gene_id", "chrom"), ["gene_id", "chrom"], "left_semi")
    introns = intervals.subtract(coding, exons, ["gene_id", "chrom"])
    parts = [
        whole.where("category <> 'protein_coding'").select("category", "chrom", "start", "end"),
        whole.select(F.lit("annotated").alias("category"), "chrom", "start", "end"),
        exons.select(F.lit("protein_coding_exon").alias("category"), "chrom", "start", "end"),
        introns.select(F.lit("protein_coding_intron").alias("category"), "chrom", "start", "end"),
    ]
    all_parts = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return intervals.merge_spans(all_parts, ["category", "chrom"])


def long_read_introns(gtf: DataFrame, selected: DataFrame) -> DataFrame:
    """Gaps between the exons of each gene's selected transcript, empty ones too. Raises if a transcript lies on two chromosomes or strands."""
    as_map = text.gtf_attributes(F.col("attributes"), or_equals=True)
    rows = gtf.where("feature = 'exon'").withColumn("m", as_map).select(F.col("m")["gene_id"].alias("gene_id"), F.col("m")["transcript_id"].alias("transcript_id"), F.coalesce(F.col("m")["gene_name"], F.lit("")).alias("gene_name"), "chrom", "strand", "start", "end")
    exons = rows.join(selected, ["gene_id", "transcript_id"], "left_semi")
    placed = exons.groupBy("gene_id").agg(F.max("transcript_id").alias("transcript_id"), F.max("gene_name").alias("gene_name"), F.min("chrom").alias("chrom"), F.max("chrom").alias("c2"), F.min("strand").alias("strand"), F.max("strand").alias("s2"))
    placed = sets.require(placed, (F.col("chrom") == F.col("c2")) & (F.col("strand") == F.col("s2")), "exons of a transcript lie on two chromosomes or strands").drop("c2", "s2")
    found = intervals.gaps(exons.select("gene_id", "start", "end"), ["gene_id"], keep_empty=True)
    named = found.join(placed, "gene_id").withColumn("intron_id", F.concat("gene_id", F.lit(":"), F.col("number").cast("string")))
    return named.withColumnRenamed("number", "intron_number").select(*schemas.INTRONS.names)

"""What kinds of RNA a library's pairs come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import cigar, coerce
from spanforge.operators import classify, fragments, intervals, sets

from .references import SMALL

#: The rows of the table, in their order.
OUTPUT = ("rRNA", "snRNA", "mitochondrial", "snoRNA", "scaRNA", "miRNA", "tRNA", "ribozyme", "vaultRNA", "misc_RNA", "lncRNA", "protein_coding_intron", "protein_coding_exon", "pseudogene", "other_annotated_genic", "intergenic", "ambiguous", "genome_unmapped")
TIERS = (("mitochondrial",), SMALL, ("lncRNA",), ("protein_coding_intron",), ("protein_coding_exon",), ("pseudogene",))
MITOCHONDRIAL = ("chrM", "MT", "M")


def classified(alignments: DataFrame, categories: DataFrame, bin_size: int = 1000) -> DataFrame:
    """(sample, qname, category) of each pair with a mapped primary record; strands don't matter."""
    mapped = alignments.where(~fragments.flag(fragments.NOT_PRIMARY) & ~fragments.flag(fragments.UNMAPPED))
    blocks = mapped.select("sample", "qname", F.col("rname").alias("chrom"), F.explode(cigar.blocks(F.col("pos"), F.col("cigar"))).alias("b")).select("sample", "qname", "chrom", F.col("b.start").alias("bs"), F.col("b.end").alias("be"))
    pairs = intervals.overlap_join(blocks, categories.select("category", "chrom", F.col("start").alias("s"), F.col("end").alias("e")), ["chrom"], ("bs", "be"), ("s", "e"), bin_size)
    mitochondrial = mapped.where(F.col("rname").isin(*MITOCHONDRIAL)).select("sample", "qname", F.lit("mitochondrial").alias("category"))
    # A pair without any overlap still has a row, of no category.
    found = mapped.select("sample", "qname", F.lit(None).cast("string").alias("category")).unionByName(pairs.select("sample", "qname", "category")).unionByName(mitochondrial)
    per = found.groupBy("sample", "qname").agg(F.collect_set("category").alias("found"))
    rest = F.when(F.array_contains("found", "annotated"), "other_annotated_genic").otherwise("intergenic")
    return per.select("sample", "qname", classify.by_priority(F.col("found"), TIERS, rest).alias("category"))


def distinct_names(alignments: DataFrame) -> DataFrame:
    """(sample, n): names with a primary mapped record."""
    mapped = alignments.where(~fragments.flag(fragments.NOT_PRIMARY) & ~fragments.flag(fragments.UNMAPPED))
    return mapped.groupBy("sample").agg(F.count_distinct("qname").alias("n"))


def content(spark: SparkSession, pairs: DataFrame, input_pairs: DataFrame, rrna: DataFrame, snrna: DataFrame) -> DataFrame:
    """(sample, category, count, fraction_of_total_input_pairs, fraction_of_classified_pairs), all categories in their order for each sample.

    pairs: classified(). input_pairs: (sample, total_input_pairs, genome_input_pairs). rrna, snrna: (sample, n). Raises if more pairs are mapped than went in.
    """
    counts = pairs.groupBy("sample", "category").agg(F.count(F.lit(1)).alias("n"))
    mapped = counts.groupBy("sample").agg(F.sum("n").alias("mapped"))
    base = input_pairs.join(mapped, "sample", "left").na.fill(0, ["mapped"]).withColumn("unmapped", F.col("genome_input_pairs") - F.col("mapped"))
    base = sets.require(base, F.col("unmapped") >= 0, "more pairs are mapped than were given")
    extra = rrna.select("sample", F.lit("rRNA").alias("category"), "n").unionByName(snrna.select("sample", F.lit("snRNA").alias("category"), "n")).unionByName(base.select("sample", F.lit("genome_unmapped").alias("category"), F.col("unmapped").alias("n")))
    all_ = counts.unionByName(extra).groupBy("sample", "category").agg(F.sum("n").alias("count"))
    order = spark.createDataFrame(list(enumerate(OUTPUT)), "ordinal int, category string")
    grid = base.select("sample", "total_input_pairs", (F.col("total_input_pairs") - F.col("unmapped")).alias("classified")).crossJoin(F.broadcast(order))
    rows = grid.join(all_, ["sample", "category"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    of_total = coerce.ratio(F.col("count"), F.col("total_input_pairs"))
    of_classified = F.when(F.col("category") != "genome_unmapped", coerce.ratio_or_null(F.col("count"), F.col("classified")))
    return rows.orderBy("sample", "ordinal").select("sample", "category", "count", coerce.fixed(of_total).alias("fraction_of_total_input_pairs"), coerce.fixed(of_classified).alias("fraction_of_classified_pairs"))

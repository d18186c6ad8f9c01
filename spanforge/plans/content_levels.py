"""Shares of RNA kinds for drawing: broad groups of what mapped, kinds within the smallest of them, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the main groups; all others are other RNA.
BROAD = {"rRNA": "rRNA", "snRNA": "snRNA", "protein_coding_intron": "pre-mRNA", "protein_coding_exon": "mRNA", "intergenic": "intergenic"}
BROAD_ORDER = ("rRNA", "snRNA", "pre-mRNA", "mRNA", "intergenic", "other RNA")

#: Kinds within other RNA.
SUBTYPES = {
    "mitochondrial": "mitochondrial",
    "snoRNA": "snoRNA",
    "scaRNA": "scaRNA",
    "miRNA": "miRNA",
    "tRNA": "tRNA",
    "ribozyme": "ribozyme",
    "vaultRNA": "vaultRNA",
    "misc_RNA": "misc_RNA",
    "lncRNA": "lncRNA",
    "pseudogene": "pseudogene",
    "other_annotated_genic": "other annotated/ambiguous",
    "ambiguous": "other annotated/ambiguous",
}


def _named(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("category")]


def _rows(content: DataFrame) -> DataFrame:
    """What mapped, with the condition, the sample's name up to its first underscore."""
    rows = content.where("category <> 'genome_unmapped'")
    return rows.withColumns({"condition": F.regexp_extract("sample", "^[^_]+", 0), "percent_total": F.col("fraction_of_total_input_pairs").cast("double") * 100})


def broad(content: DataFrame) -> DataFrame:
    """(sample, condition, broad_category, percent_total, mapped_percent_of_input, percent_mapped), in the groups' order."""
    named = _rows(content).withColumn("broad_category", F.coalesce(_named(BROAD), F.lit("other RNA")))
    sums = named.groupBy("sample", "condition", "broad_category").agg(F.sum("percent_total").alias("percent_total"))
    mapped = F.sum("percent_total").over(Window.partitionBy("sample", "condition"))
    order = F.array_position(F.array(*[F.lit(x) for x in BROAD_ORDER]), F.col("broad_category"))
    out = sums.withColumn("mapped_percent_of_input", mapped).withColumn("percent_mapped", F.try_divide("percent_total", "mapped_percent_of_input") * 100)
    return out.orderBy("sample", order)


def label_places(shares: DataFrame) -> DataFrame:
    """broad() with label_x, the middle of each group's part of a stacked bar."""
    order = F.array_position(F.array(*[F.lit(x) for x in BROAD_ORDER]), F.col("broad_category"))
    up_to = Window.partitionBy("sample", "condition").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return shares.withColumn("label_x", F.sum("percent_mapped").over(up_to) - F.col("percent_mapped") / 2)


def subtypes(content: DataFrame) -> DataFrame:
    """(sample, condition, subtype, percent_total, mapped_percent_of_input, percent_mapped, mean_percent) of kinds that any sample has."""
    named = _rows(content).withColumn("subtype", _named(SUBTYPES)).where("subtype IS NOT NULL")
    sums = named.groupBy("sample", "condition", "subtype").agg(F.sum("percent_total").alias("percent_total"))
    mapped = broad(content).select("sample", "condition", "mapped_percent_of_input").distinct()
    out = sums.join(mapped, ["sample", "condition"]).withColumn("percent_mapped", F.try_divide("percent_total", "mapped_percent_of_input") * 100)
    return out.withColumn("mean_percent", F.avg("percent_mapped").over(Window.partitionBy("subtype"))).where("mean_percent > 0")


def subtype_means(content: DataFrame, conditions: list[str]) -> DataFrame:
    """(subtype, one column for each condition): mean shares, side by side."""
    return subtypes(content).groupBy("subtype").pivot("condition", conditions).agg(F.avg("percent_mapped"))


def mapped_pairs(content: DataFrame) -> DataFrame:
    """(sample, condition, mapped_pairs, mapped_pairs_millions)"""
    return _rows(content).groupBy("sample", "condition").agg(F.sum("count").alias("mapped_pairs")).withColumn("mapped_pairs_millions", F.col("mapped_pairs") / 1e6).orderBy("sample")

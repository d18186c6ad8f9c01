"""Read pairs as fragments, with the reason that a pair is left out.

All tests of a lane are one column, `reason`: the first test that a pair fails, or null. One aggregation over it gives all audit counts, where a chain of filters would need a job for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import cigar

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, READ1 = 0x1, 0x2, 0x4, 0x8, 0x10, 0x40
NOT_PRIMARY = 0x900  # secondary or supplementary


def flag(bit: int, col: Column | None = None) -> Column:
    return (F.col("flag") if col is None else col).bitwiseAND(F.lit(bit)) != 0


def unique(nh: Column, mapq: Column) -> Column:
    """One place only: by NH where it is known, else by a mapping quality above 0."""
    return F.when(nh.isNotNull(), nh == 1).otherwise(mapq > 0)


def _facts() -> Column:
    return F.struct("flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "nh")


def pairs(alignments: DataFrame) -> DataFrame:
    """One row for each (sample, qname): the only primary read 1 and read 2, null where there is none or are several, and how many records of read 1 there were.

    Everything is an aggregate with partial sums, so nothing but the two records of a pair is gathered, whatever the number of secondary ones.
    """
    primary, first = ~flag(NOT_PRIMARY), flag(READ1)

    def only(condition: Column) -> Column:
        return F.when(F.count_if(condition) == 1, F.max(F.when(condition, _facts())))

    return alignments.groupBy("sample", "qname").agg(
        only(primary & first).alias("r1"),
        only(primary & ~first).alias("r2"),
        F.count_if(first).alias("read1_records"),
        F.count_if(first & ~primary).alias("read1_not_primary"),
    )


def _three_prime_end(r: Column, strand: Column) -> Column:
    return F.when(strand == "+", F.when(r["tlen"] != 0, r["pos"] - 1 + F.abs(r["tlen"]))).otherwise(F.when(r["pnext"] > 0, r["pnext"]))


def oriented(pairs_: DataFrame) -> DataFrame:
    """Adds chrom, strand, five_prime and three_prime of the fragment, and the reason of the lanes that need continuous fragments.

    Reasons, in order: no_single_read1 (in no audit bucket), unmapped_or_mate_unmapped, improper_pair, nonunique, missing_fragment_end; what passes these is the library. Then missing_mate_alignment and spliced_fragments.
    """
    r = F.col("r1")
    strand = F.when(flag(REVERSE, r["flag"]), "-").otherwise("+")
    five = F.when(flag(REVERSE, r["flag"]), cigar.reference_end(r["pos"], r["cigar"])).otherwise(r["pos"])
    spliced = cigar.is_spliced(r["cigar"]) | cigar.is_spliced(F.col("r2.cigar"))
    reason = (
        F.when(r.isNull(), "no_single_read1")
        .when(flag(UNMAPPED | MATE_UNMAPPED, r["flag"]), "unmapped_or_mate_unmapped")
        .when(~flag(PROPER, r["flag"]) | ~r["rname"].eqNullSafe(r["rnext"]), "improper_pair")
        .when(~unique(r["nh"], r["mapq"]), "nonunique")
        .when(F.col("three_prime").isNull(), "missing_fragment_end")
        .when(F.col("r2").isNull(), "missing_mate_alignment")
        .when(spliced, "spliced_fragments")
    )
    placed = pairs_.withColumns({"chrom": r["rname"], "strand": strand, "five_prime": five}).withColumn("three_prime", _three_prime_end(r, F.col("strand")))
    return placed.withColumn("reason", reason).withColumn("in_library", F.col("reason").isNull() | F.col("reason").isin("missing_mate_alignment", "spliced_fragments"))


def audit(fragments: DataFrame, reasons: list[str], prefix: str = "filtered_") -> DataFrame:
    """(sample, library_fragments, read1_records_examined, filtered_...): one aggregation."""
    return fragments.groupBy("sample").agg(
        F.sum("read1_records").alias("read1_records_examined"),
        F.count_if("in_library").alias("library_fragments"),
        F.sum("read1_not_primary").alias("filtered_secondary_or_supplementary"),
        *[F.count_if(F.col("reason") == r).alias(f"{prefix}{r}") for r in reasons],
    )


CONTINUOUS_REASONS = ["unmapped_or_mate_unmapped", "improper_pair", "nonunique", "missing_fragment_end", "missing_mate_alignment", "spliced_fragments"]


def gene_lane(alignments: DataFrame) -> DataFrame:
    """Pairs for counting on genes: one row for each (sample, qname) with strand, its aligned blocks as (chrom, start, end), reason and in_library.

    Only mapped primary records count. Reasons: without_primary_mapped_alignment, missing_or_multiple_read1, unmapped_or_mate_unmapped, improper_pair, nonunique. Unlike the other lane, neither the mate's record nor the fragment's end nor splicing matter. Both mates go by read 1's strand.
    """
    good = ~flag(NOT_PRIMARY) & ~flag(UNMAPPED)
    first = good & flag(READ1)
    spans = F.transform(cigar.blocks(F.col("pos"), F.col("cigar")), lambda s: F.struct(F.col("rname").alias("chrom"), s["start"].alias("start"), s["end"].alias("end")))
    grouped = alignments.groupBy("sample", "qname").agg(
        F.count_if(good).alias("n"),
        F.when(F.count_if(first) == 1, F.max(F.when(first, _facts()))).alias("r1"),
        F.flatten(F.collect_list(F.when(good, spans))).alias("blocks"),
    )
    r = F.col("r1")
    reason = (
        F.when(F.col("n") == 0, "without_primary_mapped_alignment")
        .when(r.isNull(), "missing_or_multiple_read1")
        .when(flag(MATE_UNMAPPED, r["flag"]), "unmapped_or_mate_unmapped")
        .when(~flag(PROPER, r["flag"]) | ~r["rname"].eqNullSafe(r["rnext"]), "improper_pair")
        .when(~unique(r["nh"], r["mapq"]), "nonunique")
    )
    return grouped.select("sample", "qname", F.when(flag(REVERSE, r["flag"]), "-").otherwise("+").alias("strand"), "blocks", reason.alias("reason")).withColumn("in_library", F.col("reason").isNull())


GENE_REASONS = ["without_primary_mapped_alignment", "missing_or_multiple_read1", "unmapped_or_mate_unmapped", "improper_pair", "nonunique"]


def region_alignments(alignments: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Properly paired, unspliced, uniquely placed primary alignments that touch a region and whose mate is on the same chromosome.

    On Parquet sorted by place, the bounds on rname and pos prune row groups; the end needs the CIGAR.
    """
    bad = UNMAPPED | MATE_UNMAPPED | 0x100 | 0x200 | 0x400 | 0x800
    kept = alignments.where((F.col("rname") == chrom) & (F.col("pos") <= end) & flag(PROPER) & ~flag(bad) & (F.col("rnext") == F.col("rname")))
    fine = unique(F.col("nh"), F.col("mapq")) & ~F.col("cigar").contains("N")
    return kept.where(fine & (cigar.reference_end(F.col("pos"), F.col("cigar")) >= start))

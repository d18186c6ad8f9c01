"""Column types of the tables that analyses read and pass on. Coordinates are 1-based and closed throughout."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _struct(text: str) -> T.StructType:
    """Of "name type, ..."; made without a session, which Spark's own parser needs."""
    return T.StructType([T.StructField(name, _SPANS if kind == "spans" else _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


ALIGNMENTS = _struct("sample string, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, nh int")
GTF = _struct("chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string")
INTRONS = _struct("intron_id string, transcript_id string, intron_number int, gene_id string, gene_name string, chrom string, strand string, start long, end long")
BRANCHPOINTS = _struct("chrom string, position long, strand string, score double, intron_type string, ordinal long")
BRANCHPOINT_REFERENCE = _struct(
    "intron_id string, transcript_id string, intron_number int, gene_id string, gene_name string, chrom string, strand string, intron_start long, intron_end long, intron_length long, three_prime_ss long, branchpoint_position long, branchpoint_score double, branchpoint_to_3ss_nt long, branchpoint_type string, branchpoint_candidates int"
)
SAMPLES = _struct("sample string, condition string, condition_ordinal int")
SPAN = _struct("start long, end long")
GENES = _struct(
    "gene_id string, gene_name string, transcript_id string, chrom string, strand string, transcript_start long, transcript_end long, three_prime_end long, terminal_exon_start long, terminal_exon_end long, transcript_length long, exonic_length long, exon_count int, intron_count int, exon_spans spans, intron_spans spans"
)
SMALL_NCRNA = _struct("gene_id string, gene_name string, chrom string, strand string, start long, end long, category string")
FASTQ = _struct("ordinal long, name string, sequence string, quality string")
FASTA = _struct("ordinal long, name string, sequence string")

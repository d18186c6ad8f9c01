"""Analyses from files to files.

    python -m spanforge.run references --gtf a.gtf --branchpoints bp.tsv --out refs
    python -m spanforge.run branchpoint --alignments *.bam --references refs --samples samples.tsv --out out
    python -m spanforge.run longread --alignments *.bam --gtf a.gtf --transcripts longest.tsv --branchpoints bp.tsv --out out

Alignments are BAM files, SAM text or Parquet of alignments, of the sample that their names tell up to the first dot. samples.tsv has sample and condition, in the order in which conditions are shown. Each table is a folder of its name in --out, tab-separated with a header, compressed where it is one of every position.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.config import EngineConfig
from spanforge.plans import branchpoint, downstream, longread, percentile, premrna, references, rna_content
from spanforge.sources import binary, tables


def read_alignments(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    kinds = {p.rstrip("/").rsplit(".", 1)[-1] for p in paths}
    if len(kinds) != 1:
        raise ValueError("alignments must be files of one kind")
    kind = kinds.pop()
    if kind == "bam":
        binary.register(spark)
        return spark.read.format("bam").load(",".join(paths))
    return tables.read_sam(spark, list(paths)) if kind in ("sam", "gz", "txt") else spark.read.parquet(*paths)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Conditions are numbered in the order of the file."""
    rows = tables.in_file_order(tables.read_tsv(spark, path, "sample string, condition string"))
    first = rows.groupBy("condition").agg(F.min("ordinal").alias("first"))
    # conditions are few
    numbered = first.select("condition", (F.row_number().over(Window.orderBy("first")) - 1).alias("condition_ordinal"))
    return rows.drop("ordinal").join(F.broadcast(numbered), "condition").select("sample", "condition", "condition_ordinal")


def make_references(spark: SparkSession, given: argparse.Namespace) -> dict[str, DataFrame]:
    gtf = tables.read_gtf(spark, given.gtf)
    introns = references.selected_introns(gtf)
    made = {"introns": introns, "genes": references.genes(gtf), "small_rna": references.small_rna_genes(gtf), "categories": references.rna_categories(gtf)}
    if given.branchpoints:
        made["branchpoints"] = references.branchpoint_reference(introns, tables.read_branchpoints(spark, given.branchpoints))
    tables.write_reference(made, given.out, "overwrite")
    return {}


def run_branchpoint(spark: SparkSession, given: argparse.Namespace) -> dict[str, DataFrame]:
    config = EngineConfig(analysis_min_reads=given.min_reads)
    reference = tables.read_reference(spark, given.references, "branchpoints", schemas.BRANCHPOINT_REFERENCE)
    q = branchpoint.Quantified(read_alignments(spark, given.alignments), reference, read_samples(spark, given.samples), config)
    sites, offsets, three, summary = q.site_counts(), q.offset_counts(), q.three_prime_coverage(), q.summary()
    a = branchpoint.Aggregated(sites, offsets, three, summary, config)
    by_sample, coverage, every = a.metaprofile_by_sample(), a.three_prime_by_sample(), a.three_prime_by_sample(all_introns=True)
    return {
        "site_counts": sites, "offset_counts.gz": offsets, "three_prime_coverage.gz": three, "summary": summary, "metaprofile": q.metaprofile(),
        "analysis_introns": a.analysis_introns(), "metaprofile_by_sample": by_sample, "metaprofile_by_condition": a.by_condition(by_sample),
        "three_prime_by_sample": coverage, "three_prime_by_condition": a.by_condition(coverage), "three_prime_all_by_sample": every, "three_prime_all_by_condition": a.by_condition(every),
        "summary_by_sample": a.summary_by_sample(), "summary_by_condition": a.summary_by_condition(),
    }


def run_premrna(spark: SparkSession, given: argparse.Namespace) -> dict[str, DataFrame]:
    config = EngineConfig(shared_min_reads=given.min_reads)
    genes, small = (tables.read_reference(spark, given.references, n, s) for n, s in (("genes", schemas.GENES), ("small_rna", schemas.SMALL_NCRNA)))
    q = premrna.Quantified(read_alignments(spark, given.alignments), genes, small, read_samples(spark, given.samples), config)
    counts, coverage, summary = q.gene_counts(), q.coverage(), q.summary()
    a = premrna.Aggregated(counts, coverage, summary, config)
    return {
        "gene_counts": counts, "coverage.gz": coverage, "summary": summary, "shared_genes": a.shared_genes(), "summary_by_sample": a.summary_by_sample(), "summary_by_condition": a.summary_by_condition(),
        "metaprofile_by_sample": a.metaprofile_by_sample(), "metaprofile_by_condition": a.metaprofile_by_condition(),
    }


def run_downstream(spark: SparkSession, given: argparse.Namespace) -> dict[str, DataFrame]:
    reference = tables.read_reference(spark, given.references, "branchpoints", schemas.BRANCHPOINT_REFERENCE)
    d = downstream.Downstream(read_alignments(spark, given.alignments), reference, read_samples(spark, given.samples))
    return {"summary_by_sample": d.summary_by_sample(), "summary_by_condition": d.summary_by_condition(), "metaprofile_by_sample": d.metaprofile_by_sample(), "metaprofile_by_condition": d.metaprofile_by_condition()}


def run_content(spark: SparkSession, given: argparse.Namespace) -> dict[str, DataFrame]:
    """--pairs: a table of sample, total_input_pairs, genome_input_pairs, rrna and snrna."""
    categories = tables.read_reference(spark, given.references, "categories", categories=["annotated", "protein_coding_exon"])
    went = tables.read_tsv(spark, given.pairs, "sample string, total_input_pairs long, genome_input_pairs long, rrna long, snrna long")
    pairs = rna_content.classified(read_alignments(spark, given.alignments), categories)
    n = lambda c: went.select("sample", F.col(c).alias("n"))
    return {"rna_content": rna_content.content(spark, pairs, went.select("sample", "total_input_pairs", "genome_input_pairs"), n("rrna"), n("snrna"))}


def run_longread(spark: SparkSession, given: argparse.Namespace) -> dict[str, DataFrame]:
    introns = references.long_read_introns(tables.read_gtf(spark, given.gtf), tables.read_selected_transcripts(spark, given.transcripts))
    reads = longread.LongReads(read_alignments(spark, given.alignments), introns, tables.read_branchpoints(spark, given.branchpoints))
    return {"three_prime_splice_site_coverage": reads.three_prime_coverage(), "branchpoint_coverage": reads.branchpoint_coverage(), "branchpoint_deletion_metaprofile": reads.deletion_profile(), "branchpoint_deletion_auc": reads.area(), "diagnostics": reads.diagnostics()}


def run_overlap(spark: SparkSession, given: argparse.Namespace) -> dict[str, DataFrame]:
    """--sites: tables of site counts. Both conditions are ranked in turn."""
    sites = tables.in_file_order(tables.read_tsv(spark, given.sites))
    metadata = [c for c in branchpoint.METADATA if c in sites.columns]
    out = {}
    for a, b in ((given.conditions[0], given.conditions[1]), (given.conditions[1], given.conditions[0])):
        found = percentile.Overlap(sites, a, b, metadata)
        out |= {f"{a}_{b}_introns": found.intron_counts(), f"{a}_{b}_percentiles": found.summary()}
    return out


#: What each analysis needs.
ANALYSES: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "references": (make_references, ("gtf", "branchpoints?")),
    "branchpoint": (run_branchpoint, ("alignments", "references", "samples", "min_reads?")),
    "premrna": (run_premrna, ("alignments", "references", "samples", "min_reads?")),
    "downstream": (run_downstream, ("alignments", "references", "samples")),
    "content": (run_content, ("alignments", "references", "pairs")),
    "longread": (run_longread, ("alignments", "gtf", "transcripts", "branchpoints")),
    "overlap": (run_overlap, ("sites", "conditions")),
}
_MANY = ("alignments", "sites", "conditions")


def parse(arguments: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="spanforge.run", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = parser.add_subparsers(dest="analysis", required=True)
    for name, (_, options) in ANALYSES.items():
        one = kinds.add_parser(name)
        one.add_argument("--out", required=True)
        for option in options:
            key, optional = option.rstrip("?"), option.endswith("?")
            more = {"type": int, "default": 0 if name == "branchpoint" else 10} if key == "min_reads" else {"nargs": "+"} if key in _MANY else {}
            one.add_argument(f"--{key.replace('_', '-')}", required=not optional, **more)
    return parser.parse_args(arguments)


def run(spark: SparkSession, given: argparse.Namespace) -> None:
    for name, df in ANALYSES[given.analysis][0](spark, given).items():
        tables.write_tsv(df, f"{given.out}/{name.removesuffix('.gz')}", gzip=name.endswith(".gz"), na=True, mode="overwrite")


def main() -> None:
    given = parse()
    spark = SparkSession.builder.appName(f"spanforge {given.analysis}").getOrCreate()
    run(spark, given)
    spark.stop()


if __name__ == "__main__":
    main()

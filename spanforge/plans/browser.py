"""Tables of a genome browser view: coverage, reads in lanes, annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.config import EngineConfig
from spanforge.functions import cigar, coerce
from spanforge.operators import fragments, intervals, layout, profiles, sets


def gene_region(genes: DataFrame, name: str, margin: int = 100) -> dict:
    """chrom, start and end about the first gene of that name."""
    row = sets.row_where(genes.orderBy("gene_name", "gene_id"), F.col("gene_name") == name, f"no gene {name}").first()
    return {"chrom": row["chrom"], "start": max(1, row["transcript_start"] - margin), "end": row["transcript_end"] + margin}


def genes_in(genes: DataFrame, region: dict, names: list[str] | None = None) -> DataFrame:
    """Genes that touch the region, numbered by their place."""
    found = genes.where((F.col("chrom") == region["chrom"]) & (F.col("transcript_start") <= region["end"]) & (F.col("transcript_end") >= region["start"]))
    found = found.where(F.col("gene_name").isin(names)) if names else found
    from pyspark.sql import Window

    # The genes of one view are few.
    return found.withColumn("annotation_y", F.row_number().over(Window.orderBy("transcript_start", "transcript_end", "gene_name")))


class View:
    def __init__(self, alignments: DataFrame, genes: DataFrame, reference: DataFrame, samples: DataFrame, region: dict, config: EngineConfig = EngineConfig(), names: list[str] | None = None):
        """samples: (sample, condition, condition_ordinal, intronic_fragments)."""
        self.samples, self.region, self.config = samples, region, config
        self.alignments = fragments.region_alignments(alignments, region["chrom"], region["start"], region["end"])
        self.genes = genes_in(genes, region, names)
        inside = reference.where((F.col("chrom") == region["chrom"]) & F.col("branchpoint_position").between(region["start"], region["end"]))
        self.branchpoints = inside.join(self.genes.select("gene_id", "annotation_y"), "gene_id")

    def coverage(self) -> DataFrame:
        """Mean depth per million intronic fragments, each condition's, at every position of the region."""
        r = self.region
        blocks = self.alignments.select("sample", F.explode(cigar.blocks(F.col("pos"), F.col("cigar"))).alias("b"))
        depth = profiles.range_coverage(blocks, ["sample"], F.col("b.start"), F.col("b.end"), r["start"], r["end"], name="position")
        full = profiles.dense(depth, self.samples, ["sample"], ["coverage_count"], r["start"], r["end"], "position")
        scaled = coerce.ratio_or_null(F.col("coverage_count") * 1e6, F.col("intronic_fragments"))
        out = full.withColumn("scaled", scaled).groupBy("condition_ordinal", "condition", "position").agg(F.avg("scaled").alias("mean_coverage_per_million_intronic_reads"))
        return out.orderBy("condition_ordinal", "position").drop("condition_ordinal")

    def _span(self) -> tuple[Column, Column]:
        b = cigar.blocks(F.col("pos"), F.col("cigar"))
        return F.greatest(F.array_min(F.transform(b, lambda s: s["start"])), F.lit(self.region["start"]).cast("long")), F.least(F.array_max(F.transform(b, lambda s: s["end"])), F.lit(self.region["end"]).cast("long"))

    def reads(self) -> DataFrame:
        """Rectangles of a repeatable sample of each sample's reads, packed into lanes that are stacked by condition and sample."""
        c = self.config
        per = self.samples.groupBy("condition").agg(F.ceil(F.lit(c.max_reads_per_condition) / F.count(F.lit(1))).alias("cap"))
        named = self.samples.select("sample", "condition", "condition_ordinal").join(per, "condition")
        mine = self.alignments.withColumnRenamed("qname", "read_name").join(F.broadcast(named), "sample")
        few = layout.capped_sample(mine, ["condition", "sample"], F.col("cap"), [layout.seeded(c.random_seed, "read_name", "flag", "pos"), F.col("read_name"), F.col("flag"), F.col("pos")])
        start, end = self._span()
        spans = few.withColumns({"xmin": start, "xmax": end}).where("xmin <= xmax").select("condition_ordinal", "condition", "sample", "read_name", "xmin", "xmax")
        packed = layout.pack_lanes(spans, ["condition", "sample"])
        heights = packed.groupBy("sample").agg(F.max("pack_lane").alias("row_count"))
        lanes = self.samples.select("sample", "condition_ordinal").join(heights, "sample", "left").withColumn("row_count", F.coalesce("row_count", F.lit(1)))
        stacked = layout.stack_lanes(lanes, ["condition_ordinal", "sample"], "row_count").select("sample", "y_offset")
        y = F.col("y_offset") + F.col("pack_lane")
        return packed.join(F.broadcast(stacked), "sample").withColumns({"ymin": y - F.lit(0.505), "ymax": y + F.lit(0.505)}).orderBy("condition_ordinal", "sample", "xmin", "xmax", "read_name").select("condition", "sample", "read_name", "xmin", "xmax", "ymin", "ymax")

    def annotations(self) -> DataFrame:
        """Introns and exons as rectangles, branchpoints as points, and labels; what a kind lacks is null."""
        low, high = F.lit(self.region["start"]).cast("long"), F.lit(self.region["end"]).cast("long")
        who = ["gene_name", "transcript_id", "strand"]
        y = F.col("annotation_y")

        def boxes(df: DataFrame, kind: str, half: float) -> DataFrame:
            return intervals.clip_to(df, "xmin", "xmax", low, high).select(F.lit(kind).alias("feature_type"), *who, "xmin", "xmax", (y - half).alias("ymin"), (y + half).alias("ymax"))

        genes = self.genes
        introns = boxes(genes.withColumnsRenamed({"transcript_start": "xmin", "transcript_end": "xmax"}), "intron", 0.04)
        exons = boxes(genes.select(*who, "annotation_y", F.explode("exon_spans").alias("x")).select(*who, "annotation_y", F.col("x.start").alias("xmin"), F.col("x.end").alias("xmax")), "exon", 0.18)
        points = self.branchpoints.select(F.lit("branchpoint").alias("feature_type"), *who, F.col("branchpoint_position").cast("double").alias("x"), y.cast("double").alias("y"))
        middle = (F.greatest("transcript_start", low) + F.least("transcript_end", high)) / 2
        labels = genes.select(F.lit("gene_label").alias("feature_type"), *who, middle.alias("x"), (y + 0.35).alias("y"), F.concat("gene_name", F.lit(" ("), "strand", F.lit(")")).alias("label"))
        none = genes.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("gene_label").alias("feature_type"), ((low + high) / 2).alias("x"), F.lit(1.0).alias("y"), F.lit("no shared genes in region").alias("label"))
        out = introns
        for part in (exons, points, labels, none):
            out = out.unionByName(part, allowMissingColumns=True)
        return out.select("feature_type", *who, "x", "xmin", "xmax", "y", "ymin", "ymax", "label").orderBy("feature_type", "gene_name", "transcript_id", "x", "xmin", "xmax")

    def statistics(self, requested_gene: str = "") -> DataFrame:
        r, reads = self.region, self.reads()
        one = lambda df, value, name: df.agg(value.alias(name))
        drawn = reads.agg(F.count_distinct("sample", "read_name").alias("drawn_distinct_reads"), F.count_distinct("sample", "ymin").alias("packed_read_rows"))
        parts = [one(self.genes, F.count(F.lit(1)), "annotated_shared_genes"), one(self.branchpoints, F.count(F.lit(1)), "branchpoint_annotations"), one(self.alignments, F.count(F.lit(1)), "candidate_read_alignments"), drawn]
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(p)
        label = f"{r['chrom']}:{r['start']}-{r['end']}"
        return out.select(F.lit(label).alias("region"), F.lit(requested_gene).alias("requested_gene"), "*", F.lit(self.config.max_reads_per_condition).alias("max_reads_per_condition"), F.lit(self.config.random_seed).alias("random_seed"))

"""Fragments that start in an intron and reach into the exon after it, seen from the branchpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.config import EngineConfig
from spanforge.functions import coerce, orient
from spanforge.operators import fragments, intervals, profiles, stats

KEYS = ["chrom", "strand"]


class Downstream:
    def __init__(self, alignments: DataFrame, reference: DataFrame, samples: DataFrame, config: EngineConfig = EngineConfig()):
        self.samples, self.config = samples, config
        self.n_reference = reference.agg(F.count(F.lit(1)).alias("reference_introns"))
        self.fragments = fragments.oriented(fragments.pairs(alignments)).persist()
        free = self.fragments.where(F.col("reason").isNull()).select("sample", "qname", *KEYS, "five_prime", "three_prime")
        introns = reference.select(*KEYS, "intron_id", "intron_start", "intron_end", "three_prime_ss", "branchpoint_position")
        at = lambda x, anchor: orient.offset(F.col(x), F.col(anchor), F.col("strand"))
        deep = (at("five_prime", "three_prime_ss") <= 0) & (at("three_prime", "three_prime_ss") >= config.downstream_exon_min_offset)
        hits = intervals.point_join(free, introns, KEYS, "five_prime", "intron_start", "intron_end", config.bin_size, deep)
        facts = F.first(F.struct("intron_id", at("five_prime", "branchpoint_position").cast("int").alias("first"), at("three_prime", "branchpoint_position").cast("int").alias("last"), at("three_prime", "three_prime_ss").alias("reach"))).alias("hit")
        audited = intervals.hit_audit(free, hits, ["sample", "qname"], [facts])
        outcome = F.when(F.col("outcome") != "unique", F.col("outcome")).when(F.col("hit.last") < F.col("hit.first"), "inverted").otherwise("spanning")
        self.assigned = audited.withColumn("outcome", outcome).select("sample", "outcome", F.when(F.col("outcome") == "spanning", F.col("hit")).alias("hit")).select("sample", "outcome", "hit.*")

    def close(self) -> None:
        self.fragments.unpersist()

    def summary_by_sample(self) -> DataFrame:
        c, first = self.config, F.col("first")
        low, high = -c.profile_upstream, c.profile_downstream
        covered = F.least(F.col("last"), F.lit(high)) - F.greatest(first, F.lit(low)) + 1
        counted = self.assigned.groupBy("sample").agg(
            F.count_if(F.col("outcome") == "spanning").alias("downstream_exon_spanning_fragments"),
            F.count_distinct("intron_id").alias("downstream_exon_spanning_introns"),
            F.sum("reach").alias("reach_sum"),
            F.count_if(first.between(low, high)).alias("profile_window_start_fragments"),
            F.sum(F.when(first.isNotNull(), F.greatest(covered, F.lit(0)))).alias("profiled_coverage_positions"),
            F.count_if(first == 0).alias("exact_branchpoint_start_fragments"),
            F.count_if(first == 1).alias("plus_one_branchpoint_start_fragments"),
            F.count_if(first.isin(0, 1)).alias("zero_or_plus_one_branchpoint_start_fragments"),
            F.count_if(F.col("outcome") == "none").alias("fragments_without_downstream_exon_assignment"),
            F.count_if(F.col("outcome") == "ambiguous").alias("ambiguous_downstream_exon_fragments"),
            F.count_if(F.col("outcome") == "inverted").alias("filtered_inverted_fragment_offsets"),
        )
        by_condition = self.assigned.join(F.broadcast(self.samples), "sample").groupBy("condition").agg(F.count_distinct("intron_id").alias("condition_union_downstream_exon_spanning_introns"))
        audit = fragments.audit(self.fragments, fragments.CONTINUOUS_REASONS)
        rows = self.samples.join(audit, "sample", "left").join(counted, "sample", "left").join(F.broadcast(by_condition), "condition", "left").na.fill(0).crossJoin(F.broadcast(self.n_reference))
        n = F.col("downstream_exon_spanning_fragments")
        added = {"downstream_exon_min_offset_nt": F.lit(c.downstream_exon_min_offset), "profile_upstream_nt": F.lit(c.profile_upstream), "profile_downstream_nt": F.lit(c.profile_downstream)}
        added |= {"downstream_exon_spanning_fragments_cpm": coerce.cpm(n, F.col("library_fragments")), "mean_downstream_exon_end_offset_nt": coerce.ratio(F.col("reach_sum"), n)}
        for k in ("profile_window", "exact_branchpoint", "plus_one_branchpoint", "zero_or_plus_one_branchpoint"):
            added |= {f"{k}_start_fraction": coerce.ratio(F.col(f"{k}_start_fragments"), n), f"{k}_start_percent": coerce.percent_of(F.col(f"{k}_start_fragments"), n)}
        return rows.withColumns(added).drop("reach_sum").orderBy("condition_ordinal", "sample")

    def metaprofile_by_sample(self) -> DataFrame:
        c = self.config
        low, high = -c.profile_upstream, c.profile_downstream
        spanning = self.assigned.where("outcome = 'spanning'")
        starts = spanning.groupBy("sample", F.col("first").alias("offset_nt")).agg(F.count(F.lit(1)).alias("read_start_count"))
        coverage = profiles.range_coverage(spanning, ["sample"], F.col("first"), F.col("last"), low, high)
        totals = self.summary_by_sample().select("sample", "condition", "condition_ordinal", "library_fragments", F.col("downstream_exon_spanning_fragments").alias("n"))
        full = profiles.dense(starts, totals, ["sample"], ["read_start_count"], low, high).join(coverage, ["sample", "offset_nt"], "left").withColumn("coverage_count", F.coalesce("coverage_count", F.lit(0)))
        rated = profiles.with_rates(full, "read_start_count", F.col("library_fragments"), F.col("n"), "read_start_", "read_start_fraction", "read_start_percent", True)
        rated = profiles.with_rates(rated, "coverage_count", F.col("library_fragments"), F.col("n"), "coverage_", "coverage_fraction", "coverage_percent", True)
        return rated.drop("library_fragments", "n").orderBy("condition_ordinal", "sample", "offset_nt")

    def metaprofile_by_condition(self) -> DataFrame:
        """The t-table of this analysis ends at ten degrees of freedom."""
        rows = self.metaprofile_by_sample()
        values = [c for c in rows.columns if c not in ("sample", "condition", "condition_ordinal", "offset_nt")]
        return stats.replicate_summary(rows, ["condition_ordinal", "condition", "offset_nt"], values, table_until=10).orderBy("condition_ordinal", "offset_nt").drop("condition_ordinal")

    def summary_by_condition(self) -> DataFrame:
        rows = self.summary_by_sample()
        values = [c for c in rows.columns if c not in ("sample", "condition", "condition_ordinal")]
        return stats.replicate_summary(rows, ["condition_ordinal", "condition"], values, ("mean", "sd")).orderBy("condition_ordinal").drop("condition_ordinal")

"""Long reads about splice sites and branchpoints: coverage, deletions and the area of their peak.

Reads are dealt once for each of two passes, by the bin that they begin in, and meet what lies near in that bin as arrays, so that no read needs a name and hits aren't gathered again by reads. The first pass finds the introns covered in any sample; the second leaves tallies, of which there are few, and equal reads add to one.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.config import EngineConfig
from spanforge.functions import cigar, coerce, orient
from spanforge.operators import fragments, intervals, profiles

KEYS = ["chrom", "strand"]
#: Bins of the shortest reads; reads as long as a bin or longer have bins 4, 16 and so on times as wide.
NEAR = 256
COVER, HELD, DELETED, RUN = range(4)


def reads(alignments: DataFrame, mapq_above: int) -> DataFrame:
    """Mapped primary reads above a mapping quality; their end is one past the last base that M and D cover, and counts as if it were the last. CIGARs are kept of reads with deletions."""
    a = alignments.where(~fragments.flag(fragments.NOT_PRIMARY) & ~fragments.flag(fragments.UNMAPPED) & (F.col("mapq") > mapq_above) & F.col("cigar").isNotNull())
    strand = F.when(fragments.flag(fragments.REVERSE), "-").otherwise("+")
    deleted = F.when(F.col("cigar").contains("D"), F.col("cigar")).alias("cigar")
    return a.select("sample", F.col("rname").alias("chrom"), strand.alias("strand"), F.col("pos").alias("rs"), cigar.span_md(F.col("pos"), F.col("cigar")).alias("re"), deleted)


def top_branchpoints(introns: DataFrame, branchpoints: DataFrame) -> DataFrame:
    """(top, chrom, strand, position) for each intron with a branchpoint: the one with the highest score, the first in the file of equals."""
    points = branchpoints.select(*KEYS, "position", "score", "ordinal")
    hits = intervals.point_join(points, introns.select(*KEYS, "intron_id", "start", "end"), KEYS, "position", "start", "end")
    return hits.groupBy("intron_id", *KEYS).agg(F.min_by("position", F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))), F.col("ordinal"))).alias("position")).withColumnRenamed("intron_id", "top")


def single_introns(introns: DataFrame, top: DataFrame) -> DataFrame:
    """Introns that hold exactly one top branchpoint, of either strand."""
    hits = intervals.point_join(top.select("chrom", "top", "position"), introns.select("chrom", "intron_id", "start", "end"), ["chrom"], "position", "start", "end")
    return hits.groupBy("intron_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("intron_id")


class LongReads:
    def __init__(self, alignments: DataFrame, introns: DataFrame, branchpoints: DataFrame, config: EngineConfig = EngineConfig()):
        self.config, self.introns, self.branchpoints = config, introns, branchpoints
        self.reads = reads(alignments, config.mapq_above).persist()
        self.top = top_branchpoints(introns, branchpoints)
        self.single = single_introns(introns, self.top)
        stretch = config.intron_stretch
        self.candidates = introns.join(self.single, "intron_id", "left_semi").select(*KEYS, "intron_id", (F.col("start") - F.lit(stretch // 2)).alias("low"), (F.col("end") + F.lit(stretch - stretch // 2)).alias("high")).where("low <= high")

    def close(self) -> None:
        self.reads.unpersist()
        for name in {"covered", "tallies"} & set(vars(self)):
            getattr(self, name).unpersist()

    @cached_property
    def _placed(self) -> tuple[DataFrame, list[int]]:
        """Reads with the size of their bins, which is above their reach, and the bin that they begin in; and the sizes that there are. No intron touches more than MOST_BINS of the smallest."""
        widest = self.candidates.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0
        least = max(NEAR, widest // intervals.MOST_BINS + 1)
        reach = F.col("re") - F.col("rs")
        size = F.coalesce(*[F.when(reach < least * 4**i, F.lit(least * 4**i).cast("long")) for i in range(24)])
        placed = self.reads.withColumn("size", size).withColumn("bin", intervals.bin_of(F.col("rs"), F.col("size")))
        return placed, sorted(r["size"] for r in placed.select("size").distinct().collect() if r["size"])

    def _near(self, introns: DataFrame, margin: int) -> DataFrame:
        """Reads with what lies near, where anything does: positions of branchpoints up to the margin away and of top ones, and introns."""
        placed, sizes = self._placed
        none = F.lit(None)
        point = F.col("position").cast("long")
        found = [
            self.branchpoints.select(*KEYS, (point - margin).alias("low"), (point + margin).alias("high"), point.alias("point"), none.cast("long").alias("top"), none.cast("struct<low:bigint,high:bigint,intron_id:string>").alias("intron")),
            self.top.select(*KEYS, point.alias("low"), point.alias("high"), none.cast("long").alias("point"), point.alias("top"), none.cast("struct<low:bigint,high:bigint,intron_id:string>").alias("intron")),
            introns.select(*KEYS, F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), none.cast("long").alias("point"), none.cast("long").alias("top"), F.struct(F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.col("intron_id").cast("string").alias("intron_id")).alias("intron")),
        ]
        # A read that reaches one of them begins at most its bin's size before.
        bins = F.sequence(intervals.bin_of(F.col("low") - F.col("size") + 1, F.col("size")), intervals.bin_of(F.col("high"), F.col("size")))
        spread = reduce(DataFrame.unionByName, found).withColumn("size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes or [NEAR]]))).withColumn("bin", F.explode(bins))
        lists = spread.groupBy(*KEYS, "size", "bin").agg(F.collect_list("point").alias("points"), F.collect_list("top").alias("tops"), F.collect_list("intron").alias("introns"))
        return placed.join(lists, [*KEYS, "size", "bin"])

    @cached_property
    def covered(self) -> DataFrame:
        """(sample, intron_id) of introns that hold a read over a branchpoint."""
        near = self._near(self.candidates, 0).where(F.exists("points", _over))
        return near.select("sample", F.explode(F.transform(F.filter("introns", _holds), lambda i: i["intron_id"])).alias("intron_id")).distinct().persist()

    @cached_property
    def shared(self) -> DataFrame:
        return self.candidates.join(self.covered.select("intron_id").distinct(), "intron_id", "left_semi")

    @cached_property
    def tallies(self) -> DataFrame:
        """(sample, kind, a, b, run, n), summed over reads, which hold `introns` shared introns and lie over `branchpoints`.

        COVER: offsets a to b about top branchpoints, by introns. HELD: introns. DELETED: reads with deletions, a the branchpoints. RUN: a read's deletions near one branchpoint, offset and events of each.
        """
        h = self.config.long_branchpoint_half_width
        near = self._near(self.shared, h)
        near = near.withColumns({"branchpoints": F.size(F.filter("points", _over)).cast("long"), "held": F.size(F.filter("introns", _holds)).cast("long")})
        # Deleted positions that lie in shared introns; events is the number of the read's branchpoints times that of the introns, by which each counts.
        inside = lambda d: F.size(F.filter("introns", lambda i: (i["low"] <= d) & (i["high"] >= d))).cast("long") * F.col("branchpoints")
        spots = F.transform(cigar.deletions_shifted(F.col("rs"), F.col("cigar")), lambda d: F.struct(d.alias("d"), inside(d).alias("events")))
        nothing = F.expr("CAST(array() AS array<struct<d:bigint,events:bigint>>)")
        near = near.withColumn("deleted", F.when((F.col("branchpoints") > 0) & F.col("cigar").isNotNull(), F.filter(spots, lambda x: x["events"] > 0)).otherwise(nothing))
        no_run = F.expr("CAST(array() AS array<struct<o:int,events:bigint>>)")
        entry = lambda kind, a, b, run, n: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), run.alias("run"), n.cast("long").alias("n"))

        def cover(top: Column) -> Column:
            a, b = orient.clip(F.col("rs"), F.col("re"), top - h, top + h)
            return entry(COVER, *orient.range_offsets_symmetric_minus(a, b, top, F.col("strand")), no_run, F.col("held"))

        def run(point: Column) -> Column:
            some = F.filter("deleted", lambda x: F.abs(x["d"] - point) <= h)
            return F.transform(some, lambda x: F.struct(orient.offset(x["d"], point, F.col("strand")).cast("int").alias("o"), x["events"].alias("events")))

        zero = F.lit(0)
        empty = F.expr("CAST(array() AS array<struct<kind:int,a:int,b:int,run:array<struct<o:int,events:bigint>>,n:bigint>>)")
        deleted = F.size("deleted") > 0
        runs = F.filter(F.transform("points", run), lambda x: F.size(x) > 0)
        entries = F.concat(
            F.when(F.col("held") > 0, F.transform(F.filter("tops", _over), cover)).otherwise(empty),
            F.when(F.col("held") > 0, F.array(entry(HELD, zero, zero, no_run, F.col("held")))).otherwise(empty),
            F.when(deleted, F.array(entry(DELETED, F.col("branchpoints"), zero, no_run, F.lit(1)))).otherwise(empty),
            F.when(deleted, F.transform(runs, lambda x: entry(RUN, zero, zero, x, F.lit(1)))).otherwise(empty),
        )
        each = near.select("sample", F.explode(entries).alias("x")).select("sample", "x.*")
        return each.groupBy("sample", "kind", "a", "b", "run").agg(F.sum("n").alias("n")).persist()

    def _tallied(self, kind: int) -> DataFrame:
        return self.tallies.where(F.col("kind") == kind)

    def three_prime_coverage(self) -> DataFrame:
        """(protein, strand_corrected_position, score, normalised_coverage) on [-h, h - 1] about splice sites."""
        h = self.config.long_three_prime_half_width
        sites = self.introns.select(*KEYS, orient.three_prime(F.col("start"), F.col("end"), F.col("strand")).alias("site"))
        hits = intervals.point_join(sites, self.reads.select("sample", *KEYS, "rs", "re"), KEYS, "site", "rs", "re", self.config.bin_size)
        a, b = orient.clip(F.col("rs"), F.col("re"), F.col("site") - h, F.col("site") + h)
        first, last = orient.range_offsets(a, b, F.col("site"), F.col("strand"))
        counts = profiles.range_coverage(hits, ["sample"], first, last, -h, h - 1, name="strand_corrected_position", count="score")
        return self._normalised(counts, -h, h - 1)

    def _normalised(self, counts: DataFrame, low: int, high: int) -> DataFrame:
        names = self.reads.select("sample").distinct()
        full = profiles.dense(counts, names, ["sample"], ["score"], low, high, "strand_corrected_position")
        return profiles.max_normalised(full, ["sample"], "score", "normalised_coverage").withColumnRenamed("sample", "protein").orderBy("protein", "strand_corrected_position")

    def branchpoint_coverage(self) -> DataFrame:
        """About top branchpoints, each read counted once for each shared intron that holds it; symmetric on the minus strand."""
        h = self.config.long_branchpoint_half_width
        counts = profiles.range_coverage(self._tallied(COVER), ["sample"], F.col("a"), F.col("b"), -h, h, F.col("n"), "strand_corrected_position", "score")
        return self._normalised(counts, -h, h)

    def deletion_profile(self) -> DataFrame:
        """Counts of deletions about branchpoints, raw and by runs, over reads and over coverage.

        A read's deletion counts as often as its events say, and a repeated position ends a run: with more than one event only the first and last of the repeats touch a neighbour. Repeats are weighed without being made.
        """
        # Reads with the same run are weighed once.
        runs = self._tallied(RUN).select("sample", F.struct("run", "n").alias("read"), F.lit(0).alias("ordinal"), F.explode("run").alias("x"))
        weighed = _run_weights(runs.select("sample", "read", "ordinal", F.col("x.o").alias("strand_corrected_position"), F.col("x.events").alias("events")))
        counts = weighed.groupBy("sample", "strand_corrected_position").agg(F.sum(F.col("events") * F.col("read.n")).alias("count"), F.sum(F.col("weight") * F.col("read.n")).alias("count_cons"))
        denominator = self._tallied(DELETED).groupBy("sample").agg(F.sum(F.col("a") * F.col("n")).alias("denominator"))
        coverage = self.branchpoint_coverage().withColumnRenamed("protein", "sample")
        out = counts.join(F.broadcast(denominator), "sample").join(coverage, ["sample", "strand_corrected_position"])
        share = lambda x: coerce.ratio_or_null(F.col(x), F.col("denominator"))
        out = out.withColumns({"normalised_count": share("count"), "normalised_count_cons": share("count_cons")})
        over = lambda x: coerce.ratio_or_null(F.col(x), F.col("normalised_coverage"))
        out = out.withColumns({"coverage_normalised": over("normalised_count"), "coverage_normalised_cons": over("normalised_count_cons")})
        return out.orderBy("sample", "strand_corrected_position").select(F.col("sample").alias("protein"), "strand_corrected_position", "count_cons", "count", "normalised_count", "normalised_count_cons", "score", "normalised_coverage", "coverage_normalised", "coverage_normalised_cons")

    def area(self) -> DataFrame:
        return profiles.area_above_baseline(self.deletion_profile(), ["protein"], "strand_corrected_position", "coverage_normalised").orderBy("protein")

    def diagnostics(self) -> DataFrame:
        """(scope, metric, value)"""
        one = lambda df, scope, metric: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(scope).alias("scope"), F.lit(metric).alias("metric"), "value")
        fixed = [one(self.introns, "reference", "introns"), one(self.branchpoints, "reference", "branchpoints"), one(self.top, "reference", "top_branchpoints"), one(self.single, "reference", "single_top_branchpoint_introns"), one(self.shared, "analysis", "union_covered_introns")]
        per = lambda df, metric, value: df.groupBy("sample").agg(value.alias("value")).select(F.col("sample").alias("scope"), F.lit(metric).alias("metric"), "value")
        events = F.aggregate("run", F.lit(0).cast("long"), lambda total, x: total + x["events"])
        mine = [
            per(self.reads, "filtered_primary_alignments", F.count(F.lit(1))),
            per(self.covered, "covered_candidate_introns", F.count(F.lit(1))),
            per(self._tallied(HELD), "high_coverage_read_hits", F.sum("n")),
            per(self._tallied(DELETED), "deletion_reads", F.sum("n")),
            per(self._tallied(DELETED), "deletion_normalisation_read_overlaps", F.sum(F.col("a") * F.col("n"))),
            per(self._tallied(RUN), "metaprofile_deletion_rows", F.sum(events * F.col("n"))),
        ]
        return reduce(DataFrame.unionByName, [*fixed, *mine])


def _over(position: Column) -> Column:
    """A read reaches the position."""
    return (position >= F.col("rs")) & (position <= F.col("re"))


def _holds(intron: Column) -> Column:
    """The intron holds the read whole."""
    return (intron["low"] <= F.col("rs")) & (intron["high"] >= F.col("re"))


def _run_weights(rows: DataFrame) -> DataFrame:
    """rows with weight: the sum over a position's events of 1 / the length of the run that each is in.

    Sorted with its repeats, a position with one event belongs to the run of its neighbours. One with k > 1 events is cut at each repeat: its first event belongs to the run before it, its last to the run after it, and the k - 2 between are runs of their own. So runs are those of positions, cut at each position with repeats, which stands in both.
    """
    keys = ["sample", "read", "ordinal"]
    order = Window.partitionBy(*keys).orderBy("strand_corrected_position", "half")
    many = F.col("events") > 1
    halves = F.when(many, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    split = rows.withColumn("half", F.explode(halves))
    follows = (F.col("strand_corrected_position") - F.lag("strand_corrected_position").over(order) == 1) & (F.col("half") == 0)
    runs = split.withColumn("fresh", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "run"))
    per = runs.withColumn("w", F.lit(1.0) / size)
    return per.groupBy(*keys, "strand_corrected_position").agg(F.max("events").alias("events"), (F.sum("w") + F.greatest(F.max("events") - 2, F.lit(0))).alias("weight"))

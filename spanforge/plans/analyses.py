"""Whole analyses as queries: each lane over the alignments, introns and genes of `supplied`, with SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.config import EngineConfig
from spanforge.functions import cigar, text
from spanforge.operators import fragments, layout, sets, stats
from spanforge.plans import branchpoint, browser, content_levels, downstream, exports, longread, percentile, premrna, references, rna_content, supplied, unmapped
from spanforge.plans.catalog import ORACLE_SQL, QUERIES, query
from spanforge.plans.supplied import along, with_
from spanforge.sources import binary, tables

__all__ = ["ORACLE_SQL", "QUERIES"]

SAMPLES = [s for s, _, _ in supplied.SAMPLES]
#: Of the analyses over introns that every sample has; the other settings are as they are by default.
CONFIG = EngineConfig(analysis_min_reads=1, shared_min_reads=1)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema if f.dataType.typeName() == "double"})


def _round(sql: str, *names: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in names)}) FROM ({sql})"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


def _rates(count: str, library: str, total: str, prefix: str, of: str) -> str:
    return f"{_ratio(f'{count} * 1e6', library)} AS {prefix}_cpm, {_ratio(count, total)} AS {prefix}_fraction_{of}, {_ratio(count, total)} * 100.0 AS {prefix}_percent_{of}"


def _replicates(table: str, keys: str, values: list[str], spread: tuple[str, ...] = ("mean", "sd", "sem", "ci95"), until: int = 30) -> str:
    """Replicate statistics in SQL, rounded."""
    t = f"CASE WHEN count(v) < 2 THEN 0.0 {' '.join(f'WHEN count(v) = {i + 2} THEN {x}' for i, x in enumerate(stats.T_95[:until]))} ELSE 1.96 END"
    of = {"mean": "avg(v)", "sd": "CASE WHEN count(v) > 0 THEN coalesce(stddev_samp(v), 0.0) END", "sem": "CASE WHEN count(v) > 0 THEN coalesce(stddev_samp(v), 0.0) / sqrt(count(v)) END", "ci95": f"CASE WHEN count(v) > 0 THEN coalesce(stddev_samp(v), 0.0) / sqrt(count(v)) * {t} END"}
    columns = [f"round({of[s].replace('(v)', f'(CAST({v} AS DOUBLE))')}, 6) AS {s}_{v}" for v in values for s in spread]
    return f"SELECT {keys}, count(*) AS replicate_count, {', '.join(columns)} FROM {table} GROUP BY {keys}"


# Read pairs


def _fragments(spark, sf_dir) -> DataFrame:
    return fragments.oriented(fragments.pairs(supplied.alignments(spark, sf_dir)))


@query(f"{with_('aln', 'walk', 'frag')} SELECT sample, qname, chrom, strand, five_prime, three_prime, reason, in_library FROM frag")
def q_fragment_ends(spark, sf_dir):
    return _fragments(spark, sf_dir).select("sample", "qname", "chrom", "strand", "five_prime", "three_prime", "reason", "in_library")


@query(f"{with_('aln', 'walk', 'frag')} SELECT sample, read1_records_examined, library_fragments, filtered_secondary_or_supplementary, {', '.join(f'filtered_{r}' for r in fragments.CONTINUOUS_REASONS)} FROM audit")
def q_fragment_audit(spark, sf_dir):
    return fragments.audit(_fragments(spark, sf_dir), fragments.CONTINUOUS_REASONS)


_LANE = """lane0 AS (SELECT sample, qname, count(*) FILTER (good) AS n, CASE WHEN count(*) FILTER (good AND flag & 64 <> 0) = 1 THEN max(rid) FILTER (good AND flag & 64 <> 0) END AS rid1
  FROM (SELECT *, flag & 2304 = 0 AND flag & 4 = 0 AS good FROM aln) GROUP BY sample, qname),
lane AS (SELECT l.sample, l.qname, CASE WHEN a.flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, CASE WHEN n = 0 THEN 'without_primary_mapped_alignment' WHEN rid1 IS NULL THEN 'missing_or_multiple_read1' WHEN a.flag & 8 <> 0 THEN 'unmapped_or_mate_unmapped'
  WHEN a.flag & 2 = 0 OR a.rname IS DISTINCT FROM a.rnext THEN 'improper_pair' WHEN NOT CASE WHEN a.nh IS NULL THEN a.mapq > 0 ELSE a.nh = 1 END THEN 'nonunique' END AS reason FROM lane0 l LEFT JOIN aln a ON a.rid = rid1),
lane_span AS (SELECT sample, qname, rname AS chrom, bs, be FROM aln JOIN spans USING (rid) WHERE flag & 2304 = 0 AND flag & 4 = 0)"""


@query(
    f"""{with_('aln', 'walk')}, {_LANE}, per AS (SELECT sample, qname, count(*) AS n, CAST(sum(be - bs + 1) AS BIGINT) AS bases FROM lane_span GROUP BY 1, 2)
SELECT sample, qname, strand, reason, reason IS NULL AS in_library, coalesce(n, 0) AS n_blocks, coalesce(bases, 0) AS bases FROM lane LEFT JOIN per USING (sample, qname)"""
)
def q_gene_pairs(spark, sf_dir):
    lane = fragments.gene_lane(supplied.alignments(spark, sf_dir))
    return lane.select("sample", "qname", "strand", "reason", "in_library", F.size("blocks").cast("long").alias("n_blocks"), F.aggregate("blocks", F.lit(0).cast("long"), lambda t, b: t + b["end"] - b["start"] + 1).alias("bases"))


# Branchpoints


def _quantified(spark, sf_dir) -> branchpoint.Quantified:
    return branchpoint.Quantified(supplied.alignments(spark, sf_dir), supplied.introns(spark, sf_dir), supplied.samples(spark), CONFIG)


_BP = f"""{with_('aln', 'walk', 'frag', 'intron', 'samples')},
anchor_hit AS (SELECT f.sample, f.qname, f.five_prime, f.strand, i.intron_id, i.intron_start, i.intron_end, i.branchpoint_position FROM cont f JOIN intron i ON f.chrom = i.chrom AND f.strand = i.strand AND CASE WHEN f.strand = '+' THEN three_prime - three_prime_ss ELSE three_prime_ss - three_prime END BETWEEN -10 AND 1),
anchor_per AS (SELECT sample, qname, count(*) AS h, any_value(intron_id) AS intron_id, any_value(five_prime BETWEEN intron_start AND intron_end) AS inside, any_value({along('five_prime', 'branchpoint_position')}) AS o FROM anchor_hit GROUP BY 1, 2),
anchored AS (SELECT sample, qname, CASE WHEN h IS NULL THEN 'none' WHEN h > 1 THEN 'ambiguous' WHEN inside THEN 'anchored' ELSE 'outside' END AS outcome, CASE WHEN h = 1 AND inside THEN intron_id END AS intron_id, CASE WHEN h = 1 AND inside THEN CAST(o AS INTEGER) END AS offset_nt FROM cont LEFT JOIN anchor_per USING (sample, qname)),
span_hit AS (SELECT f.sample, f.qname, i.intron_id, CASE WHEN f.strand = '+' THEN five_prime - three_prime_ss ELSE three_prime_ss - five_prime END AS a, CASE WHEN f.strand = '+' THEN three_prime - three_prime_ss ELSE three_prime_ss - three_prime END AS b FROM cont f JOIN intron i ON f.chrom = i.chrom AND f.strand = i.strand AND five_prime BETWEEN intron_start AND intron_end),
span_per AS (SELECT sample, qname, count(*) AS h, any_value(intron_id) AS intron_id, any_value(a) AS a, any_value(b) AS b FROM span_hit WHERE a <= 0 AND b >= 0 GROUP BY 1, 2),
spanning AS (SELECT sample, qname, CASE WHEN h IS NULL THEN 'none' WHEN h > 1 THEN 'ambiguous' ELSE 'unique' END AS outcome, intron_id, a, b FROM cont LEFT JOIN span_per USING (sample, qname)),
offsets AS (SELECT sample, condition, intron_id, offset_nt, count(*) AS read_count FROM anchored JOIN samples USING (sample) WHERE outcome = 'anchored' GROUP BY ALL),
library AS (SELECT s.sample, condition, condition_ordinal, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('read1_records_examined', 'library_fragments', 'filtered_secondary_or_supplementary', *(f'filtered_{r}' for r in fragments.CONTINUOUS_REASONS)))} FROM samples s LEFT JOIN audit USING (sample)),
site_n AS (SELECT sample, intron_id, count(*) AS anchored_fragments, count(*) FILTER (offset_nt = 0) AS exact_branchpoint_fragments, count(*) FILTER (offset_nt = 1) AS plus_one_branchpoint_fragments, count(*) FILTER (offset_nt IN (0, 1)) AS zero_or_plus_one_branchpoint_fragments FROM anchored WHERE outcome = 'anchored' GROUP BY 1, 2),
site AS (SELECT sample, condition, library_fragments, intron.*, site_n.* EXCLUDE (sample, intron_id) FROM site_n JOIN intron USING (intron_id) JOIN library USING (sample)),
unique_span AS (SELECT sample, intron_id, a, b FROM spanning WHERE outcome = 'unique'),
three AS (SELECT sample, intron_id, CAST(x AS INTEGER) AS offset_nt, count(*) AS coverage_count FROM (SELECT sample, intron_id, unnest(range(greatest(a, -100), least(b, 100) + 1)) AS x FROM unique_span) GROUP BY 1, 2, 3),
three_n AS (SELECT sample, intron_id, count(*) AS three_prime_spanning_fragments FROM unique_span GROUP BY 1, 2),
three_cov AS (SELECT sample, condition, intron_id, three_prime_spanning_fragments, offset_nt, coverage_count FROM three JOIN three_n USING (sample, intron_id) JOIN samples USING (sample))"""
_KINDS = ("exact", "plus_one", "zero_or_plus_one")
_SITE = f"""SELECT sample, condition, intron_id, {', '.join(branchpoint.METADATA)}, anchored_fragments, {', '.join(f"{k}_branchpoint_fragments, {_rates(f'{k}_branchpoint_fragments', 'library_fragments', 'anchored_fragments', f'{k}_branchpoint', 'anchored')}" for k in _KINDS)} FROM site"""
_SITE_RATES = [f"{k}_branchpoint_{x}" for k in _KINDS for x in ("cpm", "fraction_anchored", "percent_anchored")]


@query(_round(f"{_BP} SELECT *, row_number() OVER (ORDER BY sample, exact_branchpoint_fragments DESC, anchored_fragments DESC, gene_name, intron_id) AS row_rank FROM ({_SITE})", *_SITE_RATES))
def q_bp_sites(spark, sf_dir):
    rows = _quantified(spark, sf_dir).site_counts()
    return _rounded(layout.ranked(rows, branchpoint.site_order()))


@query(f"{_BP} SELECT * FROM offsets")
def q_bp_offsets(spark, sf_dir):
    return _quantified(spark, sf_dir).offset_counts()


@query(f"{_BP} SELECT * FROM three_cov")
def q_bp_three_prime(spark, sf_dir):
    return _quantified(spark, sf_dir).three_prime_coverage()


_BP_SUMMARY = f"""{_BP},
anchors AS (SELECT sample, count(*) FILTER (outcome = 'anchored') AS anchored_fragments, count(DISTINCT intron_id) AS anchored_introns_with_reads, {', '.join(f"count(*) FILTER (offset_nt IN {o}) AS {k}_branchpoint_fragments" for k, o in zip(_KINDS, ('(0)', '(1)', '(0, 1)')))},
  count(*) FILTER (offset_nt BETWEEN -50 AND 50) AS profile_window_fragments, count(*) FILTER (outcome = 'none') AS fragments_without_branchpoint_anchor, count(*) FILTER (outcome = 'ambiguous') AS ambiguous_anchor_fragments, count(*) FILTER (outcome = 'outside') AS filtered_five_prime_outside_intron FROM anchored GROUP BY 1),
spans_n AS (SELECT sample, count(*) FILTER (outcome = 'unique') AS three_prime_spanning_fragments, count(DISTINCT intron_id) FILTER (outcome = 'unique' AND a <= 100 AND b >= -100) AS three_prime_introns_with_coverage,
  count(*) FILTER (outcome = 'none') AS fragments_without_three_prime_coverage_assignment, count(*) FILTER (outcome = 'ambiguous') AS ambiguous_three_prime_coverage_fragments FROM spanning GROUP BY 1),
counted AS (SELECT library.*, coalesce(COLUMNS(anchors.* EXCLUDE (sample)), 0), coalesce(COLUMNS(spans_n.* EXCLUDE (sample)), 0), (SELECT count(*) FROM intron) AS reference_introns FROM library LEFT JOIN anchors USING (sample) LEFT JOIN spans_n USING (sample)),
summary AS (SELECT *, {', '.join(_rates(f'{k}_branchpoint_fragments', 'library_fragments', 'anchored_fragments', f'{k}_branchpoint', 'anchored') for k in _KINDS)},
  10 AS anchor_window_nt, 10 AS anchor_upstream_nt, 1 AS anchor_downstream_nt, 50 AS profile_upstream_nt, 50 AS profile_downstream_nt, 100 AS three_prime_coverage_upstream_nt, 100 AS three_prime_coverage_downstream_nt,
  {_ratio('anchored_fragments * 1e6', 'library_fragments')} AS anchored_fragments_cpm, {_ratio('three_prime_spanning_fragments * 1e6', 'library_fragments')} AS three_prime_spanning_fragments_cpm,
  {_ratio('profile_window_fragments', 'anchored_fragments')} AS profile_window_fraction_anchored, {_ratio('profile_window_fragments', 'anchored_fragments')} * 100.0 AS profile_window_percent_anchored FROM counted)"""
_SUMMARY_RATES = [*_SITE_RATES, "anchored_fragments_cpm", "three_prime_spanning_fragments_cpm", "profile_window_fraction_anchored", "profile_window_percent_anchored"]


@query(_round(f"{_BP_SUMMARY} SELECT * FROM summary", *_SUMMARY_RATES))
def q_bp_summary(spark, sf_dir):
    return _rounded(_quantified(spark, sf_dir).summary())


_DENSE = "SELECT *, unnest(range(-50, 51)) AS o FROM summary"


@query(_round(f"""{_BP_SUMMARY}, starts AS (SELECT sample, offset_nt AS o, count(*) AS n FROM anchored WHERE outcome = 'anchored' GROUP BY 1, 2)
SELECT sample, condition, CAST(o AS INTEGER) AS offset_nt, coalesce(n, 0) AS read_count, {_ratio('coalesce(n, 0) * 1e6', 'library_fragments')} AS cpm, {_ratio('coalesce(n, 0)', 'anchored_fragments')} AS anchored_fraction, {_ratio('coalesce(n, 0)', 'anchored_fragments')} * 100.0 AS anchored_percent
FROM ({_DENSE}) LEFT JOIN starts USING (sample, o)""", "cpm", "anchored_fraction", "anchored_percent"))
def q_bp_metaprofile(spark, sf_dir):
    return _rounded(_quantified(spark, sf_dir).metaprofile())


def _aggregated(spark, sf_dir) -> branchpoint.Aggregated:
    q = _quantified(spark, sf_dir)
    return branchpoint.Aggregated(q.site_counts(), q.offset_counts(), q.three_prime_coverage(), q.summary(), CONFIG, SAMPLES)


_CHOSEN = f"""{_BP_SUMMARY}, chosen AS (SELECT intron_id FROM site WHERE anchored_fragments >= 1 GROUP BY 1 HAVING count(DISTINCT sample) = {len(SAMPLES)})"""
_META = ", ".join(c for c in branchpoint.METADATA if c not in ("intron_length", "branchpoint_type"))


@query(
    f"""{_CHOSEN}, wide AS (SELECT intron_id, {_META}, {', '.join(f"CAST(coalesce(sum(anchored_fragments) FILTER (sample = '{s}'), 0) AS BIGINT) AS {s}_anchored_fragments" for s in SAMPLES)} FROM site WHERE intron_id IN (FROM chosen) GROUP BY ALL)
SELECT *, least({', '.join(f'{s}_anchored_fragments' for s in SAMPLES)}) AS min_anchored_fragments_across_samples, row_number() OVER (ORDER BY gene_name, intron_id) AS row_rank FROM wide"""
)
def q_bp_analysis_introns(spark, sf_dir):
    return layout.ranked(_aggregated(spark, sf_dir).analysis_introns(), ["gene_name", "intron_id"])


_PROFILE = f"""{_CHOSEN}, totals AS (SELECT l.sample, l.condition, l.condition_ordinal, l.library_fragments, coalesce(n, 0) AS anchored_fragments FROM library l LEFT JOIN (SELECT sample, CAST(sum(anchored_fragments) AS BIGINT) AS n FROM site WHERE intron_id IN (FROM chosen) GROUP BY 1) USING (sample)),
mine AS (SELECT o.*, branchpoint_to_3ss_nt AS m FROM offsets o JOIN intron USING (intron_id) WHERE intron_id IN (FROM chosen)),
starts AS (SELECT sample, offset_nt AS o, CAST(sum(read_count) AS BIGINT) AS n FROM mine GROUP BY 1, 2),
cover AS (SELECT sample, o, CAST(sum(read_count) AS BIGINT) AS v FROM (SELECT sample, read_count, unnest(range(greatest(offset_nt, -50), least(m, 50) + 1)) AS o FROM mine) GROUP BY 1, 2),
profile AS (SELECT sample, condition, condition_ordinal, CAST(o AS INTEGER) AS offset_nt, coalesce(n, 0) AS read_count, {_ratio('coalesce(n, 0) * 1e6', 'library_fragments')} AS cpm, {_ratio('coalesce(n, 0)', 'anchored_fragments')} AS anchored_fraction, {_ratio('coalesce(n, 0)', 'anchored_fragments')} * 100.0 AS anchored_percent,
  coalesce(v, 0) AS coverage_count, {_ratio('coalesce(v, 0) * 1e6', 'library_fragments')} AS coverage_cpm, {_ratio('coalesce(v, 0)', 'anchored_fragments')} AS coverage_anchored_fraction, {_ratio('coalesce(v, 0)', 'anchored_fragments')} * 100.0 AS coverage_anchored_percent
  FROM (SELECT *, unnest(range(-50, 51)) AS o FROM totals) LEFT JOIN starts USING (sample, o) LEFT JOIN cover USING (sample, o))"""
_PROFILE_VALUES = ["read_count", "cpm", "anchored_fraction", "anchored_percent", "coverage_count", "coverage_cpm", "coverage_anchored_fraction", "coverage_anchored_percent"]


@query(_round(f"{_PROFILE} SELECT *, row_number() OVER (ORDER BY condition_ordinal, sample, offset_nt) AS row_rank FROM profile", *[v for v in _PROFILE_VALUES if not v.endswith("count")]))
def q_bp_profile_by_sample(spark, sf_dir):
    return _rounded(layout.ranked(_aggregated(spark, sf_dir).metaprofile_by_sample(), ["condition_ordinal", "sample", "offset_nt"]))


@query(f"{_PROFILE}, stat AS ({_replicates('profile', 'condition, offset_nt', _PROFILE_VALUES)}) FROM stat")
def q_bp_profile_by_condition(spark, sf_dir):
    made = _aggregated(spark, sf_dir)
    return _rounded(made.by_condition(made.metaprofile_by_sample()))


_THREE = """{chosen}, mine3 AS (SELECT * FROM three_cov {where}), spanned AS (SELECT sample, CAST(sum(n) AS BIGINT) AS spanning, count(*) AS introns FROM (SELECT sample, intron_id, max(three_prime_spanning_fragments) AS n FROM mine3 GROUP BY 1, 2) GROUP BY 1)"""


@query(_round(f"""{_THREE.format(chosen=_CHOSEN, where='')}, counts AS (SELECT sample, offset_nt AS o, CAST(sum(coverage_count) AS BIGINT) AS n FROM mine3 GROUP BY 1, 2)
SELECT sample, condition, condition_ordinal, CAST(o AS INTEGER) AS offset_nt, coalesce(n, 0) AS coverage_count, {_ratio('coalesce(n, 0) * 1e6', 'library_fragments')} AS coverage_cpm, {_ratio('coalesce(n, 0)', 'spanning')} AS coverage_spanning_fraction, {_ratio('coalesce(n, 0)', 'spanning')} * 100.0 AS coverage_spanning_percent
FROM (SELECT library.*, spanning, unnest(range(-100, 101)) AS o FROM library LEFT JOIN spanned USING (sample)) LEFT JOIN counts USING (sample, o)""", "coverage_cpm", "coverage_spanning_fraction", "coverage_spanning_percent"))
def q_bp_three_prime_by_sample(spark, sf_dir):
    return _rounded(_aggregated(spark, sf_dir).three_prime_by_sample(all_introns=True))


_RAW = ("three_prime_spanning_fragments", "three_prime_introns_with_coverage", "anchored_fragments", "anchored_introns_with_reads")
_GONE = (*_SUMMARY_RATES, *(f"{k}_branchpoint_fragments" for k in _KINDS), "profile_window_fragments", *_RAW)
_BY_SAMPLE = f"""{_THREE.format(chosen=_CHOSEN, where='WHERE intron_id IN (FROM chosen)')},
chosen_n AS (SELECT sample, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('anchored_fragments', *(f'{k}_branchpoint_fragments' for k in _KINDS)))}, count(*) AS anchored_introns_with_reads FROM site WHERE intron_id IN (FROM chosen) GROUP BY 1),
window_n AS (SELECT sample, CAST(sum(read_count) AS BIGINT) AS profile_window_fragments FROM offsets WHERE intron_id IN (FROM chosen) AND offset_nt BETWEEN -50 AND 50 GROUP BY 1),
base AS (SELECT s.* EXCLUDE ({', '.join(_GONE)}), {', '.join(f's.{c} AS raw_{c}' for c in _RAW)}, {', '.join(f'coalesce(chosen_n.{c}, 0) AS {c}' for c in ('anchored_fragments', *(f'{k}_branchpoint_fragments' for k in _KINDS), 'anchored_introns_with_reads'))}, coalesce(w.profile_window_fragments, 0) AS profile_window_fragments, coalesce(spanning, 0) AS three_prime_spanning_fragments, coalesce(introns, 0) AS three_prime_introns_with_coverage,
  (SELECT count(*) FROM chosen) AS introns_included_in_analysis, (SELECT count(DISTINCT intron_id) FROM three_cov) AS all_three_prime_introns_with_coverage_across_samples, 1 AS min_anchored_reads_all_samples_for_analysis_inclusion
  FROM summary s LEFT JOIN chosen_n USING (sample) LEFT JOIN (SELECT sample, profile_window_fragments FROM window_n) w USING (sample) LEFT JOIN spanned USING (sample)),
by_sample AS (SELECT *, {', '.join(_rates(f'{k}_branchpoint_fragments', 'library_fragments', 'anchored_fragments', f'{k}_branchpoint', 'anchored') for k in _KINDS)}, {_ratio('anchored_fragments * 1e6', 'library_fragments')} AS anchored_fragments_cpm, {_ratio('three_prime_spanning_fragments * 1e6', 'library_fragments')} AS three_prime_spanning_fragments_cpm,
  {_ratio('profile_window_fragments', 'anchored_fragments')} AS profile_window_fraction_anchored, {_ratio('profile_window_fragments', 'anchored_fragments')} * 100.0 AS profile_window_percent_anchored FROM base)"""


@query(_round(f"{_BY_SAMPLE} FROM by_sample", *_SUMMARY_RATES))
def q_bp_summary_by_sample(spark, sf_dir):
    return _rounded(_aggregated(spark, sf_dir).summary_by_sample())


_SUMMARY_VALUES = ["library_fragments", "read1_records_examined", "anchored_fragments", "exact_branchpoint_percent_anchored", "introns_included_in_analysis", "raw_anchored_fragments", "three_prime_spanning_fragments_cpm"]


@query(f"{_BY_SAMPLE}, stat AS ({_replicates('by_sample', 'condition', _SUMMARY_VALUES, ('mean', 'sd'))}) FROM stat")
def q_bp_summary_by_condition(spark, sf_dir):
    rows = _aggregated(spark, sf_dir).summary_by_condition()
    return _rounded(rows.select("condition", "replicate_count", *[f"{s}_{v}" for v in _SUMMARY_VALUES for s in ("mean", "sd")]))


# Fragments that reach into the next exon

_DOWN = f"""{with_('aln', 'walk', 'frag', 'intron', 'samples')},
down_hit AS (SELECT f.sample, f.qname, intron_id, CAST(CASE WHEN f.strand = '+' THEN five_prime - branchpoint_position ELSE branchpoint_position - five_prime END AS INTEGER) AS a, CAST(CASE WHEN f.strand = '+' THEN three_prime - branchpoint_position ELSE branchpoint_position - three_prime END AS INTEGER) AS b, CASE WHEN f.strand = '+' THEN three_prime - three_prime_ss ELSE three_prime_ss - three_prime END AS r
  FROM cont f JOIN intron i ON f.chrom = i.chrom AND f.strand = i.strand AND five_prime BETWEEN intron_start AND intron_end),
down_per AS (SELECT sample, qname, count(*) AS h, any_value(intron_id) AS i, any_value(a) AS a, any_value(b) AS b, any_value(r) AS r FROM down_hit WHERE r >= 5 GROUP BY 1, 2),
down AS (SELECT sample, qname, CASE WHEN h IS NULL THEN 'none' WHEN h > 1 THEN 'ambiguous' WHEN b < a THEN 'inverted' ELSE 'spanning' END AS outcome, CASE WHEN h = 1 AND b >= a THEN i END AS i, CASE WHEN h = 1 AND b >= a THEN a END AS a, CASE WHEN h = 1 AND b >= a THEN b END AS b, CASE WHEN h = 1 AND b >= a THEN r END AS r FROM cont LEFT JOIN down_per USING (sample, qname)),
down_n AS (SELECT sample, count(*) FILTER (outcome = 'spanning') AS downstream_exon_spanning_fragments, count(DISTINCT i) AS downstream_exon_spanning_introns, sum(r) AS reach_sum, count(*) FILTER (a BETWEEN -50 AND 50) AS profile_window_start_fragments,
  CAST(sum(greatest(least(b, 50) - greatest(a, -50) + 1, 0)) FILTER (a IS NOT NULL) AS BIGINT) AS profiled_coverage_positions, count(*) FILTER (a = 0) AS exact_branchpoint_start_fragments, count(*) FILTER (a = 1) AS plus_one_branchpoint_start_fragments, count(*) FILTER (a IN (0, 1)) AS zero_or_plus_one_branchpoint_start_fragments,
  count(*) FILTER (outcome = 'none') AS fragments_without_downstream_exon_assignment, count(*) FILTER (outcome = 'ambiguous') AS ambiguous_downstream_exon_fragments, count(*) FILTER (outcome = 'inverted') AS filtered_inverted_fragment_offsets FROM down GROUP BY 1),
down_c AS (SELECT condition, count(DISTINCT i) AS condition_union_downstream_exon_spanning_introns FROM down JOIN samples USING (sample) GROUP BY 1),
down_sum AS (SELECT s.condition, s.sample, condition_ordinal, audit.* EXCLUDE (sample), down_n.* EXCLUDE (sample, reach_sum), condition_union_downstream_exon_spanning_introns, (SELECT count(*) FROM intron) AS reference_introns, 5 AS downstream_exon_min_offset_nt, 50 AS profile_upstream_nt, 50 AS profile_downstream_nt,
  {_ratio('downstream_exon_spanning_fragments * 1e6', 'library_fragments')} AS downstream_exon_spanning_fragments_cpm, {_ratio('reach_sum', 'downstream_exon_spanning_fragments')} AS mean_downstream_exon_end_offset_nt,
  {', '.join(f"{_ratio(f'{k}_start_fragments', 'downstream_exon_spanning_fragments')} AS {k}_start_fraction, {_ratio(f'{k}_start_fragments * 100.0', 'downstream_exon_spanning_fragments')} AS {k}_start_percent" for k in ('profile_window', 'exact_branchpoint', 'plus_one_branchpoint', 'zero_or_plus_one_branchpoint'))}
  FROM samples s JOIN audit USING (sample) JOIN down_n USING (sample) JOIN down_c USING (condition))"""
_DOWN_RATES = ["downstream_exon_spanning_fragments_cpm", "mean_downstream_exon_end_offset_nt", *(f"{k}_start_{x}" for k in ("profile_window", "exact_branchpoint", "plus_one_branchpoint", "zero_or_plus_one_branchpoint") for x in ("fraction", "percent"))]


def _downstream(spark, sf_dir) -> downstream.Downstream:
    return downstream.Downstream(supplied.alignments(spark, sf_dir), supplied.introns(spark, sf_dir), supplied.samples(spark), CONFIG)


@query(_round(f"{_DOWN} FROM down_sum", *_DOWN_RATES))
def q_downstream_summary(spark, sf_dir):
    return _rounded(_downstream(spark, sf_dir).summary_by_sample())


_DOWN_VALUES = ["read_start_count", "coverage_count", "read_start_cpm", "read_start_fraction", "read_start_percent", "coverage_cpm", "coverage_fraction", "coverage_percent"]
_DOWN_PROFILE = f"""{_DOWN}, starts AS (SELECT sample, a AS o, count(*) AS n FROM down WHERE outcome = 'spanning' GROUP BY 1, 2), cover AS (SELECT sample, o, count(*) AS v FROM (SELECT sample, unnest(range(greatest(a, -50), least(b, 50) + 1)) AS o FROM down WHERE outcome = 'spanning') GROUP BY 1, 2),
profile AS (SELECT sample, condition, CAST(o AS INTEGER) AS offset_nt, coalesce(n, 0) AS read_start_count, coalesce(v, 0) AS coverage_count, {', '.join(f"{_ratio(f'coalesce({c}, 0) * 1e6', 'library_fragments')} AS {p}_cpm, {_ratio(f'coalesce({c}, 0)', 'downstream_exon_spanning_fragments')} AS {p}_fraction, {_ratio(f'coalesce({c}, 0) * 100.0', 'downstream_exon_spanning_fragments')} AS {p}_percent" for c, p in (('n', 'read_start'), ('v', 'coverage')))}
  FROM (SELECT *, unnest(range(-50, 51)) AS o FROM down_sum) LEFT JOIN starts USING (sample, o) LEFT JOIN cover USING (sample, o))"""


@query(f"{_DOWN_PROFILE}, stat AS ({_replicates('profile', 'condition, offset_nt', _DOWN_VALUES, until=10)}) FROM stat")
def q_downstream_profile(spark, sf_dir):
    return _rounded(_downstream(spark, sf_dir).metaprofile_by_condition())


# Genes: spliced and unspliced fragments


def _genes(spark, sf_dir) -> DataFrame:
    """A gene about each intron, of two exons."""
    span = lambda a, b: F.struct(F.expr(a).cast("long").alias("start"), F.expr(b).cast("long").alias("end"))
    plus = F.col("strand") == "+"
    rows = supplied.introns(spark, sf_dir).selectExpr("gene_id", "gene_name", "transcript_id", "chrom", "strand", "intron_start - 60 AS transcript_start", "intron_end + 60 AS transcript_end", "intron_start", "intron_end", "intron_length")
    return rows.select(
        "gene_id", "gene_name", "transcript_id", "chrom", "strand", "transcript_start", "transcript_end",
        F.when(plus, F.col("transcript_end")).otherwise(F.col("transcript_start")).alias("three_prime_end"),
        F.when(plus, F.col("intron_end") + 1).otherwise(F.col("transcript_start")).alias("terminal_exon_start"),
        F.when(plus, F.col("transcript_end")).otherwise(F.col("intron_start") - 1).alias("terminal_exon_end"),
        (F.col("intron_length") + 120).alias("transcript_length"), F.lit(120).cast("long").alias("exonic_length"), F.lit(2).alias("exon_count"), F.lit(1).alias("intron_count"),
        F.array(span("intron_start - 60", "intron_start - 1"), span("intron_end + 1", "intron_end + 60")).alias("exon_spans"),
        F.array(span("intron_start", "intron_end")).alias("intron_spans"),
    )


def _small_rna(spark, sf_dir) -> DataFrame:
    few = supplied.introns(spark, sf_dir).where("CAST(substr(intron_id, 2) AS BIGINT) % 19 = 0")
    return few.selectExpr("concat('S', intron_id) AS gene_id", "gene_name", "chrom", "strand", "intron_start + 5 AS start", "intron_start + 9 AS end", "'snoRNA' AS category")


def _premrna(spark, sf_dir) -> premrna.Quantified:
    return premrna.Quantified(supplied.alignments(spark, sf_dir), _genes(spark, sf_dir), _small_rna(spark, sf_dir), supplied.samples(spark), CONFIG)


_GENE = f"""{with_('aln', 'walk', 'intron', 'samples')}, {_LANE},
gene AS (SELECT gene_id, gene_name, transcript_id, chrom, strand, intron_start - 60 AS transcript_start, intron_end + 60 AS transcript_end, CASE WHEN strand = '+' THEN intron_end + 60 ELSE intron_start - 60 END AS three_prime_end, CASE WHEN strand = '+' THEN intron_end + 1 ELSE intron_start - 60 END AS terminal_exon_start,
  CASE WHEN strand = '+' THEN intron_end + 60 ELSE intron_start - 1 END AS terminal_exon_end, intron_length + 120 AS transcript_length, CAST(120 AS BIGINT) AS exonic_length, 2 AS exon_count, 1 AS intron_count FROM intron),
marked AS (SELECT 'exon' AS mark, gene_id, chrom, strand, intron_start - 60 AS s, intron_start - 1 AS e FROM intron UNION ALL SELECT 'exon', gene_id, chrom, strand, intron_end + 1, intron_end + 60 FROM intron
  UNION ALL SELECT 'intron', gene_id, chrom, strand, intron_start, intron_end FROM intron UNION ALL SELECT 'small', gene_id, chrom, strand, intron_start + 5, intron_start + 9 FROM intron WHERE CAST(substr(intron_id, 2) AS BIGINT) % 19 = 0),
block AS (SELECT l.sample, l.qname, lane.strand, l.chrom, bs, be FROM lane_span l JOIN lane USING (sample, qname) WHERE reason IS NULL),
touched AS (SELECT sample, qname, count(DISTINCT gene_id) FILTER (mark <> 'small') AS genes, min(gene_id) FILTER (mark <> 'small') AS gene_id, bool_or(mark = 'small') AS small, bool_or(mark = 'intron') AS intronic FROM block b JOIN marked m ON b.chrom = m.chrom AND b.strand = m.strand AND bs <= e AND s <= be GROUP BY 1, 2),
kinds AS (SELECT sample, qname, CASE WHEN coalesce(genes, 0) = 0 THEN 'no_gene_overlap' WHEN genes > 1 THEN 'ambiguous_same_strand_genes' WHEN small THEN 'small_ncrna_overlap' WHEN intronic THEN 'intronic' ELSE 'mrna' END AS kind, CASE WHEN genes = 1 THEN gene_id END AS gene_id FROM lane LEFT JOIN touched USING (sample, qname) WHERE reason IS NULL),
lane_n AS (SELECT sample, count(*) AS query_groups_examined, count(*) FILTER (reason IS NULL) AS library_fragments, {', '.join(f"count(*) FILTER (reason = '{r}') AS filtered_{r}" for r in fragments.GENE_REASONS)} FROM lane GROUP BY 1),
gene_n AS (SELECT sample, gene_id, count(*) FILTER (kind = 'mrna') AS mrna_fragments, count(*) FILTER (kind = 'intronic') AS intronic_fragments, count(*) AS total_gene_fragments FROM kinds WHERE kind IN ('mrna', 'intronic') GROUP BY 1, 2),
cut AS (SELECT k.sample, k.gene_id, g.strand, three_prime_end AS t, greatest(bs, ws) AS a, least(be, we) AS b FROM kinds k JOIN block USING (sample, qname) JOIN gene g ON g.gene_id = k.gene_id
  JOIN (SELECT m.gene_id, greatest(s, CASE WHEN m.strand = '+' THEN three_prime_end - 1000 ELSE three_prime_end - 100 END) AS ws, least(e, CASE WHEN m.strand = '+' THEN three_prime_end + 100 ELSE three_prime_end + 1000 END) AS we FROM marked m JOIN gene USING (gene_id) WHERE mark = 'exon') w ON w.gene_id = k.gene_id AND bs <= we AND ws <= be WHERE kind = 'mrna'),
gene_cov AS (SELECT sample, gene_id, CAST(o AS INTEGER) AS offset_nt, count(*) AS coverage_count FROM (SELECT sample, gene_id, unnest(range(greatest(CASE WHEN strand = '+' THEN a - t ELSE t - b END, -1000), least(CASE WHEN strand = '+' THEN b - t ELSE t - a END, 100) + 1)) AS o FROM cut) GROUP BY 1, 2, 3)"""


def _gene_rates(library: str, total: str, names: tuple[str, str] = ("mrna_cpm", "intronic_cpm")) -> str:
    each = ", ".join(f"{_ratio(f'{k}_fragments * 1e6', library)} AS {n}, {_ratio(f'{k}_fragments', total)} AS {k}_fraction_gene_reads, {_ratio(f'{k}_fragments * 100.0', total)} AS {k}_percent_gene_reads" for k, n in zip(("mrna", "intronic"), names))
    return f"{each}, CAST(intronic_fragments AS DOUBLE) / nullif(mrna_fragments, 0) AS intronic_to_mrna_ratio"


_GENE_RATES = [f"{k}_{x}" for k in ("mrna", "intronic") for x in ("cpm", "fraction_gene_reads", "percent_gene_reads")] + ["intronic_to_mrna_ratio"]


@query(_round(f"""{_GENE} SELECT *, row_number() OVER (ORDER BY sample, total_gene_fragments DESC, gene_name, gene_id) AS row_rank FROM (SELECT sample, condition, gene.*, total_gene_fragments, {_ratio('total_gene_fragments * 1e6', 'library_fragments')} AS total_gene_cpm, mrna_fragments, intronic_fragments, {_gene_rates('library_fragments', 'total_gene_fragments')}
  FROM gene_n JOIN gene USING (gene_id) JOIN lane_n USING (sample) JOIN samples USING (sample))""", "total_gene_cpm", *_GENE_RATES))
def q_gene_counts(spark, sf_dir):
    return _rounded(layout.ranked(_premrna(spark, sf_dir).gene_counts(), ["sample", F.desc("total_gene_fragments"), "gene_name", "gene_id"]))


@query(f"{_GENE} SELECT sample, condition, gene_id, gene_name, offset_nt, coverage_count FROM gene_cov JOIN gene USING (gene_id) JOIN samples USING (sample)")
def q_gene_coverage(spark, sf_dir):
    return _premrna(spark, sf_dir).coverage()


_GENE_SUMMARY = f"""{_GENE}, kind_n AS (SELECT sample, count(*) FILTER (kind = 'no_gene_overlap') AS fragments_without_mane_gene_overlap, count(*) FILTER (kind = 'ambiguous_same_strand_genes') AS ambiguous_same_strand_gene_fragments, count(*) FILTER (kind = 'small_ncrna_overlap') AS fragments_excluded_by_small_ncrna_overlap,
  count(*) FILTER (kind = 'mrna') AS mrna_fragments, count(*) FILTER (kind = 'intronic') AS intronic_fragments, count(DISTINCT gene_id) FILTER (kind IN ('mrna', 'intronic')) AS genes_with_reads, count(DISTINCT gene_id) FILTER (kind = 'mrna') AS mrna_genes_with_reads, count(DISTINCT gene_id) FILTER (kind = 'intronic') AS intronic_genes_with_reads FROM kinds GROUP BY 1),
cov_n AS (SELECT sample, CAST(sum(coverage_count) AS BIGINT) AS profiled_coverage_positions FROM gene_cov GROUP BY 1),
gene_sum AS (SELECT *, {_gene_rates('library_fragments', 'assigned_gene_fragments', ('mrna_fragments_cpm', 'intronic_fragments_cpm'))}, {_ratio('assigned_gene_fragments * 1e6', 'library_fragments')} AS assigned_gene_fragments_cpm FROM (
  SELECT s.*, lane_n.* EXCLUDE (sample), kind_n.* EXCLUDE (sample), coalesce(profiled_coverage_positions, 0) AS profiled_coverage_positions, (SELECT count(*) FROM gene) AS reference_genes, (SELECT count(*) FROM marked WHERE mark = 'small') AS small_ncrna_reference_genes, CAST(0 AS BIGINT) AS unclassified_gene_fragments, 1000 AS metaprofile_upstream_nt, 100 AS metaprofile_downstream_nt,
    mrna_fragments + intronic_fragments AS assigned_gene_fragments FROM samples s JOIN lane_n USING (sample) JOIN kind_n USING (sample) LEFT JOIN cov_n USING (sample)))"""
_GENE_SUMMARY_RATES = [*(r.replace("_cpm", "_fragments_cpm") for r in _GENE_RATES), "assigned_gene_fragments_cpm"]


@query(_round(f"{_GENE_SUMMARY} FROM gene_sum", *_GENE_SUMMARY_RATES))
def q_gene_summary(spark, sf_dir):
    return _rounded(_premrna(spark, sf_dir).summary())


def _gene_aggregated(spark, sf_dir) -> premrna.Aggregated:
    q = _premrna(spark, sf_dir)
    return premrna.Aggregated(q.gene_counts(), q.coverage(), q.summary(), CONFIG, SAMPLES)


_SHARED = f"""{_GENE_SUMMARY}, shared AS (SELECT gene_id FROM gene_n WHERE total_gene_fragments >= 1 GROUP BY 1 HAVING count(*) = {len(SAMPLES)})"""


@query(
    f"""{_SHARED}, wide AS (SELECT {', '.join(premrna.GENE[:10])}, {', '.join(f"CAST(coalesce(sum({k}_fragments) FILTER (sample = '{s}'), 0) AS BIGINT) AS {s}_{k}_fragments" for s in SAMPLES for k in ('total_gene', 'mrna', 'intronic'))} FROM gene_n JOIN gene USING (gene_id) WHERE gene_id IN (FROM shared) GROUP BY ALL)
SELECT *, least({', '.join(f'{s}_total_gene_fragments' for s in SAMPLES)}) AS min_total_gene_fragments_all_samples FROM wide"""
)
def q_gene_shared(spark, sf_dir):
    return _gene_aggregated(spark, sf_dir).shared_genes()


_GENE_VALUES = ["coverage_count", "coverage_cpm", "coverage_fraction_gene_reads", "coverage_percent_gene_reads"]
_GENE_PROFILE = f"""{_SHARED}, mine AS (SELECT sample, CAST(sum(total_gene_fragments) AS BIGINT) AS assigned FROM gene_n WHERE gene_id IN (FROM shared) GROUP BY 1), counts AS (SELECT sample, offset_nt AS o, CAST(sum(coverage_count) AS BIGINT) AS n FROM gene_cov WHERE gene_id IN (FROM shared) GROUP BY 1, 2),
profile AS (SELECT sample, condition, CAST(o AS INTEGER) AS offset_nt, coalesce(n, 0) AS coverage_count, {_ratio('coalesce(n, 0) * 1e6', 'library_fragments')} AS coverage_cpm, {_ratio('coalesce(n, 0)', 'assigned')} AS coverage_fraction_gene_reads, {_ratio('coalesce(n, 0) * 100.0', 'assigned')} AS coverage_percent_gene_reads
  FROM (SELECT sample, condition, library_fragments, assigned, unnest(range(-1000, 101)) AS o FROM gene_sum JOIN mine USING (sample)) LEFT JOIN counts USING (sample, o))"""


@query(f"{_GENE_PROFILE}, stat AS ({_replicates('profile', 'condition, offset_nt', _GENE_VALUES)}) FROM stat")
def q_gene_profile(spark, sf_dir):
    return _rounded(_gene_aggregated(spark, sf_dir).metaprofile_by_condition())


# Long reads

#: Two branchpoints in each intron; the ordinal is their place in the file.
_POINT = {"chrom": "chrom", "position": "branchpoint_position", "strand": "strand", "score": "branchpoint_score", "intron_type": "branchpoint_type", "ordinal": "2 * CAST(substr(intron_id, 2) AS BIGINT)"}
_SECOND = _POINT | {"position": "branchpoint_position + 3", "score": "1 - branchpoint_score", "ordinal": "2 * CAST(substr(intron_id, 2) AS BIGINT) + 1"}


def _point_text(fields: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in fields.items())


def _points(spark, sf_dir) -> DataFrame:
    rows = supplied.introns(spark, sf_dir)
    of = lambda fields: rows.selectExpr(*[f"{e} AS {n}" for n, e in fields.items()])
    return of(_POINT).unionByName(of(_SECOND))


def _plain_introns(spark, sf_dir) -> DataFrame:
    return supplied.introns(spark, sf_dir).selectExpr("intron_id", "transcript_id", "intron_number", "gene_id", "gene_name", "chrom", "strand", "intron_start AS start", "intron_end AS end")


def _long(spark, sf_dir) -> longread.LongReads:
    return longread.LongReads(supplied.alignments(spark, sf_dir), _plain_introns(spark, sf_dir), _points(spark, sf_dir), CONFIG)


_L = f"""{with_('aln', 'walk', 'intron')}, point AS ({" UNION ALL ".join(f"SELECT {_point_text(f)} FROM intron" for f in (_POINT, _SECOND))}),
md AS (SELECT rid, CAST(sum(n) FILTER (op IN ('M', 'D')) AS BIGINT) AS md FROM ops GROUP BY 1),
rd AS (SELECT rid, sample, rname AS chrom, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, pos AS rs, pos + coalesce(md, 0) AS re FROM aln JOIN md USING (rid) WHERE flag & 2304 = 0 AND flag & 4 = 0 AND mapq > 20 AND cigar IS NOT NULL),
top AS (SELECT * FROM (SELECT intron_id AS top, p.chrom, p.strand, position, row_number() OVER (PARTITION BY intron_id ORDER BY score DESC, ordinal) AS i FROM point p JOIN intron i ON p.chrom = i.chrom AND p.strand = i.strand AND position BETWEEN intron_start AND intron_end) WHERE i = 1),
single AS (SELECT intron_id, any_value(i.chrom) AS chrom, any_value(i.strand) AS strand, any_value(intron_start) AS s, any_value(intron_end) AS e FROM intron i JOIN top t ON t.chrom = i.chrom AND position BETWEEN intron_start AND intron_end GROUP BY 1 HAVING count(*) = 1),
over_n AS (SELECT rid, count(*) AS b FROM rd JOIN point p ON p.chrom = rd.chrom AND p.strand = rd.strand AND position BETWEEN rs AND re GROUP BY 1),
covered AS (SELECT DISTINCT sample, intron_id FROM rd JOIN over_n USING (rid) JOIN single i ON i.chrom = rd.chrom AND i.strand = rd.strand AND s - 3 <= rs AND e + 3 >= re),
shared AS (SELECT * FROM single WHERE intron_id IN (SELECT intron_id FROM covered)),
held AS (SELECT rd.*, intron_id FROM rd JOIN shared i ON i.chrom = rd.chrom AND i.strand = rd.strand AND s - 3 <= rs AND e + 3 >= re),
named AS (SELECT DISTINCT sample FROM rd)"""


def _long_dense(counts: str, low: int, high: int) -> str:
    return f"""SELECT sample AS protein, CAST(o AS INTEGER) AS strand_corrected_position, coalesce(n, 0) AS score, CAST(coalesce(n, 0) AS DOUBLE) / nullif(max(coalesce(n, 0)) OVER (PARTITION BY sample), 0) AS normalised_coverage FROM (SELECT sample, unnest(range({low}, {high + 1})) AS o FROM named) LEFT JOIN {counts} USING (sample, o)"""


@query(_round(f"""{_L}, hit AS (SELECT sample, i.strand, three_prime_ss AS t, greatest(rs, three_prime_ss - 100) AS a, least(re, three_prime_ss + 100) AS b FROM intron i JOIN rd ON i.chrom = rd.chrom AND i.strand = rd.strand AND three_prime_ss BETWEEN rs AND re),
counts AS (SELECT sample, o, count(*) AS n FROM (SELECT sample, unnest(range(greatest(CASE WHEN strand = '+' THEN a - t ELSE t - b END, -100), least(CASE WHEN strand = '+' THEN b - t ELSE t - a END, 99) + 1)) AS o FROM hit) GROUP BY 1, 2)
{_long_dense('counts', -100, 99)}""", "normalised_coverage"))
def q_long_three_prime(spark, sf_dir):
    return _rounded(_long(spark, sf_dir).three_prime_coverage())


_L_COVERAGE = f"""{_L}, held_n AS (SELECT rid, count(*) AS introns FROM held GROUP BY 1),
bp_hit AS (SELECT sample, rd.strand, position AS t, introns, greatest(rs, position - 60) AS a, least(re, position + 60) AS b FROM rd JOIN held_n USING (rid) JOIN top ON top.chrom = rd.chrom AND top.strand = rd.strand AND position BETWEEN rs AND re),
bp_n AS (SELECT sample, o, CAST(sum(introns) AS BIGINT) AS n FROM (SELECT sample, introns, unnest(range(greatest(CASE WHEN strand = '+' THEN a - t ELSE t - b END, -60), least(b - t, 60) + 1)) AS o FROM bp_hit) GROUP BY 1, 2),
bp_cov AS ({_long_dense('bp_n', -60, 60)})"""


@query(_round(f"{_L_COVERAGE} FROM bp_cov", "normalised_coverage"))
def q_long_branchpoint(spark, sf_dir):
    return _rounded(_long(spark, sf_dir).branchpoint_coverage())


_L_DELETIONS = f"""{_L_COVERAGE}, md_walk AS (SELECT rid, op, n, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spot FROM ops),
deleted AS (SELECT rd.rid, rd.sample, rd.chrom, rd.strand, b, unnest(range(spot + 1, spot + n + 1)) AS d FROM md_walk JOIN rd USING (rid) JOIN over_n USING (rid) WHERE op = 'D'),
events AS (SELECT rid, sample, d.chrom, d.strand, d, b, b * count(*) AS events FROM deleted d JOIN shared i ON i.chrom = d.chrom AND i.strand = d.strand AND s - 3 <= d AND e + 3 >= d GROUP BY rid, sample, d.chrom, d.strand, d, b),
relative AS (SELECT rid, sample, ordinal, events, CAST(CASE WHEN e.strand = '+' THEN d - position ELSE position - d END AS INTEGER) AS o FROM events e JOIN point p ON p.chrom = e.chrom AND p.strand = e.strand AND position BETWEEN d - 60 AND d + 60)"""
_L_PROFILE = f"""{_L_DELETIONS}, each AS (SELECT rid, sample, ordinal, o, unnest(range(events)) AS copy FROM relative),
marked AS (SELECT *, CASE WHEN o - lag(o) OVER w = 1 THEN 0 ELSE 1 END AS fresh, row_number() OVER w AS i FROM each WINDOW w AS (PARTITION BY rid, ordinal ORDER BY o)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, ordinal ORDER BY i) AS r FROM marked), weighed AS (SELECT sample, o, 1.0 / count(*) OVER (PARTITION BY rid, ordinal, r) AS w FROM run),
counts AS (SELECT sample, o, count(*) AS count, CAST(sum(CAST(w AS DOUBLE)) AS DOUBLE) AS count_cons FROM weighed GROUP BY 1, 2),
denominator AS (SELECT sample, sum(b) AS denominator FROM (SELECT DISTINCT sample, rid, b FROM events) GROUP BY 1),
deletion AS (SELECT sample AS protein, strand_corrected_position, count_cons, count, CAST(count AS DOUBLE) / denominator AS normalised_count, count_cons / denominator AS normalised_count_cons, score, normalised_coverage, count / denominator / nullif(normalised_coverage, 0) AS coverage_normalised, count_cons / denominator / nullif(normalised_coverage, 0) AS coverage_normalised_cons
  FROM counts JOIN denominator USING (sample) JOIN bp_cov ON protein = sample AND strand_corrected_position = o)"""


@query(_round(f"{_L_PROFILE} FROM deletion", "count_cons", "normalised_count", "normalised_count_cons", "normalised_coverage", "coverage_normalised", "coverage_normalised_cons"))
def q_long_deletions(spark, sf_dir):
    return _rounded(_long(spark, sf_dir).deletion_profile())


@query(f"{_L_PROFILE}, base AS (SELECT protein, median(coverage_normalised) AS baseline FROM deletion WHERE strand_corrected_position <= 10 GROUP BY 1) SELECT protein, round(any_value(baseline), 6) AS baseline, round(coalesce(sum(coverage_normalised - baseline) FILTER (strand_corrected_position BETWEEN -4 AND 2), 0.0), 6) AS area_under_peak FROM deletion JOIN base USING (protein) GROUP BY 1")
def q_long_area(spark, sf_dir):
    return _rounded(_long(spark, sf_dir).area())


@query(
    f"""{_L_DELETIONS}, found AS (SELECT 'reference' AS scope, 'introns' AS metric, count(*) AS value FROM intron UNION ALL SELECT 'reference', 'branchpoints', count(*) FROM point UNION ALL SELECT 'reference', 'top_branchpoints', count(*) FROM top UNION ALL SELECT 'reference', 'single_top_branchpoint_introns', count(*) FROM single
UNION ALL SELECT 'analysis', 'union_covered_introns', count(*) FROM shared UNION ALL SELECT sample, 'filtered_primary_alignments', count(*) FROM rd GROUP BY 1 UNION ALL SELECT sample, 'covered_candidate_introns', count(*) FROM covered GROUP BY 1 UNION ALL SELECT sample, 'high_coverage_read_hits', count(*) FROM held GROUP BY 1
UNION ALL SELECT sample, 'deletion_reads', count(*) FROM (SELECT DISTINCT sample, rid FROM events) GROUP BY 1 UNION ALL SELECT sample, 'deletion_normalisation_read_overlaps', CAST(sum(b) AS BIGINT) FROM (SELECT DISTINCT sample, rid, b FROM events) GROUP BY 1 UNION ALL SELECT sample, 'metaprofile_deletion_rows', CAST(sum(events) AS BIGINT) FROM relative GROUP BY 1) FROM found"""
)
def q_long_diagnostics(spark, sf_dir):
    return _long(spark, sf_dir).diagnostics()


# Kinds of RNA

_KIND_OF = "list_value('snoRNA', 'miRNA', 'tRNA', 'lncRNA', 'protein_coding_intron', 'protein_coding_exon', 'pseudogene', 'annotated', 'annotated', 'misc_RNA', 'snRNA')"
_R = f"""{with_('aln', 'walk', 'intron')}, category AS (SELECT {_KIND_OF}[CAST(1 + CAST(substr(intron_id, 2) AS BIGINT) % 11 AS INTEGER)] AS category, chrom, intron_start AS s, intron_end AS e FROM intron UNION ALL SELECT 'annotated', chrom, intron_start - 60, intron_end FROM intron),
mapped AS (SELECT sample, qname, rname, rid FROM aln WHERE flag & 2304 = 0 AND flag & 4 = 0),
seen AS (SELECT DISTINCT sample, qname, category FROM mapped JOIN spans USING (rid) JOIN category c ON c.chrom = rname AND bs <= e AND s <= be UNION SELECT sample, qname, 'mitochondrial' FROM mapped WHERE rname = 'chrM'),
tiers(category, tier) AS (VALUES ('mitochondrial', 1), {', '.join(f"('{c}', 2)" for c in references.SMALL)}, ('lncRNA', 3), ('protein_coding_intron', 4), ('protein_coding_exon', 5), ('pseudogene', 6)),
ranked AS (SELECT sample, qname, tier, count(*) AS n, min(category) AS category, row_number() OVER (PARTITION BY sample, qname ORDER BY tier) AS i FROM seen JOIN tiers USING (category) GROUP BY 1, 2, 3),
pair AS (SELECT p.sample, p.qname, CASE WHEN r.tier IS NOT NULL THEN CASE WHEN r.n = 1 THEN r.category ELSE 'ambiguous' END WHEN EXISTS (FROM seen x WHERE x.sample = p.sample AND x.qname = p.qname AND x.category = 'annotated') THEN 'other_annotated_genic' ELSE 'intergenic' END AS category
  FROM (SELECT DISTINCT sample, qname FROM mapped) p LEFT JOIN (SELECT * FROM ranked WHERE i = 1) r ON r.sample = p.sample AND r.qname = p.qname),
went AS (SELECT sample, count(DISTINCT qname) + 1000 AS total_input_pairs, count(DISTINCT qname) + 100 AS genome_input_pairs FROM aln GROUP BY 1),
base AS (SELECT went.*, genome_input_pairs - (SELECT count(*) FROM pair p WHERE p.sample = went.sample) AS unmapped FROM went),
counted AS (SELECT sample, category, count(*) AS n FROM pair GROUP BY 1, 2 UNION ALL SELECT sample, 'rRNA', count(DISTINCT qname) FROM mapped WHERE rname = 'chrM' GROUP BY 1 UNION ALL SELECT sample, 'snRNA', count(DISTINCT qname) FROM mapped WHERE rname = 'chr1' GROUP BY 1 UNION ALL SELECT sample, 'genome_unmapped', unmapped FROM base),
kind(category, ordinal) AS (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(rna_content.OUTPUT))}),
content0 AS (SELECT b.sample, k.category, k.ordinal, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM counted c WHERE c.sample = b.sample AND c.category = k.category), 0) AS count, total_input_pairs AS t, total_input_pairs - unmapped AS c FROM base b CROSS JOIN kind k),
content AS (SELECT sample, category, ordinal, count, printf('%.6f', coalesce(CAST(count AS DOUBLE) / nullif(t, 0), 0)) AS fraction_of_total_input_pairs, CASE WHEN category = 'genome_unmapped' OR c = 0 THEN 'NA' ELSE printf('%.6f', CAST(count AS DOUBLE) / c) END AS fraction_of_classified_pairs FROM content0)"""


def _content(spark, sf_dir) -> DataFrame:
    a = supplied.alignments(spark, sf_dir)
    introns = supplied.introns(spark, sf_dir)
    names = F.array(*[F.lit(x) for x in ("snoRNA", "miRNA", "tRNA", "lncRNA", "protein_coding_intron", "protein_coding_exon", "pseudogene", "annotated", "annotated", "misc_RNA", "snRNA")])
    number = F.expr("CAST(substr(intron_id, 2) AS BIGINT)")
    kinds = introns.select(F.get(names, (number % 11).cast("int")).alias("category"), "chrom", F.col("intron_start").alias("start"), F.col("intron_end").alias("end"))
    genic = introns.select(F.lit("annotated").alias("category"), "chrom", (F.col("intron_start") - 60).alias("start"), F.col("intron_end").alias("end"))
    pairs = rna_content.classified(a, kinds.unionByName(genic))
    went = a.groupBy("sample").agg((F.count_distinct("qname") + 1000).alias("total_input_pairs"), (F.count_distinct("qname") + 100).alias("genome_input_pairs"))
    return rna_content.content(spark, pairs, went, rna_content.distinct_names(a.where("rname = 'chrM'")), rna_content.distinct_names(a.where("rname = 'chr1'")))


@query(f"{_R} SELECT sample, category, count, fraction_of_total_input_pairs, fraction_of_classified_pairs, row_number() OVER (ORDER BY sample, ordinal) AS row_rank FROM content")
def q_rna_content(spark, sf_dir):
    order = F.array_position(F.array(*[F.lit(x) for x in rna_content.OUTPUT]), F.col("category"))
    return layout.ranked(_content(spark, sf_dir), ["sample", order])


_BROAD = "{" + ", ".join(f"'{k}': '{v}'" for k, v in content_levels.BROAD.items()) + "}"
_LEVELS = f"""{_R}, shown AS (SELECT *, regexp_extract(sample, '^[^_]+') AS condition, CAST(fraction_of_total_input_pairs AS DOUBLE) * 100 AS p FROM content WHERE category <> 'genome_unmapped'),
broad AS (SELECT sample, condition, coalesce(map_extract(MAP {_BROAD}, category)[1], 'other RNA') AS broad_category, sum(p) AS percent_total FROM shown GROUP BY 1, 2, 3),
broad_m AS (SELECT *, sum(percent_total) OVER (PARTITION BY sample) AS mapped_percent_of_input, list_position({list(content_levels.BROAD_ORDER)}, broad_category) AS place FROM broad)"""


@query(_round(f"{_LEVELS}, share AS (SELECT *, percent_total / mapped_percent_of_input * 100 AS percent_mapped FROM broad_m) SELECT * EXCLUDE (place), sum(percent_mapped) OVER (PARTITION BY sample ORDER BY place ROWS UNBOUNDED PRECEDING) - percent_mapped / 2 AS label_x FROM share", "percent_total", "mapped_percent_of_input", "percent_mapped", "label_x"))
def q_content_broad(spark, sf_dir):
    return _rounded(content_levels.label_places(content_levels.broad(_content(spark, sf_dir))))


_SUB = "{" + ", ".join(f"'{k}': '{v}'" for k, v in content_levels.SUBTYPES.items()) + "}"


@query(_round(f"""{_LEVELS}, sub AS (SELECT sample, condition, map_extract(MAP {_SUB}, category)[1] AS subtype, sum(p) AS percent_total FROM shown GROUP BY 1, 2, 3 HAVING subtype IS NOT NULL),
sub_m AS (SELECT sub.*, m AS mapped_percent_of_input, percent_total / m * 100 AS percent_mapped FROM sub JOIN (SELECT sample, any_value(mapped_percent_of_input) AS m FROM broad_m GROUP BY 1) USING (sample)), mean AS (SELECT *, avg(percent_mapped) OVER (PARTITION BY subtype) AS mean_percent FROM sub_m) SELECT * FROM mean WHERE mean_percent > 0""", "percent_total", "mapped_percent_of_input", "percent_mapped", "mean_percent"))
def q_content_subtypes(spark, sf_dir):
    return _rounded(content_levels.subtypes(_content(spark, sf_dir)))


# Overlap of conditions by rank


def _overlap(spark, sf_dir) -> percentile.Overlap:
    sites = _quantified(spark, sf_dir).site_counts().withColumn("ordinal", F.struct("sample", "intron_id"))
    return percentile.Overlap(sites, "ILS", "DIS", ["gene_id", "gene_name"], CONFIG)


_OVERLAP = f"""{_BP}, per AS (SELECT intron_id, any_value(gene_id) AS gene_id, any_value(gene_name) AS gene_name, CAST(coalesce(sum(anchored_fragments) FILTER (condition = 'ILS'), 0) AS BIGINT) AS r, CAST(coalesce(sum(anchored_fragments) FILTER (condition = 'DIS'), 0) AS BIGINT) AS q, count(DISTINCT sample) FILTER (condition = 'DIS' AND anchored_fragments > 0) AS k FROM site GROUP BY 1),
ranked AS (SELECT * FROM per WHERE r > 0)"""


@query(f"{_OVERLAP} SELECT intron_id, gene_id, gene_name, 'ILS' AS reference_condition, 'DIS' AS query_condition, r AS reference_anchored_fragments, q AS query_anchored_fragments, k AS query_samples_with_anchored_fragments, CASE WHEN k > 0 THEN 1 ELSE 0 END AS query_has_any_anchored_fragments, row_number() OVER (ORDER BY r DESC, gene_name, intron_id) AS row_rank FROM ranked")
def q_overlap_introns(spark, sf_dir):
    return layout.ranked(_overlap(spark, sf_dir).intron_counts(), [F.desc("reference_anchored_fragments"), "gene_name", "intron_id"])


_CURVE = f"""{_OVERLAP}, ratio AS (SELECT {_ratio('sum(q)', 'sum(r)')} AS ratio FROM per), cuts AS (SELECT unnest(range(1, 100)) AS i, round(unnest(quantile_cont(CAST(r AS DOUBLE), [{', '.join(str(i / 100) for i in range(1, 100))}])), 9) AS c FROM ranked),
curve AS (SELECT 'ILS' AS reference_condition, 'DIS' AS query_condition, CAST(i AS INTEGER) AS reference_percentile_cutoff, c AS reference_anchored_fragment_cutoff, count(*) AS reference_introns_at_or_above_cutoff, count(*) FILTER (k > 0) AS query_introns_with_any_anchored_fragments, count(*) FILTER (k = 0) AS query_introns_without_anchored_fragments, count(*) FILTER (k > 0) * 100.0 / count(*) AS query_covered_percent,
  any_value(ratio) AS query_to_reference_anchored_fragment_ratio, any_value(least(1.0, ratio)) AS random_thinning_fraction, sum(1 - (1 - least(1.0, ratio)) ** r) AS random_thinning_expected_introns_with_anchored_fragments, sum(1 - (1 - least(1.0, ratio)) ** r) * 100.0 / count(*) AS random_thinning_expected_covered_percent,
  CAST(sum(r) AS BIGINT) AS reference_anchored_fragments_at_or_above_cutoff, CAST(sum(q) AS BIGINT) AS query_anchored_fragments_in_reference_introns_at_or_above_cutoff, (SELECT count(*) FROM ranked) AS total_reference_anchor_positive_introns FROM cuts JOIN ranked ON r >= c CROSS JOIN ratio GROUP BY i, c)"""
_CURVE_RATES = ["reference_anchored_fragment_cutoff", "query_covered_percent", "query_to_reference_anchored_fragment_ratio", "random_thinning_fraction", "random_thinning_expected_introns_with_anchored_fragments", "random_thinning_expected_covered_percent"]


@query(_round(f"{_CURVE} FROM curve", *_CURVE_RATES))
def q_overlap_summary(spark, sf_dir):
    return _rounded(_overlap(spark, sf_dir).summary())


@query(f"{_CURVE}, one AS (SELECT query_covered_percent AS p FROM curve WHERE reference_percentile_cutoff = 50), pie AS (SELECT 'observed in DIS' AS category, round(p, 6) AS percent FROM one UNION ALL SELECT 'not observed in DIS', round(100 - p, 6) FROM one) FROM pie")
def q_overlap_pie(spark, sf_dir):
    return _rounded(exports.pie(_overlap(spark, sf_dir).summary(), "DIS"))


# References from annotation


def _gtf(spark, sf_dir) -> DataFrame:
    """Annotation of a gene with three exons about each intron; every fifth has an exon within the first one besides."""
    rows = supplied.introns(spark, sf_dir).selectExpr("CAST(substr(intron_id, 2) AS BIGINT) AS c", "gene_name", "chrom", "strand", "intron_start AS s", "intron_end AS e")
    said = F.expr(f"""concat('gene_id "G', c, '"; transcript_id "T', c, '"; gene_type "', {_GENE_TYPE}, '"; ', CASE WHEN c % 10 = 0 THEN '' ELSE concat('gene_name "', gene_name, '"; ') END, 'tag "basic"; ', CASE WHEN c % 4 <> 3 THEN 'tag "MANE_Select";' ELSE '' END)""")
    line = lambda feature, a, b, when="TRUE": F.expr(f"CASE WHEN {when} THEN named_struct('feature', '{feature}', 'start', {a}, 'end', {b}) END")
    lines = F.array(line("gene", "s - 60", "e + 150"), line("transcript", "s - 60", "e + 150"), *[line("exon", a, b, w) for a, b, w in _EXONS])
    each = rows.withColumn("attributes", said).withColumn("x", F.explode(lines)).where("x IS NOT NULL")
    return each.select("chrom", F.lit("made").alias("source"), "x.feature", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.lit(".").alias("score"), "strand", F.lit(".").alias("frame"), "attributes")


_GENE_TYPE = "CASE c % 6 WHEN 4 THEN 'lincRNA' WHEN 5 THEN 'snoRNA' ELSE 'protein_coding' END"
_EXONS = (("e + 1", "e + 60", "TRUE"), ("s - 60", "s - 1", "TRUE"), ("s - 30", "s - 1", "c % 5 = 0"), ("e + 101", "e + 150", "TRUE"))
_G = f"""{with_('intron')}, made AS (SELECT CAST(substr(intron_id, 2) AS BIGINT) AS c, 'G' || substr(intron_id, 2) AS gene_id, 'T' || substr(intron_id, 2) AS transcript_id, CASE WHEN c % 10 = 0 THEN NULL ELSE gene_name END AS gene_name, chrom, strand, intron_start AS s, intron_end AS e, {_GENE_TYPE} AS gene_type FROM intron),
coding AS (SELECT * FROM made WHERE gene_type = 'protein_coding' AND c % 4 <> 3),
chosen_intron AS (SELECT transcript_id || ':intron_1' AS intron_id, transcript_id, 1 AS intron_number, gene_id, coalesce(gene_name, gene_id) AS gene_name, chrom, strand, s AS start, e AS end_ FROM coding UNION ALL SELECT transcript_id || ':intron_2', transcript_id, 2, gene_id, coalesce(gene_name, gene_id), chrom, strand, e + 61, e + 100 FROM coding),
point AS ({" UNION ALL ".join(f"SELECT {_point_text(f)} FROM intron" for f in (_POINT, _SECOND))}),
exon AS ({" UNION ALL ".join(f"SELECT c, gene_id, transcript_id, gene_name, gene_type, chrom, strand, {a} AS s, {b} AS e FROM made WHERE {w}" for a, b, w in _EXONS)})"""


#: Of every fifth gene the exon within the first one makes a gap of its own between sorted exons, which is empty and left out, but counted.
@query(f"""{_G} SELECT transcript_id || ':intron_' || number AS intron_id, transcript_id, CAST(number AS INTEGER) AS intron_number, gene_id, coalesce(gene_name, gene_id) AS gene_name, chrom, strand, a AS "start", b AS "end"
FROM (SELECT *, e + 1 AS a, lead(s) OVER w - 1 AS b, row_number() OVER w AS number FROM exon WHERE gene_type = 'protein_coding' AND c % 4 <> 3 WINDOW w AS (PARTITION BY transcript_id ORDER BY s, e)) WHERE a <= b""")
def q_ref_introns(spark, sf_dir):
    return references.selected_introns(_gtf(spark, sf_dir))


@query(
    f"""{_G}, hit AS (SELECT i.*, p.position, p.score, p.intron_type, {along('position', "CASE WHEN strand = '+' THEN end_ ELSE start END").replace('strand =', 'i.strand =')} AS o, count(*) OVER (PARTITION BY intron_id) AS candidates FROM chosen_intron i JOIN point p ON p.chrom = i.chrom AND p.strand = i.strand AND position BETWEEN start AND end_),
best AS (SELECT *, row_number() OVER (PARTITION BY intron_id ORDER BY score DESC, -o, CASE WHEN strand = '+' THEN -position ELSE position END, intron_type) AS best_place FROM hit)
SELECT CASE WHEN c % 5 = 0 AND n = 2 THEN transcript_id || ':intron_3' WHEN c % 5 = 0 THEN transcript_id || ':intron_2' ELSE intron_id END AS intron_id, transcript_id, CAST(CASE WHEN c % 5 = 0 THEN n + 1 ELSE n END AS INTEGER) AS intron_number, gene_id, gene_name, chrom, strand, intron_start, intron_end, intron_length, three_prime_ss, branchpoint_position, branchpoint_score, branchpoint_to_3ss_nt, branchpoint_type, branchpoint_candidates,
  row_number() OVER (ORDER BY chrom, intron_start, intron_end, transcript_id) AS row_rank
FROM (SELECT intron_id, transcript_id, CAST(substr(transcript_id, 2) AS BIGINT) AS c, intron_number AS n, gene_id, gene_name, chrom, strand, start AS intron_start, end_ AS intron_end, end_ - start + 1 AS intron_length, CASE WHEN strand = '+' THEN end_ ELSE start END AS three_prime_ss, position AS branchpoint_position, score AS branchpoint_score, -o AS branchpoint_to_3ss_nt, intron_type AS branchpoint_type, CAST(candidates AS INTEGER) AS branchpoint_candidates FROM best WHERE best_place = 1)"""
)
def q_ref_branchpoints(spark, sf_dir):
    made = references.branchpoint_reference(references.selected_introns(_gtf(spark, sf_dir)), _points(spark, sf_dir))
    return layout.ranked(made, references.GENOMIC)


@query(
    f"""{_G} SELECT gene_id, coalesce(gene_name, gene_id) AS gene_name, transcript_id, chrom, strand, s - 60 AS transcript_start, e + 150 AS transcript_end, CASE WHEN strand = '+' THEN e + 150 ELSE s - 60 END AS three_prime_end, CASE WHEN strand = '+' THEN e + 101 ELSE s - 60 END AS terminal_exon_start, CASE WHEN strand = '+' THEN e + 150 ELSE s - 1 END AS terminal_exon_end,
  e - s + 211 AS transcript_length, CAST(170 AS BIGINT) AS exonic_length, 3 AS exon_count, 2 AS intron_count, printf('%d-%d,%d-%d,%d-%d', s - 60, s - 1, e + 1, e + 60, e + 101, e + 150) AS exons, printf('%d-%d,%d-%d', s, e, e + 61, e + 100) AS introns FROM coding"""
)
def q_ref_genes(spark, sf_dir):
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    rows = references.genes(_gtf(spark, sf_dir))
    return rows.withColumns({"exons": said("exon_spans"), "introns": said("intron_spans")}).drop("exon_spans", "intron_spans")


_MERGE = """, flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY category, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM part),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY category, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM flagged)
SELECT category, chrom, min(s) AS "start", max(e) AS "end" FROM numbered GROUP BY category, chrom, run"""


@query(
    f"""{_G}, part AS (SELECT CASE gene_type WHEN 'lincRNA' THEN 'lncRNA' ELSE gene_type END AS category, chrom, s - 60 AS s, e + 150 AS e FROM made WHERE gene_type <> 'protein_coding' UNION ALL SELECT 'annotated', chrom, s - 60, e + 150 FROM made
  UNION ALL SELECT 'protein_coding_exon', chrom, s, e FROM exon WHERE gene_type = 'protein_coding' UNION ALL SELECT 'protein_coding_intron', chrom, s, e FROM made WHERE gene_type = 'protein_coding' UNION ALL SELECT 'protein_coding_intron', chrom, e + 61, e + 100 FROM made WHERE gene_type = 'protein_coding'){_MERGE}"""
)
def q_ref_categories(spark, sf_dir):
    return references.rna_categories(_gtf(spark, sf_dir))


@query(
    f"""{_G} SELECT gene_id || ':' || number AS intron_id, transcript_id, CAST(number AS INTEGER) AS intron_number, gene_id, coalesce(gene_name, '') AS gene_name, chrom, strand, a AS "start", b AS "end"
FROM (SELECT *, e + 1 AS a, lead(s) OVER w - 1 AS b, row_number() OVER w AS number FROM exon WHERE c % 2 = 0 WINDOW w AS (PARTITION BY gene_id ORDER BY s, e)) WHERE b IS NOT NULL"""
)
def q_ref_long_introns(spark, sf_dir):
    selected = supplied.introns(spark, sf_dir).where("CAST(substr(intron_id, 2) AS BIGINT) % 2 = 0").select("gene_id", "transcript_id")
    return references.long_read_introns(_gtf(spark, sf_dir), selected)


# Reads that didn't map

_UNMAPPED = "unread AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'R1' ELSE 'R2' END AS mate, event_id AS ordinal, event_type || '-' || props || '-' || user_id AS x FROM events)"
_QUANTILES = {"p10_length": 0.1, "p25_length": 0.25, "median_length": 0.5, "p75_length": 0.75, "p90_length": 0.9}


def _top(end: str, cut: str) -> str:
    return f"{end} AS (SELECT * FROM (SELECT mate, {cut} AS v, count(*) AS n, row_number() OVER (PARTITION BY mate ORDER BY count(*) DESC, min(ordinal)) AS i FROM unread GROUP BY 1, 2) WHERE i = 1)"


@query(
    f"""WITH {_UNMAPPED}, {_top('prefix', 'left(x, 12)')}, {_top('suffix', 'right(x, 12)')}, base AS (SELECT mate, count(*) AS total_reads, round(avg(length(x)), 2) AS mean_length, CAST(min(length(x)) AS BIGINT) AS min_length, CAST(max(length(x)) AS BIGINT) AS max_length, {', '.join(f'CAST(quantile_disc(length(x), {q}) AS BIGINT) AS {n}' for n, q in _QUANTILES.items())}, {', '.join(f'count(*) FILTER (length(x) <= {k}) AS reads_le_{k}' for k in (20, 30, 40))} FROM unread GROUP BY 1)
SELECT base.*, prefix.v AS top_prefix_12, prefix.n AS top_prefix_12_count, suffix.v AS top_suffix_12, suffix.n AS top_suffix_12_count FROM base JOIN prefix USING (mate) JOIN suffix USING (mate)"""
)
def q_unmapped_reads(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return unmapped.summary_of_mates(events.select(F.when(F.col("event_id") % 2 == 0, "R1").otherwise("R2").alias("mate"), F.col("event_id").alias("ordinal"), F.concat_ws("-", "event_type", "props", "user_id").alias("sequence")))


# A browser's view of a gene

_VIEW = f"""{with_('aln', 'walk', 'intron', 'samples')}, region AS (SELECT chrom AS rc, greatest(1, intron_start - 160) AS ra, intron_end + 160 AS rb FROM intron WHERE gene_name = 'N5' ORDER BY gene_id LIMIT 1),
near AS (SELECT aln.*, ra, rb FROM aln JOIN reach USING (rid) JOIN region ON rname = rc AND pos <= rb AND pos + reach.reach - 1 >= ra WHERE flag & 2 <> 0 AND flag & 3852 = 0 AND rnext = rname AND NOT contains(cigar, 'N') AND CASE WHEN nh IS NULL THEN mapq > 0 ELSE nh = 1 END)"""
#: Fragments by which a sample's depth is scaled.
_SCALE = {s: 1000.0 * (i + 1) for i, s in enumerate(SAMPLES)}


def _view(spark, sf_dir) -> browser.View:
    genes = _genes(spark, sf_dir)
    scale = F.create_map(*[F.lit(x) for pair in _SCALE.items() for x in pair])
    samples = supplied.samples(spark).withColumn("intronic_fragments", scale[F.col("sample")])
    return browser.View(supplied.alignments(spark, sf_dir), genes, supplied.introns(spark, sf_dir), samples, browser.gene_region(genes, "N5"), CONFIG)


@query(
    f"""{_VIEW}, depth AS (SELECT sample, x, count(*) AS n FROM (SELECT sample, unnest(range(greatest(bs, ra), least(be, rb) + 1)) AS x FROM near JOIN spans USING (rid)) GROUP BY 1, 2), scale(sample, f) AS (VALUES {', '.join(map(str, _SCALE.items()))})
SELECT condition, CAST(x AS INTEGER) AS position, round(avg(coalesce(n, 0) * 1e6 / f), 6) AS mean_coverage_per_million_intronic_reads FROM (SELECT samples.*, unnest(range(ra, rb + 1)) AS x FROM samples, region) JOIN scale USING (sample) LEFT JOIN depth USING (sample, x) GROUP BY 1, 2"""
)
def q_browser_coverage(spark, sf_dir):
    return _rounded(_view(spark, sf_dir).coverage())


@query(
    f"""{_VIEW}, here AS (SELECT i.*, intron_start - 60 AS ts, intron_end + 60 AS te, ra, rb, row_number() OVER (ORDER BY intron_start, intron_end, gene_name) AS y FROM intron i JOIN region ON chrom = rc AND intron_start - 60 <= rb AND intron_end + 60 >= ra),
box AS (SELECT 'intron' AS feature_type, gene_name, transcript_id, strand, ts AS a, te AS b, ra, rb, y, 0.04 AS h FROM here UNION ALL SELECT 'exon', gene_name, transcript_id, strand, intron_start - 60, intron_start - 1, ra, rb, y, 0.18 FROM here UNION ALL SELECT 'exon', gene_name, transcript_id, strand, intron_end + 1, intron_end + 60, ra, rb, y, 0.18 FROM here)
SELECT feature_type, gene_name, transcript_id, strand, NULL::DOUBLE AS x, greatest(a, ra) AS xmin, least(b, rb) AS xmax, NULL::DOUBLE AS y, round(CAST(y - h AS DOUBLE), 6) AS ymin, round(CAST(y + h AS DOUBLE), 6) AS ymax, NULL AS label FROM box WHERE greatest(a, ra) <= least(b, rb)
UNION ALL SELECT 'branchpoint', gene_name, transcript_id, strand, CAST(branchpoint_position AS DOUBLE), NULL, NULL, CAST(y AS DOUBLE), NULL, NULL, NULL FROM here WHERE branchpoint_position BETWEEN ra AND rb
UNION ALL SELECT 'gene_label', gene_name, transcript_id, strand, (greatest(ts, ra) + least(te, rb)) / 2, NULL, NULL, round(CAST(y + 0.35 AS DOUBLE), 6), NULL, NULL, gene_name || ' (' || strand || ')' FROM here"""
)
def q_browser_annotations(spark, sf_dir):
    return _rounded(_view(spark, sf_dir).annotations())


# Cigars, names, checks


@query(
    f"""{with_('aln', 'walk')}, md_walk AS (SELECT rid, i, op, n, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spot FROM ops),
said AS (SELECT rid, string_agg(bs || '-' || be, ',' ORDER BY bs) AS blocks FROM spans GROUP BY 1), gone AS (SELECT rid, string_agg(d, ',' ORDER BY d) AS deleted FROM (SELECT rid, unnest(range(spot + 1, spot + n + 1)) AS d FROM md_walk WHERE op = 'D') GROUP BY 1),
md AS (SELECT rid, CAST(sum(n) FILTER (op IN ('M', 'D')) AS BIGINT) AS md FROM ops GROUP BY 1)
SELECT qname, flag, aln.pos, cigar, aln.pos + reach - 1 AS last, aln.pos + coalesce(md, 0) AS span_md, spliced, coalesce(blocks, '') AS blocks, coalesce(deleted, '') AS deleted FROM aln JOIN reach USING (rid) JOIN md USING (rid) LEFT JOIN said USING (rid) LEFT JOIN gone USING (rid)"""
)
def q_cigar_facts(spark, sf_dir):
    rows = supplied.alignments(spark, sf_dir).select("qname", "flag", "pos", "cigar").withColumn("ops", cigar.operations(F.col("cigar")))
    p, c, ops = F.col("pos"), F.col("cigar"), F.col("ops")
    said = F.array_join(F.transform(cigar.blocks(p, c, ops), lambda b: F.concat(b["start"].cast("string"), F.lit("-"), b["end"].cast("string"))), ",")
    return rows.select("qname", "flag", "pos", "cigar", cigar.reference_end(p, c, ops).alias("last"), cigar.span_md(p, c, ops).alias("span_md"), cigar.is_spliced(c).alias("spliced"), said.alias("blocks"), F.array_join(cigar.deletions_shifted(p, c, ops), ",").alias("deleted"))


@query(
    f"""{with_('intron')}, r AS (SELECT intron_id, CAST(substr(intron_id, 2) AS BIGINT) AS c, substr(chrom, 4) AS bare, intron_start AS a, intron_end AS b FROM intron)
SELECT intron_id, CASE WHEN c % 9 <> 8 THEN 'chr' || bare END AS chrom, CASE WHEN c % 9 <> 8 THEN a END AS "start", CASE WHEN c % 9 <> 8 THEN b END AS "end", CASE WHEN c % 9 <> 8 THEN 'chr' || bare || ':' || a || '-' || b END AS label, 'chromosome ' || bare AS chromosome, 'N_' || c || '_x' AS file_name FROM r"""
)
def q_region_text(spark, sf_dir):
    """Regions with thousands marks, with and without the prefix of the chromosome, and some that end before they start."""
    rows = supplied.introns(spark, sf_dir).selectExpr("intron_id", "CAST(substr(intron_id, 2) AS BIGINT) AS c", "chrom", "intron_start AS a", "intron_end AS b")
    named = F.when(F.col("c") % 2 == 0, F.col("chrom")).otherwise(F.substring("chrom", 4, 20))
    ends = F.when(F.col("c") % 9 == 8, F.lit("1")).otherwise(F.format_number("b", 0))
    parsed = text.region(F.concat(named, F.lit(":"), F.format_number("a", 0), F.lit("-"), ends))
    return rows.withColumn("r", parsed).select("intron_id", "r.chrom", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.label").alias("label"), text.chromosome_label(F.col("chrom")).alias("chromosome"), text.file_safe(F.concat(F.lit("(N)."), F.col("c").cast("string"), F.lit(" /x.."))).alias("file_name"))


#: Types of genes as annotation spells them, and what they count as.
_SPELLED = {"protein_coding": "protein_coding", "snoRNA": "snoRNA", "vault-RNA": "vaultRNA", "lincRNA": "lncRNA", "sense intronic": "lncRNA", "processed_pseudogene": "pseudogene", "Mt_tRNA": None, "TEC": None, "misc RNA": "misc_RNA"}


@query(
    f"""{with_('intron')}, t(i, spelled, category) AS (VALUES {', '.join(f"({i}, '{k}', {f"'{v}'" if v else 'NULL'})" for i, (k, v) in enumerate(_SPELLED.items()))})
SELECT intron_id, replace(replace(lower(spelled), '-', '_'), ' ', '_') AS normalised, category FROM intron JOIN t ON i = CAST(substr(intron_id, 2) AS BIGINT) % {len(_SPELLED)}"""
)
def q_gene_types(spark, sf_dir):
    spelled = F.get(F.array(*[F.lit(x) for x in _SPELLED]), (F.expr("CAST(substr(intron_id, 2) AS BIGINT)") % len(_SPELLED)).cast("int"))
    normal = text.normalised_type(spelled)
    return supplied.introns(spark, sf_dir).select("intron_id", normal.alias("normalised"), text.gene_category(normal).alias("category"))


@query(f"""{with_('intron', 'samples')}, n AS (SELECT chrom, strand, count(*) AS introns, CAST(min(intron_start) AS BIGINT) AS first FROM intron GROUP BY 1, 2)
SELECT chrom, strand, introns, first, CASE WHEN strand = '+' AND chrom <> 'chr1' THEN introns ELSE 0 END AS known, (SELECT count(*) FROM samples) AS samples FROM n""")
def q_checked_inputs(spark, sf_dir):
    """Inputs that must have single names, whole spans and one value for all; a lookup with a default."""
    introns = sets.require_unique(supplied.introns(spark, sf_dir), ["intron_id"], "an intron stands twice")
    introns = sets.require(introns, F.col("intron_start") <= F.col("intron_end"), "an intron ends before it starts")
    per = introns.groupBy("chrom", "strand").agg(F.count(F.lit(1)).alias("introns"), F.min("intron_start").alias("first"))
    some = per.where("strand = '+' AND chrom <> 'chr1'").select("chrom", "strand", F.col("introns").alias("known"))
    n = supplied.samples(spark).agg(F.count(F.lit(1)).alias("samples"))
    one = sets.require_single(supplied.samples(spark).crossJoin(F.broadcast(n)), ["samples"], "samples differ in their number")
    return sets.with_default(per, some, ["chrom", "strand"], {"known": 0}).crossJoin(F.broadcast(one))


_T_TEST = """m AS (SELECT avg(l_tax) FILTER (l_returnflag = 'A') AS ma, avg(l_tax) FILTER (l_returnflag = 'R') AS mb, var_samp(l_tax) FILTER (l_returnflag = 'A') AS va, var_samp(l_tax) FILTER (l_returnflag = 'R') AS vb, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb FROM lineitem WHERE l_tax IS NOT NULL),
t AS (SELECT (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM m),
grid AS (SELECT t, df, abs(t) / 2000 AS h, unnest(range(0, 2001)) AS i FROM t),
area AS (SELECT any_value(t) AS t, any_value(df) AS df, sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - (df + 1) / 2 * ln(1 + (i * h) ** 2 / df)) * h / 3) AS a FROM grid)"""


@query(f"WITH {_T_TEST} SELECT round(t, 6) AS t, round(df, 4) AS df, round(1 - 2 * a, 5) AS p_value FROM area")
def q_welch_p(spark, sf_dir):
    """The p-value of one row is worked out where the row is."""
    row = stats.welch_test(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_tax"), "l_returnflag", "l_tax", "A", "R")
    return spark.createDataFrame([(row["t"], row["df"], row["p_value"])], "t double, df double, p_value double").select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("p_value", 5).alias("p_value"))


# Files, written and read again


@query(f"{with_('intron')} SELECT intron_id, chrom, strand, intron_start, branchpoint_score, 'i' || CAST(substr(intron_id, 2) AS BIGINT) % 3 AS sample, 'i' || CAST(substr(intron_id, 2) AS BIGINT) % 3 AS file_sample FROM intron")
def q_tsv_files(spark, sf_dir):
    """Three files of one folder; the sample of a row is that of its file's name."""
    folder = tables.scratch(spark)
    rows = supplied.introns(spark, sf_dir).selectExpr("intron_id", "chrom", "strand", "intron_start", "branchpoint_score", "concat('i', CAST(substr(intron_id, 2) AS BIGINT) % 3) AS sample")
    paths = []
    for name in ("i0", "i1", "i2"):
        tables.write_tsv_file(rows.where(F.col("sample") == name), f"{folder}/{name}.introns.tsv")
        paths.append(f"{folder}/{name}.introns.tsv")
    read = tables.read_tsv(spark, paths, "intron_id string, chrom string, strand string, intron_start long, branchpoint_score double, sample string", provenance=True)
    return tables.checked_samples(read).select("intron_id", "chrom", "strand", "intron_start", "branchpoint_score", "sample", "file_sample")


@query(f"""{_G}, line AS (SELECT c, 'gene' AS feature, s - 60 AS a, e + 150 AS b FROM made UNION ALL SELECT c, 'transcript', s - 60, e + 150 FROM made UNION ALL SELECT c, 'exon', s, e FROM exon)
SELECT made.chrom, feature, a AS "start", b AS "end", strand, gene_id, gene_name, gene_type, c % 4 <> 3 AS mane FROM line JOIN made USING (c)""")
def q_gtf_files(spark, sf_dir):
    folder = tables.scratch(spark)
    gtf = _gtf(spark, sf_dir)
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in gtf.columns])
    comment = spark.createDataFrame([("#made",), ("too\tfew",)], "value string")
    gtf.select(line.alias("value")).unionByName(comment).write.text(f"{folder}/gtf", compression="gzip")
    read = tables.attributes(tables.read_gtf(spark, f"{folder}/gtf"), "gene_id", "gene_name", "gene_type")
    return read.select("chrom", "feature", "start", "end", "strand", "gene_id", "gene_name", "gene_type", text.has_tag(F.col("attributes"), "MANE_Select").alias("mane"))


@query(f"{with_('aln')} SELECT sample, qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, nh FROM aln")
def q_sam_files(spark, sf_dir):
    """A file of SAM lines for each sample; a mate on the same chromosome is written as =."""
    folder = tables.scratch(spark)
    a = supplied.alignments(spark, sf_dir)
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    mate = F.when(F.col("rnext") == F.col("rname"), "=").otherwise(cell("rnext"))
    fields = [cell(c) for c in ("qname", "flag", "rname", "pos", "mapq", "cigar")] + [mate, cell("pnext"), cell("tlen"), F.lit("*"), F.lit("*"), F.when(F.col("nh").isNotNull(), F.concat(F.lit("NH:i:"), F.col("nh").cast("string")))]
    a.select("sample", F.concat_ws("\t", *fields).alias("value")).write.partitionBy("sample").text(f"{folder}/sam")
    parts = [tables.read_sam(spark, f"{folder}/sam/sample={s}", s) for s in SAMPLES]
    return reduce(DataFrame.unionAll, parts)


@query(f"{with_('intron')}, point AS ({' UNION ALL '.join(f'SELECT {_point_text(f)} FROM intron' for f in (_POINT, _SECOND))}) SELECT chrom, position, strand, score, intron_type, row_number() OVER (ORDER BY chrom DESC, position, score) - 1 AS place FROM point")
def q_branchpoint_files(spark, sf_dir):
    """Scores in file order: the files' names, then the lines. Here a file for each chromosome, the last first, and smaller files later."""
    folder = tables.scratch(spark)
    points = _points(spark, sf_dir)
    chroms = ["chr5", "chr4", "chr3", "chr2", "chr1"]
    for i, chrom in enumerate(chroms):
        rows = points.where(F.col("chrom") == chrom).select(F.col("chrom").alias("seqnames"), F.col("position").alias("start"), "strand", "score", "intron_type")
        tables.write_tsv_file(rows.orderBy("start", "score"), f"{folder}/{i}.tsv")
    read = tables.read_branchpoints(spark, f"{folder}/*.tsv")
    placed = F.row_number().over(Window.partitionBy("chrom").orderBy("ordinal")) - 1
    before = read.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return read.join(F.broadcast(before.select("chrom", "before")), "chrom").select("chrom", "position", "strand", "score", "intron_type", (placed + F.col("before")).cast("long").alias("place"))


@query(f"{with_('intron')} SELECT gene_id, min_by(transcript_id || '.' || k, k) AS transcript_id FROM (SELECT gene_id, transcript_id, unnest([3, 1, 2]) AS k FROM intron) GROUP BY 1")
def q_first_transcripts(spark, sf_dir):
    """Of three transcripts of each gene, in as many files, the first by file stays."""
    folder = tables.scratch(spark)
    rows = supplied.introns(spark, sf_dir).select("gene_id", "transcript_id")
    for k in (3, 1, 2):
        tables.write_tsv_file(rows.withColumn("transcript_id", F.concat("transcript_id", F.lit(f".{k}"))), f"{folder}/{k}.tsv")
    return tables.read_selected_transcripts(spark, f"{folder}/*.tsv")


@query(f"{with_('intron')} SELECT category, count(*) AS n FROM (SELECT CASE WHEN CAST(substr(intron_id, 2) AS BIGINT) % 19 = 0 THEN 'snoRNA' END AS category FROM intron) WHERE category IS NOT NULL GROUP BY 1")
def q_reference_tables(spark, sf_dir):
    """A reference that is written and read back with its version checked."""
    folder = tables.scratch(spark)
    tables.write_reference({"small": _small_rna(spark, sf_dir)}, folder)
    return tables.read_reference(spark, folder, "small", schemas.SMALL_NCRNA, ["snoRNA"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_READS = "reads AS (SELECT event_id, 'r' || event_id || ' x' AS name, upper(event_type) || user_id AS sequence, lower(event_type) || user_id AS quality FROM events)"


@query(f"WITH {_READS} SELECT name, sequence, quality, (SELECT count(*) FROM events) AS records FROM reads")
def q_fastq_files(spark, sf_dir):
    """Records of four lines, and their number, which needs no record's place."""
    folder = tables.scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    name, sequence, quality = F.concat(F.lit("@r"), F.col("event_id").cast("string"), F.lit(" x")), F.concat(F.upper("event_type"), F.col("user_id").cast("string")), F.concat(F.lower("event_type"), F.col("user_id").cast("string"))
    events.select(F.concat_ws("\n", name, sequence, F.lit("+"), quality).alias("value")).write.text(f"{folder}/fastq")
    binary.register(spark)
    read = spark.read.format("fastq").load(f"{folder}/fastq/part-*")
    return read.select("name", "sequence", "quality").withColumn("records", F.lit(binary.count_fastq(spark, f"{folder}/fastq")).cast("long"))


@query(f"WITH {_READS} SELECT name, sequence || quality AS sequence FROM reads")
def q_fasta_files(spark, sf_dir):
    """Sequences that are written over two lines."""
    folder = tables.scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    who = F.col("user_id").cast("string")
    lines = F.concat_ws("\n", F.concat(F.lit(">r"), F.col("event_id").cast("string"), F.lit(" x")), F.concat(F.upper("event_type"), who), F.concat(F.lower("event_type"), who))
    events.select(lines.alias("value")).write.text(f"{folder}/fasta")
    binary.register(spark)
    return spark.read.format("fasta").load(f"{folder}/fasta/part-*").select("name", "sequence")


@query(_round(f"{_PROFILE}, stat AS ({_replicates('profile', 'condition, offset_nt', _PROFILE_VALUES)}) SELECT condition, offset_nt, mean_coverage_anchored_percent, ci95_coverage_anchored_percent FROM stat", "mean_coverage_anchored_percent", "ci95_coverage_anchored_percent"))
def q_figure_table(spark, sf_dir):
    """The columns that a figure shows."""
    made = _aggregated(spark, sf_dir)
    return _rounded(exports.figure(made.by_condition(made.metaprofile_by_sample()), "branchpoint_coverage"))


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (plot, panel, "a.pdf" if plot == "ils_dis_pie" else "", f"{name}.tsv", said)) + ")" for plot, panel, name, said in exports.MANIFEST) + ") AS t(plot_id, panel_or_view, plot_files, table_file, description)")
def q_manifest(spark, sf_dir):
    return exports.manifest(spark, {"ils_dis_pie": "a.pdf"}, {})

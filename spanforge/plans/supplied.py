"""Alignments, introns and genes made of the supplied tables, for the analyses to run on.

Every row of `customer` is an intron between two exons of a gene of its own; every line item is a pair of reads about the intron of the order's customer. What makes the rows are plain expressions that Spark and other SQL engines read alike, so `SQL` gives the same input tables there; what analyses do with them is told apart in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Conditions by their order, three samples each.
CONDITIONS = ("DIS", "ILS")
SAMPLES = [(f"{c}_{i}", c, n) for n, c in enumerate(CONDITIONS) for i in (1, 2, 3)]

_START = "1001 + 20 * (c - c % 10) + (c * 7) % 50"
_LENGTH = "60 + (c * 37) % 190"

#: Of a customer c.
_INTRON = {
    "intron_id": "'I' || CAST(c AS VARCHAR(20))",
    "transcript_id": "'T' || CAST(c AS VARCHAR(20))",
    "intron_number": "CAST(1 + c % 4 AS INTEGER)",
    "gene_id": "'G' || CAST(c AS VARCHAR(20))",
    "gene_name": "'N' || CAST(c % 700 AS VARCHAR(20))",
    "chrom": "'chr' || CAST(1 + c % 5 AS VARCHAR(20))",
    "strand": "CASE WHEN c % 2 = 0 THEN '+' ELSE '-' END",
    "intron_start": f"CAST({_START} AS BIGINT)",
    "intron_end": f"CAST({_START} + {_LENGTH} - 1 AS BIGINT)",
    "intron_length": f"CAST({_LENGTH} AS BIGINT)",
    "three_prime_ss": f"CAST(CASE WHEN c % 2 = 0 THEN {_START} + {_LENGTH} - 1 ELSE {_START} END AS BIGINT)",
    "branchpoint_position": f"CAST(CASE WHEN c % 2 = 0 THEN {_START} + {_LENGTH} - 19 - c % 17 ELSE {_START} + 18 + c % 17 END AS BIGINT)",
    "branchpoint_score": "CAST(c % 64 AS DOUBLE) / 64",
    "branchpoint_to_3ss_nt": "CAST(18 + c % 17 AS BIGINT)",
    "branchpoint_type": "CASE WHEN c % 7 = 0 THEN 'U12' ELSE 'U2' END",
    "branchpoint_candidates": "CAST(1 + c % 3 AS INTEGER)",
}

#: Of a line item p, u, l, n of order o of customer c: where its intron lies, and how the first read aligns.
_PLACED = {
    "sample": "CASE WHEN o % 2 = 0 THEN 'DIS_' ELSE 'ILS_' END || CAST(1 + o % 3 AS VARCHAR(20))",
    "qname": "'q' || CAST(o AS VARCHAR(20)) || '.' || CAST(p AS VARCHAR(20)) || '.' || CAST(u AS VARCHAR(20)) || '.' || CAST(l AS VARCHAR(20))",
    "rname": "CASE WHEN u % 43 = 0 THEN 'chrM' ELSE 'chr' || CAST(1 + c % 5 AS VARCHAR(20)) END",
    "s": _START,
    "e": f"{_START} + {_LENGTH} - 1",
    "ss": f"CASE WHEN c % 2 = 0 THEN {_START} + {_LENGTH} - 1 ELSE {_START} END",
    "k": f"p % (20 + {_LENGTH}) - 10",
    "d": "u % 24 - 12",
    "plus": "(c % 2 = 0) <> (p % 23 = 0)",
    "cigar": "CASE l WHEN 1 THEN CAST(n AS VARCHAR(20)) || 'M' WHEN 2 THEN '5S' || CAST(n AS VARCHAR(20)) || 'M' WHEN 3 THEN CAST(n AS VARCHAR(20)) || 'M2D3M' WHEN 4 THEN CAST(n AS VARCHAR(20)) || 'M1I4M1D1M2D2M' WHEN 5 THEN CAST(n AS VARCHAR(20)) || '=1X2M' WHEN 6 THEN CAST(n AS VARCHAR(20)) || 'M80N6M' ELSE '3H' || CAST(n AS VARCHAR(20)) || 'M1P1D2M2S' END",
    "reach": "n + CASE l WHEN 3 THEN 5 WHEN 4 THEN 10 WHEN 5 THEN 3 WHEN 6 THEN 86 WHEN 7 THEN 3 ELSE 0 END",
    "nh": "CAST(CASE WHEN p % 5 = 0 THEN NULL WHEN u % 9 = 0 THEN 3 ELSE 1 END AS INTEGER)",
    "mapq": "CAST(CASE WHEN p % 15 = 0 THEN 0 ELSE n - 1 END AS INTEGER)",
    "mate": "CASE WHEN u % 37 = 0 THEN 'chrX' WHEN u % 43 = 0 THEN 'chrM' ELSE 'chr' || CAST(1 + c % 5 AS VARCHAR(20)) END",
    "bits": "1 + CASE WHEN tax > 0.075 THEN 0 ELSE 2 END + CASE WHEN discount > 0.095 AND p % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN discount > 0.095 AND p % 3 = 1 THEN 8 ELSE 0 END",
}
_ENDS = {
    "five": "CASE WHEN plus THEN s + k ELSE e - k END",
    "three": "CASE WHEN plus THEN ss + d ELSE ss - d END",
}

_READ = ("sample", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "nh")
#: Records of a pair: which lines have them, and their fields.
_RECORDS = (
    ("p % 29 <> 28", "CAST(bits + 64 + CASE WHEN plus THEN 0 ELSE 16 END AS INTEGER)", "CAST(CASE WHEN plus THEN five ELSE five - reach + 1 END AS BIGINT)", "cigar", "CAST(CASE WHEN u % 41 = 0 THEN 0 WHEN plus THEN three - 9 ELSE three END AS BIGINT)", "CAST(CASE WHEN u % 41 = 0 THEN 0 WHEN plus THEN three - five + 1 ELSE three - five - 1 END AS BIGINT)"),
    ("p % 13 <> 12", "CAST(bits + 128 + CASE WHEN plus THEN 16 ELSE 0 END AS INTEGER)", "CAST(CASE WHEN plus THEN three - 9 ELSE three END AS BIGINT)", "CASE WHEN p % 31 = 0 THEN '4M50N6M' ELSE '10M' END", "CAST(CASE WHEN plus THEN five ELSE five - reach + 1 END AS BIGINT)", "CAST(CASE WHEN plus THEN five - three - 1 ELSE five - three + 1 END AS BIGINT)"),
    ("p % 11 = 10", "CAST(bits + 64 + 256 AS INTEGER)", "CAST(five + 700 AS BIGINT)", "'20M'", "CAST(three AS BIGINT)", "CAST(0 AS BIGINT)"),
    ("p % 53 = 52", "CAST(bits + 64 AS INTEGER)", "CAST(five + 3 AS BIGINT)", "'15M'", "CAST(three AS BIGINT)", "CAST(30 AS BIGINT)"),
)


def _fields(record: tuple[str, ...]) -> dict[str, str]:
    _, flag, pos, cigar, pnext, tlen = record
    return {"sample": "sample", "qname": "qname", "flag": flag, "rname": "rname", "pos": pos, "mapq": "mapq", "cigar": cigar, "rnext": "mate", "pnext": pnext, "tlen": tlen, "nh": "nh"}


def _list(fields: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in fields.items())


def _unnamed(fields: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in fields.items()]


_LINE = {"o": "l_orderkey", "p": "l_partkey", "u": "l_suppkey", "l": "l_linenumber", "n": "CAST(l_quantity AS BIGINT)", "tax": "l_tax", "discount": "l_discount"}


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Flags are made before the join, which then shuffles two columns less.
    placing = {n: e for n, e in _PLACED.items() if n != "bits"}
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_unnamed(_LINE)).selectExpr("o", "p", "u", "l", "n", f"{_PLACED['bits']} AS bits")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS o", "o_custkey AS c")
    placed = lines.join(orders, "o").selectExpr("p", "u", "bits", *_unnamed(placing)).selectExpr("*", *_unnamed(_ENDS))
    # One pass makes all records of a line, so that the join isn't run for each.
    record = lambda r: f"CASE WHEN {r[0]} THEN named_struct({', '.join(f"'{n}', {e}" for n, e in _fields(r).items())}) END"
    made = placed.selectExpr(f"explode(array({', '.join(map(record, _RECORDS))})) AS r").where("r IS NOT NULL")
    return made.select(*[F.col(f"r.{n}").alias(n) for n in _READ])


def introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a branchpoint reference."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS c").selectExpr(*_unnamed(_INTRON))


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLES, "sample string, condition string, condition_ordinal int")


#: The same in SQL, as parts of a WITH clause: aln, with rid, a number for each row, intron and samples.
SQL = {
    "aln": f"""lines AS (SELECT {_list(_LINE)}, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
placed AS (SELECT p, u, {_list(_PLACED)} FROM lines), ended AS (SELECT *, {_list(_ENDS)} FROM placed),
records AS ({" UNION ALL ".join(f"SELECT {_list(_fields(r))} FROM ended WHERE {r[0]}" for r in _RECORDS)}),
aln AS (SELECT *, row_number() OVER () AS rid FROM records)""",
    "intron": f"intron AS (SELECT {_list(_INTRON)} FROM (SELECT c_custkey AS c FROM customer))",
    "samples": f"samples(sample, condition, condition_ordinal) AS (VALUES {', '.join(map(str, SAMPLES))})",
}

#: What a CIGAR says, by unnesting it: walk has each operation with the place where it begins, reach the length on the reference.
SQL["walk"] = """tokens AS (SELECT rid, pos, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS t, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS i FROM aln),
ops AS (SELECT rid, pos, i, CAST(left(t, -1) AS BIGINT) AS n, right(t, 1) AS op FROM tokens),
walk AS (SELECT rid, i, n, op, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spot FROM ops),
reach AS (SELECT rid, CAST(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) AS BIGINT) AS reach, bool_or(op = 'N' AND n > 0) AS spliced FROM ops GROUP BY rid),
spans AS (SELECT rid, spot AS bs, spot + n - 1 AS be FROM walk WHERE op IN ('M', '=', 'X') AND n > 0)"""

#: Pairs with the only primary record of each mate, and why a fragment is left out.
SQL["frag"] = """grouped AS (SELECT sample, qname, count(*) FILTER (flag & 64 <> 0) AS read1_records, count(*) FILTER (flag & 64 <> 0 AND flag & 2304 <> 0) AS read1_not_primary,
  CASE WHEN count(*) FILTER (flag & 64 <> 0 AND flag & 2304 = 0) = 1 THEN max(rid) FILTER (flag & 64 <> 0 AND flag & 2304 = 0) END AS rid1,
  CASE WHEN count(*) FILTER (flag & 64 = 0 AND flag & 2304 = 0) = 1 THEN max(rid) FILTER (flag & 64 = 0 AND flag & 2304 = 0) END AS rid2 FROM aln GROUP BY sample, qname),
ends AS (SELECT g.sample, g.qname, read1_records, read1_not_primary, rid1, rid2, a.flag, a.rname AS chrom, a.rnext, a.nh, a.mapq, CASE WHEN a.flag & 16 <> 0 THEN '-' ELSE '+' END AS strand,
  CASE WHEN a.flag & 16 <> 0 THEN a.pos + r1.reach - 1 ELSE a.pos END AS five_prime,
  CASE WHEN a.flag & 16 <> 0 THEN CASE WHEN a.pnext > 0 THEN a.pnext END ELSE CASE WHEN a.tlen <> 0 THEN a.pos - 1 + abs(a.tlen) END END AS three_prime,
  coalesce(r1.spliced, FALSE) OR coalesce(r2.spliced, FALSE) AS spliced
  FROM grouped g LEFT JOIN aln a ON a.rid = rid1 LEFT JOIN reach r1 ON r1.rid = rid1 LEFT JOIN reach r2 ON r2.rid = rid2),
reasoned AS (SELECT *, CASE WHEN rid1 IS NULL THEN 'no_single_read1' WHEN flag & 12 <> 0 THEN 'unmapped_or_mate_unmapped' WHEN flag & 2 = 0 OR chrom IS DISTINCT FROM rnext THEN 'improper_pair'
  WHEN NOT CASE WHEN nh IS NULL THEN mapq > 0 ELSE nh = 1 END THEN 'nonunique' WHEN three_prime IS NULL THEN 'missing_fragment_end' WHEN rid2 IS NULL THEN 'missing_mate_alignment' WHEN spliced THEN 'spliced_fragments' END AS reason FROM ends),
frag AS (SELECT *, reason IS NULL OR reason IN ('missing_mate_alignment', 'spliced_fragments') AS in_library FROM reasoned),
cont AS (SELECT sample, qname, chrom, strand, five_prime, three_prime FROM frag WHERE reason IS NULL),
audit AS (SELECT sample, CAST(sum(read1_records) AS BIGINT) AS read1_records_examined, count(*) FILTER (in_library) AS library_fragments, CAST(sum(read1_not_primary) AS BIGINT) AS filtered_secondary_or_supplementary,
  count(*) FILTER (reason = 'unmapped_or_mate_unmapped') AS filtered_unmapped_or_mate_unmapped, count(*) FILTER (reason = 'improper_pair') AS filtered_improper_pair, count(*) FILTER (reason = 'nonunique') AS filtered_nonunique,
  count(*) FILTER (reason = 'missing_fragment_end') AS filtered_missing_fragment_end, count(*) FILTER (reason = 'missing_mate_alignment') AS filtered_missing_mate_alignment, count(*) FILTER (reason = 'spliced_fragments') AS filtered_spliced_fragments FROM frag GROUP BY sample)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(SQL[p] for p in parts)


#: Offset along the strand of a position from a place.
def along(position: str, place: str) -> str:
    return f"CASE WHEN strand = '+' THEN {position} - {place} ELSE {place} - {position} END"

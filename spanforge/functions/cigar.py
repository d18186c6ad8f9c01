"""What a CIGAR string says about the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def operations(cigar: Column) -> Column:
    """array<struct<n:long, op:string>>. Where several facts of a CIGAR are wanted, make this a column first and hand it to each as ops: it is then parsed once."""
    tokens = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(tokens, lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).cast("long").alias("n"), F.right(t, F.lit(1)).alias("op")))


def _sum(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda total, x: total + F.when(x["op"].isin(*kinds), x["n"]).otherwise(0))


def reference_length(cigar: Column, ops: Column | None = None) -> Column:
    """Bases of the reference from the first to the last aligned one."""
    return _sum(operations(cigar) if ops is None else ops, "MDN=X")


def reference_end(pos: Column, cigar: Column, ops: Column | None = None) -> Column:
    return pos + reference_length(cigar, ops) - 1


def span_md(pos: Column, cigar: Column, ops: Column | None = None) -> Column:
    """Position one past the last base, counting M and D only, and used as if it were the last base. Long-read coverage is defined with it."""
    return pos + _sum(operations(cigar) if ops is None else ops, "MD")


def is_spliced(cigar: Column) -> Column:
    return F.coalesce(cigar.rlike("(^|[A-Z=])0*[1-9][0-9]*N"), F.lit(False))


#: Operations that are walked at once. An array that grows by one is copied, so a long CIGAR is walked in pieces, and its cost stays in proportion to its length.
PIECE = 64


def _walk(pos: Column, ops: Column, keep: str, advance: str) -> Column:
    """Spans of the operations in keep, when those in advance move along the reference."""
    nothing = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")

    def step(state: Column, x: Column) -> Column:
        here = F.struct(state["at"].alias("start"), (state["at"] + x["n"] - 1).alias("end"))
        return F.struct(
            F.when(x["op"].isin(*advance), state["at"] + x["n"]).otherwise(state["at"]).alias("at"),
            F.when(x["op"].isin(*keep) & (x["n"] > 0), F.concat(state["spans"], F.array(here))).otherwise(state["spans"]).alias("spans"),
        )

    def walked(at: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(at.cast("long").alias("at"), nothing.alias("spans")), step, lambda s: s["spans"])

    def begun(state: Column, piece: Column) -> Column:
        """Where pieces begin."""
        moved = F.aggregate(piece, F.lit(0).cast("long"), lambda t, x: t + F.when(x["op"].isin(*advance), x["n"]).otherwise(0))
        return F.struct((state["at"] + moved).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(ops) - 1) / F.lit(PIECE)).cast("int")), lambda i: F.slice(ops, i * PIECE + 1, PIECE))
    first = F.struct(pos.cast("long").alias("at"), F.expr("CAST(array() AS array<bigint>)").alias("starts"))
    starts = F.aggregate(pieces, first, begun, lambda s: s["starts"])
    long = F.flatten(F.zip_with(pieces, starts, lambda piece, at: walked(at, piece)))
    return F.when(F.size(ops) <= PIECE, walked(pos, ops)).otherwise(long)


def blocks(pos: Column, cigar: Column, ops: Column | None = None) -> Column:
    """Aligned spans, one for each M, = or X; D and N move on, the others don't."""
    return _walk(pos, operations(cigar) if ops is None else ops, "M=X", "MDN=X")


def deletions_shifted(pos: Column, cigar: Column, ops: Column | None = None) -> Column:
    """Deleted positions, each one further than it is, with only M and D moving on. Long-read deletion profiles are defined with it."""
    spans = _walk(pos, operations(cigar) if ops is None else ops, "D", "MD")
    return F.flatten(F.transform(spans, lambda s: F.sequence(s["start"] + 1, s["end"] + 1)))

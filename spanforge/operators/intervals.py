"""Joins and algebra of closed intervals.

Range joins get an equi key from bins: the coordinate axis is cut into bins of a fixed size, an interval stands in each bin that it touches, and rows meet only in equal bins. That makes them plain shuffles on (keys, bin), which spreads a single large chromosome, lets Spark split skewed partitions, and never compares all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About the median length of the intervals that are joined is a good size.
BIN = 1000
#: Bins that an interval is copied to at most; wider intervals are joined by bins this many times as wide.
MOST_BINS = 4096


def bin_of(position: Column, size: int) -> Column:
    """Positions 1..size are bin 0, exactly for any long. Positions below 1 are rounded towards it, which is as good for a join."""
    return F.call_function("div", position - F.lit(1), F.lit(size))


def bins_of(start: Column, end: Column, size: int) -> Column:
    """Bins that an interval touches; none for an empty or null one."""
    return F.when(start <= end, F.sequence(bin_of(start, size), bin_of(end, size)))


def _named(df: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """Keys under names that can't clash."""
    return df.select("*", *[F.col(k).alias(f"__{mark}{i}") for i, k in enumerate(keys)])


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.col("__lb") == F.col("__rb")
    for i in range(len(keys)):
        on = on & (F.col(f"__l{i}") == F.col(f"__r{i}"))
    return on


def _check(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """right without its key columns, which the left's stand for."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    return right


def _by_width(intervals: DataFrame, start: str, end: str, size: int, join: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """join(intervals, size of bins), with those that touch very many bins joined by themselves, by wider ones. Whether there are such is looked up first; there rarely are."""
    reach = F.col(end) - F.col(start)
    widest = size * MOST_BINS
    if intervals.where(reach >= widest).isEmpty():
        return join(intervals, size)
    return join(intervals.where(reach < widest), size).unionAll(_by_width(intervals.where(reach >= widest), start, end, widest, join))


def point_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], position: str, start: str, end: str, size: int = BIN, extra: Column | None = None) -> DataFrame:
    """Each point with each interval that holds it (closed), under equal keys: many to many, each pair once.

    Points stand in one bin and aren't copied; intervals are. extra is a further condition on a pair. Null positions, ends and keys match nothing.
    """
    _check(points, intervals, keys)

    def join(some: DataFrame, size: int) -> DataFrame:
        left = _named(points, keys, "l").withColumn("__lb", bin_of(F.col(position), size))
        right = _named(some, keys, "r").withColumn("__rb", F.explode(bins_of(F.col(start), F.col(end), size))).drop(*keys)
        found = left.join(right, _on(left, right, keys)).where((F.col(position) >= F.col(start)) & (F.col(position) <= F.col(end)))
        return _bare(found if extra is None else found.where(extra), keys)

    return _by_width(intervals, start, end, size, join)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str], size: int = BIN) -> DataFrame:
    """Pairs of intervals that share a base, each once: a pair is taken in the bin where the later of the two starts. Intervals on the left are copied to each of their bins, however wide they are."""
    _check(left, right, keys)
    (a, b), (c, d) = left_range, right_range

    def join(some: DataFrame, size: int) -> DataFrame:
        x = _named(left, keys, "l").withColumn("__lb", F.explode(bins_of(F.col(a), F.col(b), size)))
        y = _named(some, keys, "r").withColumn("__rb", F.explode(bins_of(F.col(c), F.col(d), size))).drop(*keys)
        first_shared = bin_of(F.greatest(F.col(a), F.col(c)), size)
        return _bare(x.join(y, _on(x, y, keys)).where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("__lb") == first_shared)), keys)

    return _by_width(right, c, d, size, join)


def containment_join(inner: DataFrame, outer: DataFrame, keys: Sequence[str], inner_range: tuple[str, str], outer_range: tuple[str, str], size: int = BIN, stretch: int = 0) -> DataFrame:
    """Each inner interval with each outer one that holds it whole. Outer ones are first made longer by stretch, half of it, rounded down, before the start. An inner interval stands in the bin of its start only."""
    _check(inner, outer, keys)
    (a, b), (c, d) = inner_range, outer_range
    low, high = F.col(c) - F.lit(stretch // 2), F.col(d) + F.lit(stretch - stretch // 2)

    def join(some: DataFrame, size: int) -> DataFrame:
        x = _named(inner, keys, "l").withColumn("__lb", bin_of(F.col(a), size))
        y = _named(some, keys, "r").withColumn("__rb", F.explode(bins_of(low, high, size))).drop(*keys)
        return _bare(x.join(y, _on(x, y, keys)).where((low <= F.col(a)) & (high >= F.col(b))), keys)

    return _by_width(outer, c, d, size, join)


def band_join(points: DataFrame, features: DataFrame, keys: Sequence[str], position: str, anchor: str, strand: str, upstream: int, downstream: int) -> DataFrame:
    """Points within [-upstream, +downstream] of an anchor, along the strand. The band is narrow, so each of its positions becomes a row, and the join is on equal positions."""
    _check(points, features, [*keys])
    steps = F.explode(F.sequence(F.lit(-upstream), F.lit(downstream)))
    spread = features.withColumn("__step", steps).withColumn("__rb", F.when(F.col(strand) == "+", F.col(anchor) + F.col("__step")).otherwise(F.col(anchor) - F.col("__step"))).drop("__step")
    left = _named(points, keys, "l").withColumn("__lb", F.col(position))
    right = _named(spread, keys, "r").drop(*keys)
    return _bare(left.join(right, _on(left, right, keys)), keys)


def _bare(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.drop("__lb", "__rb", *[f"__{m}{i}" for m in "lr" for i in range(len(keys))])


def hit_audit(left: DataFrame, hits: DataFrame, id_columns: Sequence[str], carry: Sequence[Column] = ()) -> DataFrame:
    """left with n_hits and outcome (none, unique or ambiguous). carry: aggregates over a row's hits, which only the unique ones' values should be read of.

    The hits are counted first, so the join that keeps rows without a hit is one to one.
    """
    counted = hits.groupBy(*id_columns).agg(F.count(F.lit(1)).alias("n_hits"), *carry)
    both = left.join(counted, list(id_columns), "left")
    n = F.coalesce(F.col("n_hits"), F.lit(0))
    return both.withColumn("n_hits", n.cast("long")).withColumn("outcome", F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous"))


def _reached(df: DataFrame, keys: Sequence[str], start: str, end: str, size: int | None) -> DataFrame:
    """df with __reached, the furthest end of the rows before, in order of start and end; null for the first.

    With a size the rows of a key are dealt by bins of their starts: what the bins before reach is worked out from one row for each bin, so that no task sorts a whole key.
    """
    if size is None:
        order = Window.partitionBy(*keys).orderBy(start, end)
        return df.withColumn("__reached", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    binned = df.withColumn("__bin", bin_of(F.col(start), size))
    inside = Window.partitionBy(*keys, "__bin").orderBy(start, end)
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(binned.groupBy(*keys, "__bin").agg(F.max(end).alias("__end")).withColumn("__carried", F.max("__end").over(before)).drop("__end"), keys)
    local = binned.withColumn("__local", F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    both = local.join(carried, _same_bin(keys))
    return both.withColumn("__reached", F.greatest("__local", "__carried")).drop("__local", "__carried", "__cbin", *[f"__c{i}" for i in range(len(keys))])


def _carried(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and bin under names that can't clash."""
    return df.withColumnsRenamed({k: f"__c{i}" for i, k in enumerate(keys)} | {"__bin": "__cbin"})


def _same_bin(keys: Sequence[str]) -> Column:
    on = F.col("__bin").eqNullSafe(F.col("__cbin"))
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__c{i}"))
    return on


def merge_spans(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", gap: int = 1, size: int | None = None) -> DataFrame:
    """(keys, start, end): unions of intervals of which each starts at most `gap` after the furthest end before it. gap 1 joins abutting closed intervals; gap 0 does for half-open ones.

    size: for keys with very many intervals, such as chromosomes, which are then sorted by bins of that size and not whole.
    """
    placed = _reached(df.select(*keys, F.col(start), F.col(end)), keys, start, end, size)
    fresh = placed.withColumn("__fresh", F.when(F.col(start) <= F.col("__reached") + F.lit(gap), 0).otherwise(1))
    if size is None:
        order = Window.partitionBy(*keys).orderBy(start, end)
        numbered = fresh.withColumn("__run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        # of equal intervals the one that begins a run comes first
        inside = Window.partitionBy(*keys, "__bin").orderBy(start, end, F.desc("__fresh"))
        before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        carried = _carried(fresh.groupBy(*keys, "__bin").agg(F.sum("__fresh").alias("__n")).withColumn("__runs", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), keys)
        local = fresh.withColumn("__in", F.sum("__fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        numbered = local.join(carried, _same_bin(keys)).withColumn("__run", F.col("__in") + F.col("__runs"))
    return numbered.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def gaps(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", keep_empty: bool = False) -> DataFrame:
    """(keys, number, start, end): what lies between consecutive intervals, in order of start; number counts all neighbours from 1. Empty gaps are left out unless asked for."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    following = df.select(*keys, F.col(end).alias("__end"), F.lead(start).over(order).alias("__next"), F.row_number().over(order).alias("number"))
    found = following.where(F.col("__next").isNotNull()).select(*keys, "number", (F.col("__end") + 1).alias(start), (F.col("__next") - 1).alias(end))
    return found if keep_empty else found.where(F.col(start) <= F.col(end))


def subtract(wholes: DataFrame, parts: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", size: int | None = None) -> DataFrame:
    """(keys, start, end): each whole without the parts of the same keys. Parts may overlap and reach out; a whole without a part stays as it is. Closed intervals; one whole for each key. size: as in merge_spans()."""
    inside = parts.select(*keys, F.col(start).alias("__ps"), F.col(end).alias("__pe"))
    whole = wholes.select(*keys, F.col(start).alias("__ws"), F.col(end).alias("__we"))
    cut = whole.join(inside, list(keys), "left").where(F.col("__ps").isNull() | ((F.col("__pe") >= F.col("__ws")) & (F.col("__ps") <= F.col("__we"))))
    # Wholes whose parts all lie outside are lost above, and come back here untouched.
    touched = cut.select(*keys).distinct()
    untouched = whole.join(touched, list(keys), "left_anti").select(*keys, F.col("__ws").alias(start), F.col("__we").alias(end))
    placed = _reached(cut, keys, "__ps", "__pe", size)
    heads = placed.withColumn("__from", F.greatest(F.coalesce(F.col("__reached") + 1, F.col("__ws")), F.col("__ws"))).select(*keys, F.col("__from").alias(start), F.coalesce(F.col("__ps") - 1, F.col("__we")).alias(end))
    tails = cut.where(F.col("__ps").isNotNull()).groupBy(*keys).agg(F.max("__pe").alias("__last"), F.max("__we").alias("__we")).select(*keys, (F.col("__last") + 1).alias(start), F.col("__we").alias(end))
    return heads.unionByName(tails).where(F.col(start) <= F.col(end)).unionByName(untouched)


def running(df: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], size: int) -> DataFrame:
    """(keys, at, values): sums of the values up to each position of the keys, itself included. Positions are dealt by bins of that size, as in merge_spans(), after rows of a position are added up."""
    binned = df.groupBy(*keys, at).agg(*[F.sum(v).alias(v) for v in values]).withColumn("__bin", bin_of(F.col(at), size))
    inside = Window.partitionBy(*keys, "__bin").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*keys, "__bin").agg(*[F.sum(v).alias(f"__t{i}") for i, v in enumerate(values)])
    carried = _carried(totals.select(*keys, "__bin", *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(values))]), keys)
    local = binned.select(*keys, at, "__bin", *[F.sum(v).over(inside).alias(v) for v in values])
    return local.join(carried, _same_bin(keys)).select(*keys, at, *[(F.col(v) + F.col(f"__b{i}")).alias(v) for i, v in enumerate(values)])


def sums_between(events: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, values: Sequence[str], size: int) -> DataFrame:
    """ranges, different ones, with structs `before` and `until` of the values' sums over the events before the start and up to the end. Costs rows in proportion to the events and ranges, however many of them meet. Ranges with a null or an end before the start go."""
    some = ranges.where(F.col(start) <= F.col(end))
    # Ends of ranges are events of nothing, so that there are sums at each.
    ends = some.select(*keys, F.explode(F.array(F.col(start) - 1, F.col(end))).alias(at), *[F.lit(0).cast("long").alias(v) for v in values])
    sums = running(events.select(*keys, at, *values).unionByName(ends), keys, at, values, size)
    found = sums.select(*keys, F.col(at).alias("__at"), F.struct(*values).alias("__sums"))
    until = some.withColumn("__at", F.col(end)).join(found, [*keys, "__at"]).withColumnRenamed("__sums", "until")
    before = until.withColumn("__at", F.col(start) - 1).join(found, [*keys, "__at"]).withColumnRenamed("__sums", "before")
    return before.drop("__at")


def clip_to(df: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Intervals cut to a window; those outside go."""
    return df.withColumn(start, F.greatest(F.col(start), low)).withColumn(end, F.least(F.col(end), high)).where(F.col(start) <= F.col(end))


def runs(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """df with run_weight, 1 / the length of the run of consecutive positions that a row is in. A repeated position ends a run, as a jump does."""
    order = Window.partitionBy(*keys).orderBy(position)
    step = F.col(position) - F.lag(position).over(order)
    numbered = df.withColumn("__new", F.when(step == 1, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__run"))
    return numbered.withColumn("run_weight", F.lit(1.0) / size).drop("__new", "__run")

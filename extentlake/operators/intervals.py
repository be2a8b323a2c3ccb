"""Joins and sweeps over half-open intervals [start, start + size) within the groups of a storage space.

The containing-interval join is an equi-join on pages: an interval is repeated for each page that it touches, and a probe looks at
its own page alone, so one huge cluster spreads over as many tasks as it has pages, and adaptive execution can split a hot page.
Intervals of a group are disjoint, so a probe has at most one match: what contains it, or none; never the nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import before

SPACE = ("segment", "cluster")
PAGE = 1 << 16
#: Addresses that one task sweeps.
SWEEP = 1 << 24


def paged(intervals: DataFrame, start: str, size: str, page: int = PAGE) -> DataFrame:
    """The intervals once for each page that they touch, in column _page; empty ones vanish."""
    first, last = F.expr(f"{start} div {page}"), F.expr(f"({start} + {size} - 1) div {page}")
    return intervals.where(F.col(size) > 0).withColumn("_page", F.explode(F.sequence(first, last)))


def containing(probes: DataFrame, intervals: DataFrame, at: str, start: str, size: str, need: Column | int = 1, space: dict[str, str] | None = None, page: int = PAGE) -> DataFrame:
    """Left join of probes with the interval that holds `need` bytes from `at` on; columns of both, NULL without a match.

    space: the probes' names of the intervals' group columns.  A NULL address matches nothing, and such rows are spread over all tasks.
    """
    space = space or {s: s for s in SPACE}
    right = paged(intervals, start, size, page)
    right = right.select(*(F.col(c).alias(f"_g_{i}") for i, c in enumerate(space.values())), *(c for c in intervals.columns if c not in space.values()), "_page")
    need = F.lit(need) if isinstance(need, int) else need
    nowhere = -1 - F.pmod(F.xxhash64(*probes.columns), F.lit(1 << 12))
    left = probes.withColumn("_probe", F.coalesce(F.expr(f"{at} div {page}"), nowhere))
    fits = (F.col(start) <= F.col(at)) & (F.col(at) + need <= F.col(start) + F.col(size))
    keys = [F.col(c) == F.col(f"_g_{i}") for i, c in enumerate(space)]
    on = (F.col("_probe") == F.col("_page")) & fits
    for k in keys:
        on &= k
    return left.join(right, on, "left").drop("_probe", "_page", *(f"_g_{i}" for i in range(len(space))))


def overlapping(left: DataFrame, right: DataFrame, how: str, l_start: str, l_size: str, r_start: str, r_size: str, space: tuple[str, ...] = SPACE, page: int = PAGE) -> DataFrame:
    """Pairs of intervals that share a byte (inner), or the left ones with (left_semi) or without (left_anti) such a partner.

    A pair that meets on several pages comes out once: on the page of the later start.
    """
    if how != "inner":
        same = Window.partitionBy(*left.columns).orderBy(F.lit(0))
        left = left.withColumn("_row", F.struct(*left.columns, F.row_number().over(same)))
    a, b = paged(left, l_start, l_size, page), paged(right, r_start, r_size, page)
    b = b.select(*(F.col(c).alias(f"_r_{c}") for c in b.columns))
    meets = (F.col(l_start) < F.col(f"_r_{r_start}") + F.col(f"_r_{r_size}")) & (F.col(f"_r_{r_start}") < F.col(l_start) + F.col(l_size))
    on = (F.col("_page") == F.col("_r__page")) & meets
    for c in space:
        on &= F.col(c) == F.col(f"_r_{c}")
    if how == "inner":
        once = F.greatest(F.col(l_start), F.col(f"_r_{r_start}"))
        return a.join(b, on & (F.expr("_page") == F.floor(once / page)), "inner").drop("_page", "_r__page")
    # rows are told apart by number, so that equal ones stay as many as they are
    found = a.join(b, on, "left_semi").select("_row").distinct()
    return left.join(found, "_row", how).drop("_row")


def covered_by(left: DataFrame, right: DataFrame, how: str, l_start: str, l_size: str, r_start: str, r_size: str, space: tuple[str, ...] = SPACE, page: int = PAGE) -> DataFrame:
    """The left intervals that lie within one of the right (left_semi), or that don't (left_anti)."""
    b = paged(right, r_start, r_size, page)
    b = b.select(*(F.col(c).alias(f"_r_{c}") for c in b.columns))
    on = (F.expr(f"{l_start} div {page}") == F.col("_r__page")) & (F.col(f"_r_{r_start}") <= F.col(l_start)) & (F.col(l_start) + F.col(l_size) <= F.col(f"_r_{r_start}") + F.col(f"_r_{r_size}"))
    for c in space:
        on &= F.col(c) == F.col(f"_r_{c}")
    return left.join(b, on, how)


def with_previous_end(intervals: DataFrame, start: str, size: str, group: tuple[str, ...] = SPACE) -> DataFrame:
    """Adds previous_end: the greatest end of the intervals before in the group; an overlap is start < previous_end.

    Taken over stretches of SWEEP addresses, then within one, so a group with most of the rows is swept by many tasks.
    """
    return before(intervals, list(group), [start], F.floor(F.col(start) / SWEEP).cast("long"), F.col(start) + F.col(size), "previous_end", F.max)


def overlaps_of(ranges: DataFrame, group: list[str], first: str, last: str) -> DataFrame:
    """Ranges that begin before the one ahead of them in their group ends."""
    w = Window.partitionBy(*group).orderBy(first, last)
    return ranges.withColumn("previous_last", F.lag(last).over(w)).where(F.col(first) < F.col("previous_last"))


def discontinuous(rows: DataFrame, group: list[str], index: str) -> DataFrame:
    """Rows whose index isn't the number of rows before them in their group, with that number as `expected`."""
    w = Window.partitionBy(*group).orderBy(index)
    return rows.withColumn("expected", (F.row_number().over(w) - 1).cast("long")).where(~F.col(index).eqNullSafe(F.col("expected")))


def overlaps(intervals: DataFrame, start: str, size: str, group: tuple[str, ...] = SPACE) -> DataFrame:
    return with_previous_end(intervals, start, size, group).where(F.col(start) < F.col("previous_end"))


def breaks(ranges: DataFrame, group: str, first: str, last: str) -> DataFrame:
    """Ranges that don't begin where the one before ends, or at 0 if they are the first of their group."""
    w = Window.partitionBy(group).orderBy(first, last)
    return ranges.withColumn("expected", F.coalesce(F.lag(last).over(w), F.lit(0))).where(F.col(first) != F.col("expected"))


def coalesced(ranges: DataFrame, group: list[str], order: str, same: list[str], first: str, last: str) -> DataFrame:
    """Adjacent rows with equal values of `same` that join end to start become one range, with the number of rows."""
    w = Window.partitionBy(*group).orderBy(order)
    new = F.lit(False)
    for c in same:
        new |= ~F.lag(c).over(w).eqNullSafe(F.col(c))
    new |= ~F.lag(last).over(w).eqNullSafe(F.col(first))
    island = F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("island", island).groupBy(*group, *same, "island").agg(F.min(first).alias("first"), F.max(last).alias("last"), F.count("*").alias("n_rows"))


def gaps(intervals: DataFrame, spaces: DataFrame, start: str, size: str, limit: str, group: tuple[str, ...] = SPACE) -> DataFrame:
    """(group, first, last) of what no interval covers between 0 and each space's limit."""
    ends = spaces.select(*group, F.col(limit).alias(start), F.lit(0).cast("long").alias(size), F.col(limit).alias("_limit"))
    marks = intervals.select(*group, start, size, F.lit(None).cast("long").alias("_limit")).unionByName(ends)
    marked = with_previous_end(marks, start, size, group)
    first = F.coalesce("previous_end", F.lit(0))
    return marked.select(*group, first.cast("long").alias("first"), F.col(start).alias("last")).where("first < last")


def clipped_gaps(gap: DataFrame, chunks: DataFrame, group: tuple[str, ...] = SPACE, page: int = PAGE) -> DataFrame:
    """The parts of gaps within chunks (logical_start, length): (group, chunk_start, first, last)."""
    g = gap.withColumn("length_", F.col("last") - F.col("first"))
    met = overlapping(g, chunks.select(*group, "logical_start", "length"), "inner", "first", "length_", "logical_start", "length", group, page)
    return met.select(*group, F.col("_r_logical_start").alias("chunk_start"), F.greatest("first", "_r_logical_start").alias("first"), F.least("last", F.col("_r_logical_start") + F.col("_r_length")).alias("last"))


def logical_read(requests: DataFrame, chunks: DataFrame, page: int = PAGE) -> DataFrame:
    """Bytes of requests (request_id, segment, cluster, offset, size) from chunks (.., logical_start, length, data).

    Status READ with the bytes, or INCOMPLETE and NULL where chunks leave a gap or the request runs over the end.
    """
    met = overlapping(requests, chunks, "inner", "offset", "size", "logical_start", "length", page=page)
    begin = F.greatest("offset", "_r_logical_start")
    stop = F.least(F.col("offset") + F.col("size"), F.col("_r_logical_start") + F.col("_r_length"))
    part = met.select("request_id", begin.alias("begin"), (stop - begin).alias("n"), F.col("_r_data").substr((begin - F.col("_r_logical_start") + 1).cast("int"), (stop - begin).cast("int")).alias("part"))
    joined = part.groupBy("request_id").agg(F.sum("n").alias("got"), F.array_sort(F.collect_list(F.struct("begin", "part"))).alias("parts"))
    data = F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["part"]))
    out = requests.join(joined, "request_id", "left")
    whole = F.coalesce(F.col("got") == F.col("size"), F.col("size") == 0)
    return out.select(*requests.columns, F.when(whole, "READ").otherwise("INCOMPLETE").alias("status"), F.when(whole, F.coalesce(data, F.unhex(F.lit("")))).alias("data"))


def physical_spans(requests: DataFrame, extents: DataFrame, page: int = PAGE) -> DataFrame:
    """(request_id, logical_start, physical_start, length): where the bytes of each request lie, in order of address."""
    met = overlapping(requests, extents, "inner", "offset", "size", "logical_start", "length", page=page)
    begin = F.greatest("offset", "_r_logical_start")
    stop = F.least(F.col("offset") + F.col("size"), F.col("_r_logical_start") + F.col("_r_length"))
    return met.select("request_id", begin.alias("logical_start"), (F.col("_r_physical_start") + begin - F.col("_r_logical_start")).alias("physical_start"), (stop - begin).alias("length"))

"""The pointer graph: pages of neighbours, reachability, bounded walks and closures."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import before, bucket_of


def neighbours(edge: DataFrame, node: int, direction: str = "out", after: tuple[int, int, int] | None = None, limit: int = 100) -> DataFrame:
    """A page of the links of an allocation in address order, strictly after a cursor (segment, cluster, offset)."""
    mine = edge.where(F.col("s_id" if direction == "out" else "t_id") == node)
    if after is not None:
        mine = mine.where(F.struct("segment", "cluster", "logical_offset") > F.struct(*(F.lit(x).cast("long") for x in after)))
    return mine.orderBy("segment", "cluster", "logical_offset").limit(limit)


def reachable(links: DataFrame, seeds: DataFrame, depth: int | None = None, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, depth) of all nodes within so many steps of the seeds over links (source, target), each at its least depth.

    Each round joins the frontier alone with the links and drops what was seen before.  Without a depth, which needs a cut, it goes
    on until nothing is new.
    """
    if depth is None and cut is None:
        raise ValueError("INVALID_ARGUMENT: a walk to the end needs a cut")
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    steps = links.select("source", "target").distinct()
    for d in count(1) if depth is None else range(1, depth + 1):
        new = frontier.join(steps, frontier["node"] == steps["source"]).select(F.col("target").alias("node")).distinct()
        frontier = new.join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        if cut:  # without it a plan doubles each round: for a few rounds only
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def walk(links: DataFrame, seed: int, max_nodes: int = 1000, max_links: int = 1000, max_depth: int = 64) -> dict:
    """A breadth-first walk within budgets that one caller may see: nodes with depths, links, and whether it was cut.

    Order: nodes first come first served, links of a node by id.  At most max_links + 1 rows are fetched for a level, so the
    driver holds no more than the budgets, whatever the graph.
    """
    if not (1 <= max_nodes <= 1000 and 1 <= max_links <= 1000 and 0 <= max_depth <= 64):
        raise ValueError("1 to 1000 nodes and links and a depth of 0 to 64 are allowed")
    depth, order, taken, truncated = {seed: 0}, [seed], [], False
    level, at = [seed], 0
    while level and at < max_depth:
        rank = links.sparkSession.createDataFrame([(n, i) for i, n in enumerate(level)], "source long, rank long")
        left = max_links - len(taken)
        got = links.join(F.broadcast(rank), "source").orderBy("rank", "link_id").limit(left + 1).select("source", "target", "link_id").collect()
        truncated |= len(got) > left
        following = []
        for r in got[:left]:
            taken.append((r.source, r.target, r.link_id))
            if r.target not in depth and r.target is not None:
                if len(depth) >= max_nodes:
                    truncated = True
                    continue
                depth[r.target] = at + 1
                order.append(r.target)
                following.append(r.target)
        if truncated and len(taken) >= max_links:
            break
        level, at = following, at + 1
    return {"nodes": [(n, depth[n]) for n in order], "links": taken, "truncated": truncated}


def closure(edges: DataFrame, child: str, parent: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, ancestor, distance) of a parent relation, itself at 0; a pair comes at its least distance, so cycles end.

    Distances double each round; the rounds stop when one adds nothing.  cut: what writes a round's rows.
    """
    up = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node IS NOT NULL AND ancestor IS NOT NULL").distinct()
    nodes = edges.select(F.col(child).alias("node")).union(up.select("ancestor")).where("node IS NOT NULL").distinct()
    reach = cut(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance")).union(up.where("node != ancestor").withColumn("distance", F.lit(1).cast("long"))))
    size, new = -1, reach.count()
    while new != size:
        a, b = reach.toDF("node", "via", "d1"), reach.toDF("via", "ancestor", "d2")
        reach = cut(a.join(b, "via").groupBy("node", "ancestor").agg(F.min(F.col("d1") + F.col("d2")).alias("distance")))
        size, new = new, reach.count()
    return reach


def paths(edges: DataFrame, child: str, parent: str, label: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, path, status): labels from the root down; MISSING_PARENT with what a chain reached, or CYCLE without a path.

    A node without a parent is a root.  Each round doubles how far a chain has come, so chains of n nodes take log2(n) rounds; first
    without labels, as what doesn't end within the number of nodes runs in a cycle.  cut: what writes a round's rows.
    """
    own = cut(edges.select(F.col(child).alias("node"), F.col(parent).alias("up"), F.col(label).cast("string").alias("path")))
    state, n, rounds = own.select("node", "up"), own.count(), 0
    while 1 << rounds <= n and not state.where("up IS NOT NULL").isEmpty():
        further = state.toDF("k_node", "k_up")
        state = cut(state.join(further, F.col("up") == F.col("k_node"), "left").select("node", F.col("k_up").alias("up")))
        rounds += 1
    endless = state.where("up IS NOT NULL").select("node").distinct()
    state = own.join(endless, "node", "left_anti").withColumn("lost", F.lit(False))
    for _ in range(rounds):
        further = state.toDF("k_node", "k_up", "k_path", "k_lost").withColumn("found", F.lit(True))
        state = cut(
            state.join(further, F.col("up") == F.col("k_node"), "left").select(
                "node",
                F.col("k_up").alias("up"),
                F.when(F.col("found"), F.concat_ws("/", "k_path", "path")).otherwise(F.col("path")).alias("path"),
                (F.col("lost") | F.coalesce("k_lost", F.lit(False)) | (F.col("up").isNotNull() & F.col("found").isNull())).alias("lost"),
            )
        )
    cycles = endless.select("node", F.lit(None).cast("string").alias("path"), F.lit("CYCLE").alias("status"))
    return state.select("node", "path", F.when(F.col("lost"), "MISSING_PARENT").otherwise("COMPLETE").alias("status")).union(cycles)


def target_view(bases: DataFrame, located: DataFrame) -> DataFrame:
    """How an address views its allocation: (.., view, base_name).

    located has delta (address less start less header), stride, element_count, type_name, admitted; bases (type_name, base_offset,
    base_name).  A base at the place is checked before the element's start, as the class itself lies at 0.
    """
    p = located.withColumns({"index": F.expr("delta div stride"), "within": F.expr("delta % stride")})
    b = bases.select(F.col("type_name").alias("b_type"), F.col("base_offset").alias("b_at"), "base_name")
    j = p.join(b, (F.col("type_name") == F.col("b_type")) & (F.col("within") == F.col("b_at")) & F.col("admitted"), "left")
    view = (
        F.when((F.col("delta") < 0) | (F.col("stride") <= 0), "HEADER_OR_UNKNOWN")
        .when(F.col("index") >= F.col("element_count"), "PADDING_OR_OUTSIDE")
        .when(F.col("base_name").isNotNull(), "EXACT_BASE_SUBOBJECT_VIEW")
        .when(F.col("within") == 0, "EXACT_ELEMENT_START")
        .otherwise("INTERIOR")
    )
    return j.withColumn("view", view).withColumn("base_name", F.when(F.col("view") == "EXACT_BASE_SUBOBJECT_VIEW", F.col("base_name"))).drop("b_type", "b_at")


def resolved(slots: DataFrame) -> DataFrame:
    """The pointer state of slots with raw (what is read), b_raw, width, b_width, b_status (the binding, NULL without one) and complete."""
    zero = F.translate(F.hex("raw"), "0", "") == ""
    state = (
        F.when(F.col("b_status").isNull() & zero & F.col("complete"), "NULL_IMPLICIT")
        .when(F.col("b_status").isNull(), "MISSING")
        .when(F.col("b_width") != F.col("width"), "WIDTH_MISMATCH")
        .when(F.col("b_raw") != F.col("raw"), "RAW_MISMATCH")
        .when(F.col("b_status") == "NULL", "NULL_EXPLICIT")
        .otherwise(F.col("b_status"))
    )
    return slots.withColumn("state", state)


def budgeted(rows: DataFrame, group: list[str], order: list[str], cost: str, most: int) -> DataFrame:
    """Rows of each group while their running cost is within a budget, with truncated: whether the group has more."""
    totals = rows.groupBy(*(F.col(g).alias(f"_t{i}") for i, g in enumerate(group))).agg((F.sum(cost) > most).alias("truncated"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_t{i}"))
    summed = before(rows, group, order, bucket_of(rows, order[0]), F.col(cost), "_spent")
    return summed.where(F.coalesce("_spent", F.lit(0)) + F.col(cost) <= most).join(totals, on).drop("_spent", *(f"_t{i}" for i in range(len(group))))

"""What collections hold, against what they declare: chained lists, hash sets, arrays, and the reconciliation of populations."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import before, bucket_of


def list_chains(blocks: DataFrame, most: int | None = None, cut=None) -> DataFrame:
    """(coll_id, node_id, place) of each collection's chain from its root, over blocks (coll_id, node_id, next_node_id, is_root).

    A block that was seen isn't followed again.  Chains are followed to their ends; `most` is a budget of links, and
    list_membership tells the chains that it ended.  cut: what writes a round's rows, as long chains need.
    """
    step = blocks.select("coll_id", "node_id", "next_node_id")
    chain = blocks.where("is_root").select("coll_id", "node_id", F.lit(0).cast("long").alias("place"))
    front = chain
    for place in count(1) if most is None else range(1, most + 1):
        new = front.join(step, ["coll_id", "node_id"]).where("next_node_id IS NOT NULL").select("coll_id", F.col("next_node_id").alias("node_id")).distinct()
        front = new.join(chain, ["coll_id", "node_id"], "left_anti").withColumn("place", F.lit(place).cast("long"))
        front = cut(front) if cut else front
        if front.isEmpty():
            break
        chain = chain.unionByName(front)
    return chain


def list_membership(collections: DataFrame, blocks: DataFrame, chain: DataFrame) -> DataFrame:
    """(coll_id, declared, observed, n_blocks, status): members are the first local_card slots of each chained block.

    Where a chained block's next one isn't in the chain, a budget has ended it: RESOURCE_BOUND.
    """
    seen = chain.join(blocks, ["coll_id", "node_id"]).groupBy("coll_id").agg(F.sum("local_card").alias("observed"), F.count("*").alias("n_blocks"))
    onward = chain.join(blocks, ["coll_id", "node_id"]).where("next_node_id IS NOT NULL").select("coll_id", F.col("next_node_id").alias("node_id"))
    ended = onward.join(chain, ["coll_id", "node_id"], "left_anti").select("coll_id").distinct().withColumn("ended", F.lit(True))
    out = collections.join(seen, "coll_id", "left").join(ended, "coll_id", "left").withColumns({"observed": F.coalesce("observed", F.lit(0)).cast("long"), "n_blocks": F.coalesce("n_blocks", F.lit(0)).cast("long")})
    return out.select("coll_id", "declared", "observed", "n_blocks", F.when(F.col("ended"), "RESOURCE_BOUND").when(F.col("declared") == F.col("observed"), "VERIFIED_CARDINALITY").otherwise("CARDINALITY_MISMATCH").alias("status"))


def set_membership(sets: DataFrame, slots: DataFrame) -> DataFrame:
    """Of hash sets (coll_id, n_entries, n_keys, n_slots) with slots (coll_id, slot_index, target_id).

    An empty slot holds nothing and one that points to its own set is a sentinel; neither is a member.  Status: more keys than slots or
    counters that differ, a target twice, or another number of members than declared.
    """
    member = slots.where(F.col("target_id").isNotNull() & (F.col("target_id") != F.col("coll_id")))
    seen = member.groupBy("coll_id").agg(F.count("*").alias("members"), F.count_distinct("target_id").alias("distinct_members"))
    out = sets.join(seen, "coll_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("members", "distinct_members")})
    status = (
        F.when((F.col("n_entries") != F.col("n_keys")) | (F.col("n_entries") > F.col("n_slots")), "CARDINALITY_MISMATCH")
        .when(F.col("members") != F.col("distinct_members"), "DUPLICATE_SET_REFERENCE")
        .when(F.col("members") == F.col("n_entries"), "VERIFIED_CARDINALITY")
        .otherwise("CARDINALITY_MISMATCH")
    )
    return out.select("coll_id", "n_entries", "members", status.alias("status"))


def array_window(arrays: DataFrame, values: str, entries: str, tail: str) -> DataFrame:
    """Slots of arrays (coll_id, start, capacity): active below `entries`, others inactive storage; the tail must be the last entry's address."""
    status = F.when(F.col(entries) > F.size(values), "CARDINALITY_MISMATCH").when(
        F.col(tail).eqNullSafe(F.when(F.col(entries) > 0, F.col("start") + (F.col(entries) - 1) * 4)), "VERIFIED_CARDINALITY"
    ).otherwise("CARDINALITY_MISMATCH")
    out = arrays.withColumn("status", status)
    return out.select("coll_id", "status", F.posexplode(values).alias("slot", "value"), (F.col("slot") < F.col(entries)).alias("active"))


def reconciled(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys both have, only the left, only the right; each side's keys count once."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, keys, "full")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return j.agg(n(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), n(F.col("_r").isNull()).alias("only_left"), n(F.col("_l").isNull()).alias("only_right"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that one side alone has, with the side."""
    return left.subtract(right).withColumn("side", F.lit("left")).union(right.subtract(left).withColumn("side", F.lit("right")))


def population(referrers: DataFrame) -> DataFrame:
    """Referrers (kind, conditional, admitted, target_id) by why they are taken or left out."""
    reason = (
        F.when(F.col("target_id").isNull(), "EXCLUDED_NULL_TARGET")
        .when(F.col("conditional"), "EXCLUDED_CONDITIONAL_UNION")
        .when(~F.col("admitted"), "EXCLUDED_UNADMITTED")
        .otherwise("ELIGIBLE")
    )
    return referrers.withColumn("reason", reason).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def conflicting(contexts: DataFrame, key: str, context: str) -> DataFrame:
    return contexts.select(key, context).distinct().groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def batch(tasks: DataFrame, cursor: int, members: int) -> DataFrame:
    """The next batch of open tasks (id, state, cost) by id after a cursor, within a budget of costs; what no longer fits is DEFERRED."""
    open_ = tasks.where(F.col("state").isin("PENDING", "CONTINUING", "DEFERRED") & (F.col("id") > cursor))
    spent = before(open_, [], ["id"], bucket_of(open_, "id"), F.col("cost"), "spent").withColumn("spent", F.coalesce("spent", F.lit(0)) + F.col("cost"))
    return spent.withColumn("state", F.when(F.col("spent") <= members, "PROCESSED").otherwise("DEFERRED"))

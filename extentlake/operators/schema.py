"""Class layouts as rows: aliases resolved, nested members flattened to slots, and what an address or an element is by them.

A layout is rows of members (type_name, member, offset, kind, size, target, count, stride): kind is one of base, class, union, or a
leaf's; target names the class of a base, class or union, or what a pointer points to; count and stride are an array's, else NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NESTED = ("base", "class", "union")
MAX_DEPTH = 64
#: Elements of a slot that are rows of their own where places are looked up.
MANY = 1 << 12


def resolved_types(types: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(name, resolved, kind, qualifiers, status) of types (name, kind, target): aliases and qualified types followed to what they stand for.

    Distances double each round.  A chain that leads nowhere is UNKNOWN_TARGET, one that comes back to itself RECURSIVE.
    """
    through = F.col("kind").isin("alias", "const", "volatile")
    base = types.select("name", "kind", F.when(through, F.col("target")).alias("up"), F.when(F.col("kind") != "alias", F.when(through, F.array("kind"))).alias("q"))
    state = cut(base.select("name", F.coalesce("up", "name").alias("resolved"), "up", F.coalesce("q", F.array().cast("array<string>")).alias("qualifiers")))
    n, done = state.count(), 1
    while done <= n and not state.where("up IS NOT NULL").isEmpty():
        on = state.select(F.col("name").alias("k_name"), F.col("resolved").alias("k_resolved"), F.col("up").alias("k_up"), F.col("qualifiers").alias("k_q"))
        met = state.join(on, F.col("up") == F.col("k_name"), "left")
        state = cut(met.select("name", F.coalesce("k_resolved", "resolved").alias("resolved"), F.col("k_up").alias("up"), F.array_distinct(F.concat("qualifiers", F.coalesce("k_q", F.array().cast("array<string>")))).alias("qualifiers")))
        done *= 2
    known = types.select(F.col("name").alias("of"), F.col("kind").alias("of_kind"))
    met = state.join(known, F.col("resolved") == F.col("of"), "left")
    status = F.when(F.col("up").isNotNull(), "RECURSIVE").when(F.col("of_kind").isNull(), "UNKNOWN_TARGET").otherwise("RESOLVED")
    return met.select("name", F.when(status == "RESOLVED", F.col("resolved")).alias("resolved"), F.when(status == "RESOLVED", F.col("of_kind")).alias("kind"), F.array_sort("qualifiers").alias("qualifiers"), status.alias("status"))


def declared_pointees(members: DataFrame, types: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(type_name, member, pointee, pointee_kind, status) of the pointer members: what they point to, through aliases."""
    t = resolved_types(types, cut).select(F.col("name").alias("target"), "resolved", F.col("kind").alias("pointee_kind"), "status")
    met = members.where("kind = 'pointer'").join(t, "target", "left")
    return met.select("type_name", "member", F.col("resolved").alias("pointee"), "pointee_kind", F.coalesce("status", F.lit("UNKNOWN_TARGET")).alias("status"))


def slots(members: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(type_name, path, offset, kind, size, target, arrays, conditional_union, status): the leaves of each type with their path through bases
    (::<Base>), members and unions, and the arrays (count, stride) on the way.

    A level is one join.  Leaves within a union are conditional; a class without a layout and what lies deeper than MAX_DEPTH come
    out as what they are, with a status, so nothing vanishes.
    """
    name = F.when(F.col("kind") == "base", F.concat(F.lit("::<"), F.col("target"), F.lit(">"))).otherwise(F.col("member"))
    arrays = F.when(F.col("count").isNotNull(), F.array(F.struct(F.col("count").alias("count"), F.col("stride").alias("stride")))).otherwise(F.array().cast("array<struct<count:bigint,stride:bigint>>"))
    own = cut(members.select("type_name", name.alias("path"), F.col("offset").cast("long").alias("offset"), "kind", F.col("size").cast("long").alias("size"), "target", arrays.alias("arrays"), (F.col("kind") == "union").alias("conditional_union")))
    below = own.toDF(*(f"b_{c}" for c in own.columns))
    open_ = own.where(F.col("kind").isin(*NESTED)).withColumn("status", F.lit("DECLARED"))
    out = own.where(~F.col("kind").isin(*NESTED)).withColumn("status", F.lit("DECLARED"))
    for depth in range(MAX_DEPTH + 1):
        if open_.isEmpty():
            break
        if depth == MAX_DEPTH:
            out = out.unionByName(open_.withColumn("status", F.lit("RESOURCE_BOUND")))
            break
        met = cut(
            open_.join(below, F.col("target") == F.col("b_type_name"), "left").select(
                "type_name",
                F.when(F.col("b_path").isNull(), F.col("path")).otherwise(F.concat_ws(".", "path", "b_path")).alias("path"),
                (F.col("offset") + F.coalesce("b_offset", F.lit(0))).alias("offset"),
                F.coalesce("b_kind", "kind").alias("kind"),
                F.coalesce("b_size", "size").alias("size"),
                F.when(F.col("b_path").isNull(), F.col("target")).otherwise(F.col("b_target")).alias("target"),
                F.concat("arrays", F.coalesce("b_arrays", F.array().cast("array<struct<count:bigint,stride:bigint>>"))).alias("arrays"),
                (F.col("conditional_union") | F.coalesce("b_conditional_union", F.lit(False))).alias("conditional_union"),
                F.when(F.col("b_path").isNull(), "UNKNOWN_CLASS").otherwise(F.col("status")).alias("status"),
            )
        )
        further = F.col("kind").isin(*NESTED) & (F.col("status") == "DECLARED")
        out, open_ = out.unionByName(met.where(~further)), met.where(further)
    return out


def unconditional(slot: DataFrame) -> DataFrame:
    return slot.where("NOT conditional_union")


def pointers(slot: DataFrame) -> DataFrame:
    """Slots of the pointer family, soft and hard ones included."""
    return slot.where(F.col("kind").isin("pointer", "soft_pointer", "hard_pointer"))


def _elements(slot: DataFrame) -> DataFrame:
    """Slots (.., offset, arrays) with a row for each element: where it begins (spot) and its indices, from the outside in.

    A slot of over MANY elements has rows for those of its other arrays alone: the longest with a stride stays a progression of n elements
    from spot on, step apart, in place `long` of the indices.  Elsewhere these three are NULL.
    """
    total = F.aggregate("arrays", F.lit(1.0), lambda a, x: a * x["count"])
    longest = F.array_max(F.transform("arrays", lambda x, i: F.when(x["stride"] != 0, F.struct(x["count"].alias("n"), i.alias("long"), x["stride"].alias("step")))))
    s = slot.where(~F.exists("arrays", lambda x: x["count"] < 1)).withColumn("_l", F.when(total > MANY, longest))
    kept = lambda i: F.col("_l.long").eqNullSafe(i)
    dims = F.reverse(F.transform("arrays", lambda x, i: F.struct(F.when(kept(i), F.lit(1).cast("long")).otherwise(x["count"]).alias("n"), F.coalesce(x["stride"], F.lit(0)).alias("step"))))
    s = s.withColumn("_dims", dims).withColumn("_n", F.aggregate("_dims", F.lit(1).cast("long"), lambda a, x: a * x["n"]))
    s = s.withColumn("_k", F.explode(F.expr(f"sequence(0L, _n - 1, {MANY}L)"))).withColumn("_k", F.explode(F.expr(f"sequence(_k, least(_k + {MANY}L, _n) - 1)")))
    start = F.struct(F.col("_k").alias("rest"), F.col("offset").alias("spot"), F.array().cast("array<bigint>").alias("indices"))
    step = lambda a, x: F.struct(
        F.floor(a["rest"] / x["n"]).cast("long").alias("rest"),
        (a["spot"] + a["rest"] % x["n"] * x["step"]).alias("spot"),
        F.concat(F.array(a["rest"] % x["n"]), a["indices"]).alias("indices"),
    )
    return s.withColumn("_e", F.aggregate("_dims", start, step)).select(*slot.columns, "_e.spot", "_e.indices", "_l.n", "_l.long", "_l.step")


def at_displacement(places: DataFrame, slot: DataFrame) -> DataFrame:
    """Places (.., type_name, displacement) with the slots that begin there: path and indices of the arrays on the way; NULL where none does.

    An equi-join on where elements begin; of long arrays, on the stride and what is left of a displacement by it.
    """
    out = ["path", "indices", "slot_size", "conditional_union"]
    e = _elements(slot.select("type_name", "path", F.col("size").alias("slot_size"), "conditional_union", "offset", "arrays"))
    found = e.where("long IS NULL").select(F.col("type_name").alias("_type"), F.col("spot").alias("_at"), *out)
    long_ = e.where("long IS NOT NULL").withColumn("_left", F.expr("pmod(spot, abs(step))"))
    steps = long_.select("type_name", "step").distinct()
    asked = places.select("type_name", F.col("displacement").cast("long").alias("_at")).distinct().join(steps, "type_name").withColumn("_left", F.expr("pmod(_at, abs(step))"))
    met = asked.join(long_, ["type_name", "step", "_left"]).withColumn("_i", F.expr("(_at - spot) div step")).where("_i >= 0 AND _i < n AND _at = spot + _i * step")
    met = met.withColumn("indices", F.transform("indices", lambda v, i: F.when(i == F.col("long"), F.col("_i")).otherwise(v)))
    found = found.unionByName(met.select(F.col("type_name").alias("_type"), "_at", *out))
    return places.join(found, (F.col("type_name") == F.col("_type")) & (F.col("displacement") == F.col("_at")), "left").select(*places.columns, *out)


def coverage(slot: DataFrame, sizes: DataFrame) -> DataFrame:
    """(type_name, size, covered, uncovered, overlapping): bytes of each type (type_name, size) that its unconditional slots cover, leave open, or cover twice."""
    spots = F.aggregate("arrays", F.array(F.col("offset")), lambda a, x: F.flatten(F.transform(a, lambda o: F.transform(F.sequence(F.lit(0).cast("long"), x["count"] - 1), lambda i: o + i * x["stride"]))))
    each = unconditional(slot).withColumn("at", F.explode(spots)).withColumn("byte", F.explode(F.expr("sequence(at, at + size - 1)")))
    n = each.groupBy("type_name", "byte").agg(F.count("*").alias("n")).groupBy("type_name").agg(F.count("*").alias("covered"), F.count_if(F.col("n") > 1).alias("overlapping"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return sizes.join(n, "type_name", "left").select("type_name", "size", zero("covered").alias("covered"), (F.col("size") - zero("covered")).alias("uncovered"), zero("overlapping").alias("overlapping"))


def record_slots(slot: DataFrame) -> DataFrame:
    """Slots with arrays expanded, a row for each element (type_name, path, offset, kind, size, conditional_union): what decode.decoded takes.

    Union arms all come out, as the active one isn't known; they are marked.
    """
    spots = F.aggregate(
        "arrays",
        F.array(F.struct(F.lit("").alias("at"), F.col("offset").alias("offset"))),
        lambda a, x: F.flatten(F.transform(a, lambda o: F.transform(F.sequence(F.lit(0).cast("long"), x["count"] - 1), lambda i: F.struct(F.concat(o["at"], F.lit("["), i.cast("string"), F.lit("]")).alias("at"), (o["offset"] + i * x["stride"]).alias("offset"))))),
    )
    each = slot.withColumn("s", F.explode(spots))
    return each.select("type_name", F.concat("path", "s.at").alias("path"), F.col("s.offset").alias("offset"), "kind", "size", "conditional_union")

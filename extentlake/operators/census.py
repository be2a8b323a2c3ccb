"""Counts of allocations, of the shapes of references, and of roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import containing
from .running import bucket_of, numbered


def element_count() -> Column:
    return F.expr("CASE WHEN vector = 1 THEN (size - array_header_size) div element_stride ELSE 1 END")


def type_census(alloc: DataFrame) -> DataFrame:
    return alloc.groupBy("type_name").agg(F.count("*").alias("allocations"), F.sum("element_count").alias("elements"), F.sum("size").alias("bytes"))


def sub_census(alloc: DataFrame, tag: str, template: str) -> DataFrame:
    return alloc.groupBy("type_name", tag, template).agg(F.count("*").alias("allocations"), F.sum("element_count").alias("elements"))


def allocation_groups(alloc: DataFrame, keys: list[str]) -> DataFrame:
    return alloc.groupBy(*keys).agg(F.count("*").alias("allocations"), F.sum(F.col("vector").cast("long")).alias("vectors"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("size").alias("bytes"))


def accounting(alloc: DataFrame) -> DataFrame:
    """Totals of the whole table; an empty table gives zeros."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return alloc.agg(F.count("*").alias("allocations"), zero("size").alias("bytes"), zero(F.when(F.col("vector") == 1, F.col("element_count")).otherwise(1)).alias("elements"), zero(F.col("vector").cast("long")).alias("vectors"))


def displacement() -> Column:
    """Of a pointer in its source: within the element of a vector, else within the allocation."""
    delta = F.col("logical_offset") - F.col("s_start") - F.coalesce("s_header", F.lit(0))
    return F.when(F.col("s_start").isNull(), None).when((F.col("s_vector") == 1) & (F.col("s_stride") > 0), delta % F.col("s_stride")).otherwise(F.col("logical_offset") - F.col("s_start"))


def edges(pointers: DataFrame, alloc: DataFrame) -> DataFrame:
    """Pointers with the allocation that holds the whole slot and the one that holds the target's first byte; NULL where none does."""
    side = lambda p: alloc.select("segment", "cluster", *(F.col(c).alias(f"{p}_{n}") for c, n in (("id", "id"), ("type_name", "type"), ("logical_offset", "start"), ("size", "size"), ("vector", "vector"), ("element_stride", "stride"), ("array_header_size", "header"))))
    held = containing(pointers, side("s"), "logical_offset", "s_start", "s_size", F.col("width"))
    target = side("t").select("segment", "cluster", "t_id", "t_type", "t_start", "t_size")
    aimed = containing(held, target, "target_offset", "t_start", "t_size", 1, {"target_segment": "segment", "target_cluster": "cluster"})
    return aimed.withColumn("displacement", displacement())


def reference_shapes(edge: DataFrame, fold: int | None = None) -> DataFrame:
    """Pointers by source type, target type, status, displacement and width; NULL keys are groups."""
    at = F.col("displacement") % fold if fold else F.col("displacement")
    return edge.groupBy(F.col("s_type").alias("source_type"), F.col("t_type").alias("target_type"), "status", at.alias("displacement"), "width").agg(F.count("*").alias("n"))


def degrees(edge: DataFrame) -> DataFrame:
    """References out of and into each type, in one pass; links count only RESOLVED ones with a target."""
    link = ((F.col("status") == "RESOLVED") & F.col("t_id").isNotNull()).cast("long")
    end = lambda c, out: F.struct(F.col(c).alias("type_name"), F.lit(out).alias("out"), F.coalesce(link, F.lit(0).cast("long")).alias("link"))
    ends = edge.select(F.explode(F.array(end("s_type", 1), end("t_type", 0))).alias("e")).select("e.*").where("type_name IS NOT NULL")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out, into = F.col("out").cast("long"), 1 - F.col("out").cast("long")
    return ends.groupBy("type_name").agg(count(out).alias("outgoing"), count(out * F.col("link")).alias("outgoing_links"), count(into).alias("incoming"), count(into * F.col("link")).alias("incoming_links"))


def roles(types: DataFrame) -> DataFrame:
    """(.., role, priority) of types with entity, collection, class_, text, n, n_vectors, incoming_links."""
    role = (
        F.when(F.col("entity"), "ESTABLISHED_ENTITY_FAMILY")
        .when(F.col("collection"), "COLLECTION_STORAGE")
        .when((F.col("n_vectors") == F.col("n")) & ~F.col("class_"), "ARRAY_PAYLOAD_STORAGE")
        .when(F.col("class_"), "STRUCTURAL_RECORD")
        .otherwise("UNKNOWN_STORAGE")
    )
    types = types.withColumn("role", role)
    priority = (
        F.when(F.col("role") == "ESTABLISHED_ENTITY_FAMILY", "ESTABLISHED_ENTITY")
        .when((F.col("role") == "STRUCTURAL_RECORD") & F.col("text") & (F.col("array_links") > 0), "NAMED_STRUCTURAL_RECORD")
        .when(F.col("incoming_links") > 0, "SOURCE_ROOT_OR_ENTITY_LINK")
        .otherwise("STORAGE_ONLY")
    )
    return types.withColumn("priority", priority)


def region() -> Column:
    """Where an address lies in an allocation (delta from its start): header, element start or interior, padding."""
    d = F.col("delta") - F.col("array_header_size")
    index, within = F.expr("(delta - array_header_size) div element_stride"), d % F.col("element_stride")
    return (
        F.when((F.col("vector") == 1) & (d < 0), "ARRAY_HEADER")
        .when(index >= F.col("element_count"), "TERMINAL_PADDING")
        .when(within == 0, "ELEMENT_START")
        .when(within < F.col("element_size"), "ELEMENT_INTERIOR")
        .otherwise("INTER_ELEMENT")
    )


def capped_histogram(counts: DataFrame, label: str, n: str, most: int, other: str = "__OTHER__") -> DataFrame:
    """The most frequent labels, ties by label, and what the others count together."""
    top = counts.orderBy(F.desc(n), label).limit(most)
    rest = counts.join(F.broadcast(top.select(label)), label, "left_anti").agg(F.sum(n).alias(n)).where(F.col(n).isNotNull()).select(F.lit(other).alias(label), n)
    return top.select(label, n).unionByName(rest)


def interned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values with a digest, and ids from 1 in order of the digest, numbered by the digest's first digits."""
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    values = rows.select(*columns).distinct().withColumn("digest", digest)
    return numbered(values, [], ["digest"], F.conv(F.substring("digest", 1, 4), 16, 10).cast("long"), "id").withColumn("id", F.col("id") + 1)


def spread(rows: DataFrame, stratum: str, order: str, k: int) -> DataFrame:
    """At most k rows of each stratum, evenly spaced: the rows number i * (n - 1) div (k - 1)."""
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    ranked = numbered(rows, [stratum], [order], bucket_of(rows, order), "_i").join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(F.col("_n") <= k, i.cast("long")).otherwise(F.floor(i * (F.col("_n") - 1) / (k - 1)).cast("long")))
    return ranked.where(F.array_contains(wanted, F.col("_i"))).drop("_i", "_n", "_s")


def counters(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, counters): a map from each key to its count, keys in order."""
    n = rows.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count("*").alias("_n"))
    return n.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "_n")))).alias("counters"))


def sampled_reasons(rows: DataFrame, reason: str, sample: str, reasons: int = 64, samples: int = 4) -> DataFrame:
    """(reason, n, samples): the most frequent reasons with their least samples; what is over the bound is counted as __OTHER__."""
    counts = rows.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    top = capped_histogram(counts, "reason", "n", reasons)
    least = rows.select(F.col(reason).alias("reason"), F.col(sample).alias("_x")).distinct()
    w = Window.partitionBy("reason").orderBy("_x")
    least = least.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= samples).groupBy("reason").agg(F.array_sort(F.collect_list("_x")).alias("samples"))
    return top.join(least, top["reason"].eqNullSafe(least["reason"]), "left").select(top["reason"], "n", "samples")

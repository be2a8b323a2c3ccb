"""Reports over an archive: classes of objects, roots, payload coverage, and the catalog of entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure
from .intervals import containing, gaps
from .links import payload


def classified(objects: DataFrame) -> DataFrame:
    """The class of objects with entity, admitted, is_vector, bounded, partial and reasons: an unadmitted vector shows its metadata alone."""
    c = (
        F.when(F.col("entity"), "ENTITY_DATASET")
        .when(F.col("is_vector") & ~F.col("admitted"), "ARRAY_METADATA_ONLY")
        .when(F.col("bounded"), "SCHEMA_INSPECTION_BOUND")
        .when(F.col("partial"), "SOURCE_ENTITY_NAME_CANDIDATE")
        .when(F.col("reasons"), "DATASET_CANDIDATE")
        .otherwise("CURRENT_OBJECT")
    )
    return objects.withColumn("classification", c)


def bound_roots(roots: DataFrame, alloc: DataFrame) -> DataFrame:
    """Roots (name, segment, cluster, offset) with the allocation that holds their value, if one does."""
    a = alloc.select("segment", "cluster", "id", "type_name", F.col("logical_offset").alias("start"), "size")
    return containing(roots, a, "offset", "start", "size")


def payload_census(alloc: DataFrame, clusters: DataFrame) -> DataFrame:
    """Ranges and bytes by what is known of them; with the unindexed rest they add up to all allocated bytes."""
    known = alloc.select(F.when(F.col("vector") == 1, "NATIVE_PRIMITIVE_BLOCK_CHECKED").otherwise("RAW_LOGICAL_BYTES_VERIFIED").alias("status"), F.col("size").alias("bytes"))
    rest = gaps(alloc, clusters, "logical_offset", "size", "allocated_bytes").select(F.lit("RAW_UNINDEXED").alias("status"), (F.col("last") - F.col("first")).alias("bytes"))
    return known.union(rest).groupBy("status").agg(F.count("*").alias("ranges"), F.sum("bytes").alias("bytes"))


#: Shape classes by the first ancestor that is present, in order.
RENDERED = (("TriSurface", "triangles"), ("LineString", "lines"), ("PointSet", "points"), ("RegularGrid2", "grid2"), ("RegularGrid3", "grid3"), ("ImagePlane", "image_plane"), ("GeometryCollection", "collection"), ("LinearPolygon", "polygon_boundaries"))


def render_class(ancestors: Column) -> Column:
    out = F.lit("unsupported_shape_type")
    for name, kind in reversed(RENDERED):
        out = F.when(F.array_contains(ancestors, name), kind).otherwise(out)
    return out


def catalog(entities: DataFrame, shapes: DataFrame, ancestors: DataFrame, groups: DataFrame) -> DataFrame:
    """Entities (id, name, shape_id, group_id) with the render class of their shape and the path of their group; what lacks is a diagnostic."""
    kinds = ancestors.groupBy(F.col("node").alias("type_name")).agg(F.collect_set("ancestor").alias("of"))
    s = shapes.join(kinds, "type_name", "left").select(F.col("id").alias("shape_id"), render_class(F.coalesce("of", F.array().cast("array<string>"))).alias("render_class"))
    e = entities.join(s, "shape_id", "left").join(groups.select(F.col("node").alias("group_id"), "path", F.col("status").alias("path_status")), "group_id", "left")
    state = F.when(F.col("shape_id").isNull(), "NO_SHAPE").when(F.col("render_class").isNull(), "SHAPE_NOT_FOUND").when(F.col("group_id").isNotNull() & F.col("path").isNull(), "GROUP_NOT_FOUND").otherwise("CATALOGUED")
    return e.select("id", "name", "render_class", "path", "path_status", state.alias("diagnostic"))


def deduplicated_pages(rows: DataFrame, place: list[str], page: str, signature: list[str]) -> DataFrame:
    """One row for each place that pages record: the first page, how often it was seen, and whether all agree on its signature."""
    g = rows.groupBy(*place).agg(F.min(page).alias("page"), F.count("*").alias("seen"), F.count_distinct(F.struct(*signature)).alias("kinds"))
    return g.withColumn("status", F.when(F.col("kinds") > 1, "SIGNATURE_CONFLICT").otherwise("CURRENT")).drop("kinds")


def unambiguous(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose name no other row has: a dictionary leaves out what it can't tell apart."""
    single = rows.groupBy(name).agg(F.count("*").alias("_n")).where("_n = 1").select(name)
    return rows.join(single, name, "left_semi")


def census_rank(types: DataFrame) -> DataFrame:
    """Adds rank, by which a discovery pages: entities, types with text, classes, others."""
    return types.withColumn("rank", F.when(F.col("entity"), 0).when(F.col("text"), 1).when(F.col("class_"), 2).otherwise(3))


def page(objects: DataFrame, cursor: tuple | None, limit: int) -> DataFrame:
    """The next objects (.., rank, type_name, id, element) strictly after a cursor of these four, in their order."""
    from .paging import after

    return after(objects, ["rank", "type_name", "id", "element"], cursor, limit)


def selected(requests: DataFrame, alloc: DataFrame, database: str) -> DataFrame:
    """(segment, cluster, offset, id, times, status) of each distinct requested address (database, segment, cluster, offset): an
    allocation's exact start, or why it is none."""
    r = requests.groupBy("database", "segment", "cluster", "offset").agg(F.count("*").alias("times"))
    a = alloc.select("segment", "cluster", F.col("logical_offset").alias("offset"), "id")
    met = r.join(a, ["segment", "cluster", "offset"], "left")
    status = F.when(~F.col("database").eqNullSafe(F.lit(database)), "EXTERNAL_DATABASE").when(F.col("id").isNull(), "NO_ALLOCATION_STARTS_HERE").otherwise("SELECTED")
    return met.select("database", "segment", "cluster", "offset", F.when(status == "SELECTED", F.col("id")).alias("id"), "times", status.alias("status"))


def owners(entities: DataFrame, children: DataFrame, geometries: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(geometry, owner, distance): every entity (id, shape) from whose shape a geometry is reached over children (parent, child); a
    geometry may have several owners, and one without has a NULL owner.  Cycles end."""
    reach = closure(children, "parent", "child", cut)
    own = entities.where("shape IS NOT NULL").join(reach, F.col("shape") == F.col("node"), "left")
    own = own.select(F.coalesce("ancestor", "shape").alias("geometry"), F.col("id").alias("owner"), F.coalesce("distance", F.lit(0)).cast("long").alias("distance"))
    own = own.groupBy("geometry", "owner").agg(F.min("distance").alias("distance"))
    return geometries.select("geometry").distinct().join(own, "geometry", "left")


def attributes(entities: DataFrame, values: DataFrame) -> DataFrame:
    """(id, n, attributes): the named values (id, name, value) of each entity as a map; a name that comes twice is left out and counted."""
    g = values.groupBy("id", "name").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    m = g.groupBy("id").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.struct("name", "value"))))).alias("attributes"))
    return entities.select("id").join(m, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("ambiguous", F.lit(0)).cast("long").alias("ambiguous"), "attributes")


def admitted_roots(roots: DataFrame, alloc: DataFrame) -> DataFrame:
    """Roots (name, segment, cluster, offset) with the node that holds their value and whether it begins there."""
    held = containing(roots, alloc.select("segment", "cluster", F.col("id").alias("node"), F.col("logical_offset").alias("start"), "size"), "offset", "start", "size")
    admission = F.when(F.col("node").isNull(), "ROOT_WITHOUT_ALLOCATION").when(F.col("offset") != F.col("start"), "ROOT_INSIDE_ALLOCATION").otherwise("ADMITTED")
    return held.withColumn("admission", admission).drop("start", "size")


def root_walk(roots: DataFrame, alloc: DataFrame, links: DataFrame) -> DataFrame:
    """(node, depth, status) of what admitted roots reach over links (source, target, storage): roots together, each node at its least depth."""
    return payload(links, admitted_roots(roots, alloc).where("admission = 'ADMITTED'").select("node").distinct())


def accounting(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(check_name, left, right, equal): totals that must agree, each side a frame of one number."""
    out = None
    for name, left, right in checks:
        a, b = left.toDF("left"), right.toDF("right")
        row = a.join(b, F.lit(True)).select(F.lit(name).alias("check_name"), F.col("left").cast("long"), F.col("right").cast("long"), F.col("left").eqNullSafe(F.col("right")).alias("equal"))
        out = row if out is None else out.unionByName(row)
    return out


def file_information(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of an archive's tables."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out

"""References resolved to geometry, bottom-up: points, curves, rings, faces, shells, solids, one join a level.

Coordinates are arrays of [x, y, z] and deeper.  ``geometry`` tables have dataset_id, id, kind, geom_type and coordinates as
JSON text, as each kind nests differently.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import chain
from ..model import Topology
from ..plans.derive import D, located
from ..storage import stored
from .spatial import box_pairs


def position() -> Column:
    return F.array("x", "y", "z")


def curve_lines(t: Topology) -> DataFrame:
    """id and line of every curve with at least two known points (unknown ones are left out)."""
    v = located(t).where("x is not null")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", position().alias("c")))), lambda s: s["c"])
    return v.groupBy(D, F.col("curve_id").alias("id")).agg(line.alias("line")).where("size(line) >= 2")


def rings(t: Topology, compat: bool = False) -> DataFrame:
    """surface_id, ring_idx and the closed ring of directed curves.

    A "-" member is walked backwards; every member after the first leaves out the point that it shares with the one before.  compat keeps
    those joints, as plain concatenation does.
    """
    m = t.ring_member.join(curve_lines(t).withColumnRenamed("id", "curve_id"), [D, "curve_id"])
    walked = F.when(F.col("orientation") == "-", F.reverse("line")).otherwise(F.col("line"))
    m = m.withColumn("walked", walked)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("member_idx", "walked"))), lambda s: s["walked"])
    r = m.groupBy(D, "surface_id", "surface_ord", "ring_idx").agg(parts.alias("parts"))
    joined = F.flatten("parts") if compat else F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p).otherwise(F.slice(p, F.lit(2), F.size(p) - 1))))
    r = r.withColumn("ring", joined)
    closed = F.when(F.get("ring", F.lit(0)) == F.get("ring", F.size("ring") - 1), F.col("ring")).otherwise(F.array_append("ring", F.get("ring", F.lit(0))))
    return r.select(D, "surface_id", "surface_ord", "ring_idx", closed.alias("ring"))


def polygons(t: Topology) -> DataFrame:
    """id and polygon (list of rings) of every surface."""
    poly = F.transform(F.array_sort(F.collect_list(F.struct("ring_idx", "ring"))), lambda s: s["ring"])
    return rings(t).groupBy(D, F.col("surface_id").alias("id")).agg(poly.alias("polygon"))


def shells(t: Topology) -> DataFrame:
    """solid_id, shell_idx and multipolygon of every shell; the rings of "-" faces are walked backwards."""
    f = t.shell_face.join(polygons(t).withColumnRenamed("id", "face_id"), [D, "face_id"])
    turned = F.when(F.col("orientation") == "-", F.transform("polygon", lambda r: F.reverse(r))).otherwise(F.col("polygon"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("face_idx", turned.alias("p")))), lambda s: s["p"])
    return f.groupBy(D, "solid_id", "shell_idx").agg(each.alias("multi"))


def solids(t: Topology) -> DataFrame:
    """id and multipolygon (of all shells) of every solid."""
    each = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shell_idx", "multi"))), lambda s: s["multi"]))
    return shells(t).groupBy(D, F.col("solid_id").alias("id")).agg(each.alias("multi"))


def geometries(t: Topology, mode: str = "points,edges,faces,solids") -> DataFrame:
    """All geometries whose kind occurs in mode."""
    shape = lambda df, kind, type_, c: df.select(D, "id", F.lit(kind).alias("kind"), F.lit(type_).alias("geom_type"), F.to_json(c).alias("coordinates"))
    parts = {
        "points": lambda: shape(t.point.where("x is not null"), "points", "Point", position()),
        "edges": lambda: shape(curve_lines(t), "edges", "LineString", F.col("line")),
        "faces": lambda: shape(polygons(t), "faces", "Polygon", F.col("polygon")),
        "solids": lambda: shape(solids(t), "solids", "MultiPolygon", F.col("multi")),
    }
    out = None
    for kind, made in parts.items():
        if kind in mode:
            out = made() if out is None else out.unionByName(made())
    if out is None:
        raise ValueError(f"no kind of geometry in mode {mode!r}")
    return out


def chained(lines: DataFrame) -> DataFrame:
    """dataset_id, ring_id and the chained ring of lines (dataset_id, ring_id, pos, line), in the order of pos."""
    segs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"])
    return lines.groupBy(D, "ring_id").agg(segs.alias("segs")).select(D, "ring_id", chain(F.col("segs")).alias("ring"))


def features(geometry: DataFrame) -> DataFrame:
    """GeoJSON features as text, one a row."""
    g = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"geometry":{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), F.col("coordinates"), F.lit('},"properties":{}}'))
    return geometry.select(D, "kind", "id", g.alias("feature"))


def reachable(t: Topology) -> DataFrame:
    """feature_id, kind and component_id: edges and points below every solid and surface."""
    edge = t.ring_member.select(D, F.col("surface_id").alias("feature_id"), F.col("curve_id").alias("component_id")).distinct()
    deep = t.solid_face.select(D, F.col("solid_id").alias("feature_id"), F.col("face_id").alias("f")).join(edge.withColumnRenamed("feature_id", "f"), [D, "f"]).drop("f")
    edge = edge.unionByName(deep).distinct()
    point = edge.join(t.curve_vertex.select(D, F.col("curve_id").alias("component_id"), "point_id"), [D, "component_id"]).select(D, "feature_id", F.col("point_id").alias("component_id")).distinct()
    return edge.withColumn("kind", F.lit("edges")).unionByName(point.withColumn("kind", F.lit("points")))


def collected(feature: DataFrame, number: int | None = None, context: str | None = None) -> DataFrame:
    """dataset_id and collection: one GeoJSON FeatureCollection a dataset, features in the order of kind and id.

    number: at most so many features of each dataset, points not counted.  context: a JSON value for @context.  Collections are texts of one
    dataset each, so a dataset must fit a row; larger ones are written as rows of features.
    """
    order = F.struct("kind", "id")
    if number is not None:
        w = Window.partitionBy(D).orderBy(F.when(F.col("kind") == "points", 0).otherwise(1), "kind", "id")
        rank = F.sum(F.when(F.col("kind") == "points", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        feature = feature.withColumn("_rank", rank).where((F.col("kind") == "points") | (F.col("_rank") <= number))
    each = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), "feature"))), lambda s: s["feature"])
    head = "" if context is None else f'"@context":{context},'
    return feature.groupBy(D).agg(F.concat(F.lit('{"type":"FeatureCollection",' + head + '"features":['), F.array_join(each, ","), F.lit("]}")).alias("collection"))


def mismatches(declared: DataFrame) -> DataFrame:
    """Rows (dataset_id, id, key, type) whose type is not that of their collection: a warning, as such features are resolved by their type."""
    return declared.where(F.concat(F.lower("type"), F.lit("s")) != F.lower("key"))


def representatives(point: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """dataset_id, id and to: the point that each point (id, ord, x, y, z) becomes where points less than the tolerance apart on every axis are one.

    In their order, a point becomes the first point before it that is near and stands for itself; without one it stands for itself.  Points of equal positions are one row
    first, so a popular position costs no pairs; near ones meet by a grid.  A point is decided once all near ones before it are, in rounds until all are.
    """
    p = point.where("x is not null and y is not null and z is not null").select(D, "id", "ord", "x", "y", "z")
    first = stored(p.groupBy(D, "x", "y", "z").agg(F.min(F.struct("ord", "id")).alias("f")).select(D, "x", "y", "z", "f.ord", F.col("f.id").alias("first")))
    boxes = first
    for c in "xyz":
        boxes = boxes.withColumn(f"{c}1", F.col(c) - 0.55 * tolerance).withColumn(f"{c}2", F.col(c) + 0.55 * tolerance)
    near = box_pairs(boxes, [D], ["first", *"xyz"], ["first", *"xyz"], 2 * tolerance)
    for c in "xyz":
        near = near.where(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) < tolerance)
    near = stored(near.select(D, F.col("a_first").alias("before"), F.col("a_ord").alias("at"), F.col("b_first").alias("first")))
    decided = [first.join(near.select(D, "first"), [D, "first"], "left_anti").select(D, "first", F.col("first").alias("to"))]
    wait = stored(near.select(D, "first").distinct())
    while not wait.isEmpty():
        known = reduce(DataFrame.unionByName, decided)
        told = near.join(wait, [D, "first"], "left_semi").join(known.select(D, F.col("first").alias("before"), (F.col("to") == F.col("first")).alias("own")), [D, "before"], "left")
        now = told.groupBy(D, "first").agg(F.bool_and(F.col("own").isNotNull()).alias("ready"), F.min_by("before", F.when(F.col("own"), F.col("at"))).alias("_to")).where("ready")
        now = stored(now.select(D, "first", F.coalesce("_to", "first").alias("to")))
        decided.append(now)
        wait = stored(wait.join(now, [D, "first"], "left_anti"))
    whole = first.join(reduce(DataFrame.unionByName, decided), [D, "first"]).select(D, "x", "y", "z", "to")
    return p.join(whole, [D, "x", "y", "z"]).select(D, "id", "to")


def cleaned(t: Topology, tolerance: float = 1e-9) -> Topology:
    """t without coincident geometry: near points become one (``representatives``), curves of the same points (either way round) and
    surfaces of the same curves become their first too; references follow, and a curve that was the other way round is walked the other way.
    """
    moved = stored(representatives(t.point, tolerance).withColumnRenamed("id", "point_id"))
    vertex = t.curve_vertex.join(moved, [D, "point_id"], "left").withColumn("point_id", F.coalesce("to", "point_id")).drop("to").select(*t.curve_vertex.columns)

    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "point_id"))), lambda s: s["point_id"])
    shape = vertex.groupBy(D, F.col("curve_id").alias("id")).agg(line.alias("v"), F.min("curve_ord").alias("ord"))
    shape = shape.withColumn("key", F.least("v", F.reverse("v"))).withColumn("turned", F.col("v") != F.col("key"))
    kept = shape.groupBy(D, "key").agg(F.min_by(F.struct("id", "turned"), "ord").alias("f"))
    curve = shape.join(kept, [D, "key"]).select(D, F.col("id").alias("curve_id"), F.col("f.id").alias("to"), (F.col("turned") != F.col("f.turned")).alias("flip"))
    other = F.when(F.col("orientation") == "-", "+").otherwise("-")
    member = t.ring_member.join(curve, [D, "curve_id"], "left").withColumn("curve_id", F.coalesce("to", "curve_id")).withColumn("orientation", F.when(F.col("flip"), other).otherwise(F.col("orientation"))).select(*t.ring_member.columns)

    ring = member.groupBy(D, F.col("surface_id").alias("id")).agg(F.array_sort(F.collect_set("curve_id")).alias("key"), F.min("surface_ord").alias("ord"))
    face = ring.join(ring.groupBy(D, "key").agg(F.min_by("id", "ord").alias("to")), [D, "key"]).select(D, F.col("id").alias("face_id"), "to")

    def faces(df: DataFrame) -> DataFrame:
        return df.join(face, [D, "face_id"], "left").withColumn("face_id", F.coalesce("to", "face_id")).select(*df.columns)

    solid_face = faces(t.solid_face).groupBy(D, "solid_id", "solid_ord", "face_id").agg(F.min("face_idx").alias("face_idx")).select(*t.solid_face.columns)
    gone = lambda df, m, key: df.join(m.where(F.col(key) != F.col("to")).select(D, F.col(key).alias("id")), [D, "id"], "left_anti")
    lost = lambda df, m, key: df.join(m.where(F.col(key) != F.col("to")).select(D, key), [D, key], "left_anti")
    return replace(
        t,
        point=gone(t.point, moved, "point_id"),
        curve=gone(t.curve, curve, "curve_id"),
        curve_vertex=lost(vertex, curve, "curve_id"),
        surface=gone(t.surface, face, "face_id"),
        ring_member=lost(member, face.withColumnRenamed("face_id", "surface_id"), "surface_id"),
        solid_face=solid_face,
        shell_face=faces(t.shell_face),
    )

"""Geometry of features that carry their topology inline: references to points, lines and polygons, joined level by level.

Known types are Polygon (rings of edges, chained, or rings that are one reference), AggregatePolygon (polygons by reference), LineString and Edge, MultiLineString,
and directed references (a polygon of one ring).  Flat references of any other type give a point or a line.  References without coordinates are left out;
features without any have no geometry and are no rows here (``unresolved`` lists them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import chain
from ..sources import csdm
from ..sources.csdm import D, every_feature, get, items, kind, number, text
from ..storage import dealt

KEY = [D, "ord", "id"]


def features(docs: DataFrame, collection: str) -> DataFrame:
    """``csdm.features`` of documents, or of the features that ``converted`` has taken from them."""
    return docs.where(F.col("collection") == collection).drop("collection") if "collection" in docs.columns else csdm.features(docs, collection)


def positions(docs: DataFrame) -> DataFrame:
    """dataset_id, id and c (array of numbers) of the documents' points; of repeated ids the last counts."""
    truthy = ~kind(get("f", "$.place")).isin("VOID", "OBJECT<>")
    source = F.when(truthy, get("f", "$.place")).otherwise(get("f", "$.geometry"))
    c = features(docs, "points").where("id is not null").withColumn("s", source)
    c = c.withColumn("c", F.transform(items("s", "$.coordinates"), lambda x: number(x))).where("size(c) > 0")
    return c.groupBy(D, "id").agg(F.max_by("c", "ord").alias("c"))


def _ordered(value: str, *by: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, value))), lambda s: s[value])


def references(docs: DataFrame, key: str) -> DataFrame:
    """dataset_id, ord, id, type, o and i (places in the outer and inner list), listed (whether the outer element is a list), ref, orientation of one collection's features."""
    f = features(docs, key).where("id is not null").withColumn("type", F.lower(F.coalesce(text("f", "$.topology.type"), F.lit(""))))
    plain = kind(get("f", "$.topology.references")) != "VOID"
    some = f.where(plain).select(*KEY, "type", F.posexplode(items("f", "$.topology.references")).alias("o", "r"))
    listed = kind(F.col("r")).startswith("ARRAY")
    some = some.select(*KEY, "type", "o", listed.alias("listed"), F.posexplode(F.when(listed, items("r", "$")).otherwise(F.array("r"))).alias("i", "x"))
    some = some.select(*KEY, "type", "o", "i", "listed", text("x").alias("ref"), F.lit("+").alias("orientation"))
    directed = f.where(~plain).select(*KEY, F.posexplode(items("f", "$.topology.directed_references")).alias("o", "r"))
    directed = directed.select(*KEY, F.lit(">").alias("type"), "o", F.lit(0).alias("i"), F.lit(False).alias("listed"), text("r", "$.ref").alias("ref"), F.coalesce(text("r", "$.orientation"), F.lit("+")).alias("orientation"))
    return some.unionByName(directed)


def resolved(docs: DataFrame, key: str, points: DataFrame, lines: DataFrame | None = None, polygons: DataFrame | None = None) -> DataFrame:
    """dataset_id, ord, id, geom_type, and what its type has of point, line, lines or rings, polygons.

    points: id, c.  lines: id, line.  polygons: id, rings.
    """
    spark = docs.sparkSession
    lines = spark.createDataFrame([], f"{D} string, id string, line array<array<double>>") if lines is None else lines
    polygons = spark.createDataFrame([], f"{D} string, id string, rings array<array<array<double>>>") if polygons is None else polygons
    refs = references(docs, key)
    to = lambda df, name: df.select(D, F.col("id").alias("ref"), name)
    at = refs.join(to(points, "c"), [D, "ref"], "left").join(to(lines, "line"), [D, "ref"], "left").withColumn("seg", F.coalesce("line", F.array("c")))
    at = at.where("c is not null or line is not null")
    none = lambda t: F.lit(None).cast(t)
    shape = {"point": "array<double>", "line": "array<array<double>>", "rings": "array<array<array<double>>>", "polygons": "array<array<array<array<double>>>>"}
    give = lambda df, name, **have: df.select(*KEY, F.lit(name).alias("geom_type") if isinstance(name, str) else name.alias("geom_type"), *[have.get(c, none(t)).alias(c) for c, t in shape.items()])

    flat = ~F.col("type").isin("polygon", "aggregatepolygon", "linestring", "edge", "multilinestring", ">")
    nested = refs.where(flat & F.col("listed")).select(*KEY).distinct()
    pts = at.where((flat | F.col("type").isin("linestring", "edge")) & F.col("c").isNotNull() & ~F.col("listed")).join(nested, KEY, "left_anti")
    pts = pts.groupBy(*KEY, "type").agg(_ordered("c", "o").alias("pts"))
    single = (F.size("pts") == 1) & flat
    parts = [give(pts.where(single | (F.size("pts") >= 2)), F.when(single, "Point").otherwise("LineString"), point=F.when(single, F.get("pts", F.lit(0))), line=F.when(~single, F.col("pts")))]

    many = at.where("type = 'multilinestring' and c is not null").groupBy(*KEY, "o").agg(_ordered("c", "i").alias("each")).where("size(each) >= 2")
    parts.append(give(many.groupBy(*KEY).agg(_ordered("each", "o").alias("all")), "MultiLineString", rings=F.col("all")))

    ring = at.where("type = 'polygon'").groupBy(*KEY, "o", "listed").agg(_ordered("seg", "i").alias("segs"))
    ring = ring.withColumn("ring", F.when(F.col("listed"), chain(F.col("segs"))).otherwise(F.get("segs", F.lit(0))))
    parts.append(give(ring.groupBy(*KEY).agg(_ordered("ring", "o").alias("all")), "Polygon", rings=F.col("all")))

    walked = at.where("type = '>'").withColumn("seg", F.when(F.col("orientation") == "-", F.reverse("seg")).otherwise(F.col("seg")))
    walked = walked.groupBy(*KEY).agg(_ordered("seg", "o").alias("segs"))
    joined = F.flatten(F.transform("segs", lambda s, i: F.when(i == 0, s).otherwise(F.slice(s, F.lit(2), F.size(s)))))
    parts.append(give(walked, "Polygon", rings=F.array(joined)))

    whole = refs.where("type = 'aggregatepolygon'").join(to(polygons, "rings"), [D, "ref"]).groupBy(*KEY).agg(_ordered("rings", "o", "i").alias("all"))
    parts.append(give(whole, "MultiPolygon", polygons=F.col("all")))
    return reduce(DataFrame.unionByName, parts)


def geometries(rows: DataFrame) -> DataFrame:
    """dataset_id, id, geom_type and coordinates (JSON) of resolved rows."""
    json = F.when(F.col("geom_type") == "Point", F.to_json("point")).when(F.col("geom_type") == "LineString", F.to_json("line")).when(F.col("geom_type") == "MultiPolygon", F.to_json("polygons")).otherwise(F.to_json("rings"))
    return rows.select(D, "id", "geom_type", json.alias("coordinates"))


def converted(docs: DataFrame, faces: str = "faces") -> DataFrame:
    """Geometries of a document's edges, then of its faces (or another collection) over them, then of what aggregates those.

    Documents are taken apart once, and each level is stored, as the next one refers to it.
    """
    docs = dealt(every_feature(docs, tuple(dict.fromkeys(("points", "edges", faces)))))
    points = dealt(positions(docs))
    edge = dealt(resolved(docs, "edges", points))
    lines = edge.where("geom_type = 'LineString'").select(D, "id", "line")
    face = dealt(resolved(docs, faces, points, lines))
    polygons = face.where("geom_type = 'Polygon'").select(D, "id", "rings")
    whole = resolved(docs, faces, points, lines, polygons).where("geom_type = 'MultiPolygon'")
    return geometries(edge).unionByName(geometries(face)).unionByName(geometries(whole))


def unresolved(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """dataset_id and id of the features of a collection without a geometry among found: each is a warning."""
    return features(docs, key).where("id is not null").select(D, "id").join(found.select(D, "id"), [D, "id"], "left_anti")

"""Features of JSON documents at any depth of lists and collections, with their geometry in longitude and latitude.

A feature's system is the nearest that is declared: its own, that of the nearest collection around it, or the document's.  What it
means is looked up by a join with the table of systems, so every row has a transform of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs
from ..storage import discard, stored
from .csdm import get, items, kind, text

D = "dataset_id"
#: Columns of a geometry: its coordinates by depth (position, line, rings, polygons).
SHAPE = {"point": "array<double>", "line": "array<array<double>>", "rings": "array<array<array<double>>>", "polygons": "array<array<array<array<double>>>>"}
#: The collections of a document, in the order that they build on each other.
LEVELS = ("edges", "rings", "faces", "shells", "solids")
KEYS = ("features", "points", *LEVELS)


def system_name(v: Column) -> Column:
    """The name of a declared system: a text, or the first of a list (horizontal before vertical); empty ones count as none."""
    return F.nullif(F.coalesce(text(v), text(F.get(items(v, "$"), F.lit(0)))), F.lit(""))


def values(docs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """dataset_id, key, at, v and crs (null) of the root's collections; a document that is a feature is its own list of features."""
    alone = F.coalesce(text("doc", "$.type") == "Feature", F.lit(False))
    each = [F.struct(F.lit(k).alias("key"), F.when(alone & F.lit(k == "features"), F.col("doc")).when(~alone, get("doc", f"$.{k}")).alias("v")) for k in keys]
    return docs.select(D, F.explode(F.array(*each)).alias("e")).where("e.v is not null").select(D, "e.key", F.lit("").alias("at"), "e.v", F.lit(None).cast("string").alias("crs"))


def walked(rows: DataFrame, strict: bool = True) -> DataFrame:
    """dataset_id, key, at (the place in its collection, for order), f and crs (of the nearest collection) of all features in rows (key, at, v, crs).

    Lists and collections are opened in rounds, one level of nesting each, until none is left.  Values that are no objects are given as they are.  An object that is
    neither a feature nor a collection raises an error, or is left out if not strict.
    """
    k, type_ = F.col("k"), F.col("t")
    wait, out = stored(rows.select(D, "key", "at", "v", "crs")), []
    while not wait.isEmpty():
        seen = wait.withColumn("k", kind("v")).withColumn("t", F.when(F.col("k").startswith("OBJECT"), F.coalesce(text("v", "$.type"), F.lit(""))))
        odd = F.coalesce(~type_.isin("Feature", "FeatureCollection"), F.lit(False))
        plain = ~k.startswith("ARRAY") & ~k.startswith("OBJECT") & (k != "VOID")
        f = F.when(odd, F.raise_error(F.concat(F.lit("unexpected type of a feature: "), type_)).cast("variant")).otherwise(F.col("v"))
        out.append(stored(seen.where((type_ == "Feature") | plain | (odd & F.lit(strict))).select(D, "key", "at", f.alias("f"), "crs")))
        inner = seen.where(k.startswith("ARRAY") | (type_ == "FeatureCollection")).select(D, "key", "at", F.coalesce(F.when(type_.isNotNull(), system_name(get("v", "$.coordRefSys"))), F.col("crs")).alias("crs"), F.posexplode(F.when(type_.isNull(), items("v", "$")).otherwise(items("v", "$.features"))).alias("i", "v"))
        wait, before = stored(inner.select(D, "key", F.concat("at", F.format_string(".%08d", "i")).alias("at"), "v", "crs")), wait
        discard(before)
    return reduce(DataFrame.unionByName, out) if out else wait.withColumnRenamed("v", "f")


def depth(coordinates: Column) -> Column:
    return (F.length(F.regexp_extract(kind(coordinates), "^(ARRAY<)*", 0)) / 6).cast("int")


def shape(geometry: Column, system: Column) -> list[Column]:
    """The columns of SHAPE for a geometry (VARIANT) in a system (null: in none)."""
    c = get(geometry, "$.coordinates")
    one = lambda p: crs.moved(p, system)
    change = [one, lambda x: F.transform(x, one), lambda x: F.transform(x, lambda y: F.transform(y, one)), lambda x: F.transform(x, lambda y: F.transform(y, lambda z: F.transform(z, one)))]
    return [F.when(depth(c) == n, go(F.try_variant_get(c, "$", t))).alias(name) for n, ((name, t), go) in enumerate(zip(SHAPE.items(), change, strict=True), 1)]


def coordinates() -> Column:
    """The JSON of whichever of SHAPE's columns there is."""
    return F.coalesce(*[F.to_json(c) for c in SHAPE])


def collection(geometry: Column, system: Column) -> Column:
    """The JSON of the geometries of a GeometryCollection; null for any other geometry."""
    part = lambda g: F.concat(F.lit('{"type":"'), text(g, "$.type"), F.lit('","coordinates":'), F.coalesce(*[F.to_json(c) for c in shape(g, system)]), F.lit("}"))
    all_ = F.transform(items(geometry, "$.geometries"), part)
    return F.when(text(geometry, "$.type") == "GeometryCollection", F.concat(F.lit("["), F.array_join(all_, ","), F.lit("]")))


def normalised(docs: DataFrame, keys: tuple[str, ...] = KEYS, strict: bool = True) -> DataFrame:
    """The features of documents (dataset_id, doc): dataset_id, key, at, id, f, geom_type, SHAPE's columns, geometries, native and system.

    A feature without a geometry has that of its ``place``, moved from the nearest declared system; one with a geometry keeps it, moved only where the document has the older
    declaration ``crs.properties.name``.  Systems that are not known leave coordinates as they are.  native: the position of a point before that, its place before its geometry,
    where the document's own system can be moved from; system is that system.
    """
    root = docs.select(D, F.coalesce(system_name(get("doc", "$.coordRefSys")), system_name(get("doc", "$.horizontalCRS"))).alias("root_crs"), F.nullif(text("doc", "$.crs.properties.name"), F.lit("")).alias("legacy"))
    rows = walked(values(docs, keys), strict).join(root, D)
    place, geometry = get("f", "$.place"), get("f", "$.geometry")
    there = kind(get(place, "$.coordinates")) != "VOID"
    rows = rows.withColumn("_own", kind(geometry) != "VOID").withColumn("_placed", there)
    by_place = ~F.col("_own") & F.col("_placed")
    rows = rows.withColumn("src", F.when(by_place, place).when(F.col("_own"), geometry))
    name = F.when(by_place, F.coalesce(system_name(get("f", "$.coordRefSys")), F.col("crs"), F.col("root_crs"))).when(F.col("_own"), F.col("legacy"))
    rows = rows.withColumn("_code", crs.code_of(name)).withColumn("_root", crs.code_of(F.col("root_crs")))
    known = crs.systems(docs.sparkSession)
    rows = rows.join(F.broadcast(known.withColumnRenamed("code", "_code").withColumnRenamed("system", "z")), "_code", "left")
    rows = rows.join(F.broadcast(known.withColumnRenamed("code", "_root")), "_root", "left")
    first = F.when(F.col("_placed"), place).otherwise(geometry)
    native = F.when(F.col("system").isNotNull() & (text(first, "$.type") == "Point"), F.try_variant_get(get(first, "$.coordinates"), "$", "array<double>"))
    return rows.select(D, "key", "at", text("f", "$.id").alias("id"), "f", text("src", "$.type").alias("geom_type"), *shape(F.col("src"), F.col("z")), collection(F.col("src"), F.col("z")).alias("geometries"), native.alias("native"), "system")

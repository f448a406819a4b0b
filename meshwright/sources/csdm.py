"""Survey documents in JSON (points, edges, rings, faces, shells, solids as feature collections) as a Topology.

Documents are VARIANT values, one row each.  Types are tested strictly: a value counts as text, number or list only if it is
one in the document.  Records that can't be read are left out here, as the checks of structure expect; of rings and
shells with one id the last counts; a feature's ``place`` comes before its ``geometry``.
"""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Topology
from ..storage import dealt

D = "dataset_id"
COLLECTIONS = ("points", "edges", "rings", "faces", "shells", "solids", "observedVectors", "vectorObservations")


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """dataset_id (the path) and doc of JSON files; a root that isn't an object raises on use."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias(D), F.parse_json("value").alias("doc"))
    return raw.withColumn("doc", F.when(kind("doc").startswith("OBJECT"), F.col("doc")).otherwise(F.raise_error(F.lit("the root of a document must be an object")).cast("variant")))


def from_strings(spark: SparkSession, docs: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(docs.items()), f"{D} string, json string").select(D, F.parse_json("json").alias("doc"))


def kind(v: str | Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def get(v: str | Column, path: str, as_: str = "variant") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, as_)


def text(v: str | Column, path: str = "$") -> Column:
    x = get(v, path)
    return F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))


def number(v: str | Column, path: str = "$") -> Column:
    x = get(v, path)
    return F.when(kind(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get(x, "$", "double"))


def items(v: str | Column, path: str) -> Column:
    """The elements of a list; of anything else none."""
    x = get(v, path)
    return F.when(kind(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def features(docs: DataFrame, collection: str) -> DataFrame:
    """dataset_id, ord and f of the features in all feature collections of one key."""
    each = docs.select(D, F.posexplode(items("doc", f"$.{collection}")).alias("i", "c"))
    each = each.select(D, "i", F.posexplode(items("c", "$.features")).alias("j", "f")).where(kind("f").startswith("OBJECT"))
    return each.select(D, (F.col("i").cast("long") * (1 << 32) + F.col("j")).alias("ord"), "f", text("f", "$.id").alias("id"))


def every_feature(docs: DataFrame, collections: tuple[str, ...] = COLLECTIONS) -> DataFrame:
    """dataset_id, collection, ord, f and id of the features in all feature collections of several keys: one pass over the documents."""
    keys = F.array(*[F.struct(F.lit(name).alias("collection"), items("doc", f"$.{name}").alias("all")) for name in collections])
    each = docs.select(D, F.explode(keys).alias("k")).select(D, "k.collection", F.posexplode("k.all").alias("i", "c"))
    each = each.select(D, "collection", "i", F.posexplode(items("c", "$.features")).alias("j", "f")).where(kind("f").startswith("OBJECT"))
    return each.select(D, "collection", (F.col("i").cast("long") * (1 << 32) + F.col("j")).alias("ord"), "f", text("f", "$.id").alias("id"))


def directed(path: str, drop_bad: bool) -> Column:
    """Directed references as structs ref and orientation (default +); other orientations are dropped, or read as +."""
    refs = F.transform(items("f", path), lambda m: F.struct(text(m, "$.ref").alias("ref"), kind(get(m, "$.orientation")).alias("k"), text(m, "$.orientation").alias("o")))
    refs = F.filter(refs, lambda m: m["ref"].isNotNull())
    good = lambda m: (m["k"] == "VOID") | F.coalesce(m["o"].isin("+", "-"), F.lit(False))
    if drop_bad:
        refs = F.filter(refs, good)
    return F.transform(refs, lambda m: F.struct(m["ref"].alias("ref"), F.when(good(m), F.coalesce(m["o"], F.lit("+"))).otherwise("+").alias("orientation")))


def load(docs: DataFrame) -> Topology:
    """The tables of all documents (dataset_id, doc), which are taken apart once: their features are stored, and every table reads those of its collections."""
    every = dealt(every_feature(docs))
    of_key = lambda name: every.where(F.col("collection") == name).drop("collection")
    truthy = ~kind(get("f", "$.place")).isin("VOID", "OBJECT<>")
    source = F.when(truthy, get("f", "$.place")).otherwise(get("f", "$.geometry"))
    point = of_key("points").withColumn("s", source).where("id is not null").where(kind(get("s", "$.coordinates")).startswith("ARRAY"))
    xyz = F.transform(items("s", "$.coordinates"), lambda c: number(c))
    point = point.withColumn("c", xyz).select(D, "id", "ord", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("xyz")], F.size("c").alias("n"))
    refs = F.transform(items("f", "$.topology.references"), lambda r: text(r))
    curve = of_key("edges").withColumn("v", refs).where("id is not null").where(F.forall("v", lambda r: r.isNotNull()))
    vertex = curve.select(D, F.col("id").alias("curve_id"), F.col("ord").alias("curve_ord"), F.posexplode("v").alias("pos", "point_id"))
    last = lambda df: df.groupBy(D, "id").agg(F.max_by("m", "ord").alias("m"))
    rings = last(of_key("rings").where("id is not null").withColumn("m", directed("$.topology.directed_references", True)))
    face = of_key("faces").where("id is not null").withColumn("m", directed("$.topology.directed_references", True))
    on_face = face.select(D, "id", "ord", F.posexplode("m").alias("pos", "r")).select(D, "id", "ord", "pos", F.col("r.ref").alias("ring"))
    on_face = on_face.join(rings.select(D, F.col("id").alias("ring"), "m"), [D, "ring"])
    listed = on_face.groupBy(D, "id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("rings"))
    member = listed.select(D, F.col("id").alias("surface_id"), F.col("ord").alias("surface_ord"), F.posexplode("rings").alias("ring_idx", "m"))
    member = member.select(D, "surface_id", "surface_ord", "ring_idx", F.posexplode("m").alias("member_idx", "e")).select(D, "surface_id", "surface_ord", "ring_idx", "member_idx", F.col("e.ref").alias("curve_id"), F.col("e.orientation").alias("orientation"))
    shells = last(of_key("shells").where("id is not null").withColumn("m", directed("$.topology.directed_references", False)))
    solid = of_key("solids").where("id is not null").withColumn("s", F.transform(items("f", "$.topology.shells"), lambda r: text(r, "$.ref")))
    p = lambda name: text("f", f"$.properties.{name}")
    floors = F.when(kind(get("f", "$.properties.levels")) != "VOID", items("f", "$.properties.levels")).otherwise(items("f", "$.properties.floors"))
    names = F.transform(floors, lambda x: text(x))
    level = F.when(F.exists(names, lambda x: x.isNull()), "").otherwise(F.array_join(names, "|"))
    rows = solid.select(D, "id", "ord", F.coalesce(number("f", "$.properties.volume"), F.lit(0.0)).alias("volume"), F.coalesce(p("theme"), F.lit("default")).alias("theme"), F.coalesce(p("parcel_type"), F.lit("primary")).alias("parcel_type"), p("parent_id").alias("parent_id"), p("servient_id").alias("servient_id"), F.lit(None).cast("string").alias("burdened_id"), p("host_id").alias("host_id"), level.alias("level"))
    of = solid.select(D, "id", "ord", F.posexplode("s").alias("raw", "shell")).join(shells.select(D, F.col("id").alias("shell"), "m"), [D, "shell"])
    of = of.groupBy(D, "id", "ord").agg(F.array_sort(F.collect_list(F.struct("raw", "m"))).alias("all"))
    of = of.select(D, F.col("id").alias("solid_id"), F.col("ord").alias("solid_ord"), F.posexplode("all").alias("shell_idx", "s"))
    of = of.select(D, "solid_id", "solid_ord", "shell_idx", F.when(F.col("s.raw") == 0, "outer").otherwise("inner").alias("shell_type"), F.posexplode("s.m").alias("k", "e"))
    # a face that a shell lists twice keeps both places and the last orientation
    of = of.select("*", F.col("e.ref").alias("face_id"), F.col("e.orientation").alias("o"))
    final = of.groupBy(D, "solid_id", "shell_idx", "face_id").agg(F.max_by("o", "k").alias("orientation"))
    of = of.join(final, [D, "solid_id", "shell_idx", "face_id"]).withColumn("face_idx", (F.col("shell_idx").cast("long") * (1 << 20) + F.col("k")).cast("int"))
    seen = of_key("observedVectors").select(D, text("f", "$.topology.ref").alias("ref"), F.lit("observedVectors").alias("source"))
    more = of_key("vectorObservations").select(D, F.explode(items("f", "$.topology.directed_references")).alias("r")).select(D, text("r", "$.ref").alias("ref"), F.lit("vectorObservations").alias("source"))
    return Topology(
        point=point,
        curve=curve.select(D, "id", "ord", F.size("v").cast("long").alias("n_vertices")),
        curve_vertex=vertex,
        surface=face.select(D, "id", "ord"),
        ring_member=member,
        solid=rows,
        solid_face=of.select(D, "solid_id", "solid_ord", "face_idx", "face_id"),
        shell_face=of.select(D, "solid_id", "solid_ord", "shell_idx", "shell_type", "face_idx", "face_id", "orientation"),
        observation_curve=seen.unionByName(more).where("ref is not null"),
    )


def merged(first: Topology, second: Topology) -> Topology:
    """Both, by dataset: of records with one id the second's counts, whole and in the place of the first's; others of the second come after.

    What belongs to a record (a curve's vertices, a surface's rings, a solid's faces) goes with it, even where the second's is empty.
    """
    owners = {"point": "point", "curve": "curve", "curve_vertex": "curve", "surface": "surface", "ring_member": "surface", "solid": "solid", "solid_face": "solid", "shell_face": "solid"}
    places = {}
    for name in ("point", "curve", "surface", "solid"):
        a, b = getattr(first, name).select(D, "id", "ord"), getattr(second, name).select(D, "id", "ord")
        last = a.groupBy(D).agg(F.max("ord").alias("last"))
        places[name] = b.join(a.select(D, "id", F.col("ord").alias("old")), [D, "id"], "left").join(last, D, "left").select(D, "id", F.coalesce("old", F.col("ord") + F.coalesce("last", F.lit(-1)) + 1).alias("_place"))
    out = {}
    for f in fields(Topology):
        a, b = getattr(first, f.name), getattr(second, f.name)
        owner = owners.get(f.name)
        if owner is None:
            out[f.name] = a.unionByName(b, allowMissingColumns=True).dropDuplicates([D, "ref", "source"])
            continue
        key, ord_ = ("id", "ord") if f.name == owner else (f"{owner}_id", f"{owner}_ord")
        place = places[owner].withColumnRenamed("id", key)
        moved = b.join(place, [D, key])
        moved = moved.withColumn(ord_, F.col("_place")) if ord_ in b.columns else moved
        out[f.name] = a.join(place.select(D, key), [D, key], "left_anti").unionByName(moved.drop("_place").select(*b.columns), allowMissingColumns=True)
    return replace(first, **out)

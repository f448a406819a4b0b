"""Models in their raw form (points, curves, surfaces, solids, observation curves with ids in place) as a Topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Topology
from .csdm import D, get, items, kind, number, text


def records(docs: DataFrame, name: str) -> DataFrame:
    """dataset_id, id, ord and v of a collection's records."""
    rows = docs.select(D, F.posexplode(items("doc", f"$.{name}")).alias("ord", "v"))
    return rows.select(D, text("v", "$.id").alias("id"), F.col("ord").cast("long").alias("ord"), "v").where("id is not null")


def load(docs: DataFrame) -> Topology:
    """The tables of documents (dataset_id, doc) without faults of structure (``plans.structure`` finds those).

    A solid with shells has their faces, one without its own list; of a face's orientations in a shell the stated one counts, or +.  Missing volumes are 0, themes ``default``, types ``primary``.
    """
    p = records(docs, "points").withColumn("c", F.transform(items("v", "$.coordinates"), lambda x: number(x)))
    curve = records(docs, "curves").withColumn("v", F.transform(items("v", "$.vertices"), lambda x: text(x)))
    ring = records(docs, "surfaces").select(D, F.col("id").alias("surface_id"), F.col("ord").alias("surface_ord"), F.posexplode(items("v", "$.rings")).alias("ring_idx", "r"))
    member = ring.select(D, "surface_id", "surface_ord", "ring_idx", F.posexplode(items("r", "$.members")).alias("member_idx", "m"))
    solid = records(docs, "solids")
    own = lambda name: text("v", f"$.{name}")
    levels = F.transform(items("v", "$.levels"), lambda x: text(x))
    rows = solid.select(D, "id", "ord", F.coalesce(number("v", "$.volume"), F.lit(0.0)).alias("volume"), F.coalesce(own("theme"), F.lit("default")).alias("theme"), F.coalesce(own("parcel_type"), F.lit("primary")).alias("parcel_type"), *[own(c).alias(c) for c in ("parent_id", "servient_id", "burdened_id", "host_id")], F.array_join(levels, "|").alias("level"))
    shells = solid.select(D, F.col("id").alias("solid_id"), F.col("ord").alias("solid_ord"), F.posexplode(F.when(F.size(items("v", "$.shells")) > 0, items("v", "$.shells")).otherwise(F.array("v"))).alias("shell_idx", "s"))
    face = shells.select(D, "solid_id", "solid_ord", "shell_idx", F.coalesce(text("s", "$.type"), F.lit("outer")).alias("shell_type"), "s", F.posexplode(items("s", "$.faces")).alias("k", "f"))
    ways = F.try_variant_get(get("s", "$.face_orientations"), "$", "map<string,string>")
    face = face.withColumn("face_id", text("f")).withColumn("orientation", F.coalesce(F.when(kind(get("s", "$.face_orientations")).startswith("OBJECT"), F.try_element_at(ways, F.col("face_id"))), F.lit("+"))).withColumn("face_idx", (F.col("shell_idx").cast("long") * (1 << 20) + F.col("k")).cast("int"))
    # which shell is the first does not matter to the list of faces that a solid states beside its shells
    stated = solid.where(F.size(items("v", "$.faces")) > 0).select(D, F.col("id").alias("solid_id"), F.col("ord").alias("solid_ord"), F.posexplode(items("v", "$.faces")).alias("face_idx", "f")).select(D, "solid_id", "solid_ord", "face_idx", text("f").alias("face_id"))
    listed = face.join(stated.select(D, "solid_id").distinct(), [D, "solid_id"], "left_anti").select(D, "solid_id", "solid_ord", "face_idx", "face_id")
    seen = docs.select(D, F.explode(items("doc", "$.observation_curves")).alias("o")).select(D, text("o", "$.ref").alias("ref"), text("o", "$.source").alias("source"))
    return Topology(
        point=p.select(D, "id", "ord", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("xyz")], F.size("c").alias("n")),
        curve=curve.select(D, "id", "ord", F.size("v").cast("long").alias("n_vertices")),
        curve_vertex=curve.select(D, F.col("id").alias("curve_id"), F.col("ord").alias("curve_ord"), F.posexplode("v").alias("pos", "point_id")),
        surface=records(docs, "surfaces").select(D, "id", "ord"),
        ring_member=member.select(D, "surface_id", "surface_ord", "ring_idx", "member_idx", text("m", "$.ref").alias("curve_id"), F.coalesce(text("m", "$.orientation"), F.lit("+")).alias("orientation")),
        solid=rows,
        solid_face=stated.unionByName(listed),
        shell_face=face.select(D, "solid_id", "solid_ord", "shell_idx", "shell_type", "face_idx", "face_id", "orientation"),
        observation_curve=seen.where("ref is not null"),
    )

"""Tables that several rules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Topology

D = "dataset_id"
XYZ = ("x", "y", "z")


def located(t: Topology) -> DataFrame:
    """Curve vertices with their points' coordinates (null: unknown point)."""
    p = t.point.select(D, F.col("id").alias("point_id"), *XYZ)
    return t.curve_vertex.join(p, [D, "point_id"], "left")


def segments(t: Topology, dense: bool = False) -> DataFrame:
    """Consecutive vertices of each curve: seg_idx, a_id, b_id, ax … bz.

    dense: unknown points are left out before segments are formed; else segments with an unknown end are left out and the others
    keep their places.
    """
    v = located(t)
    if dense:
        v = v.where("x is not null").withColumn("pos", F.row_number().over(Window.partitionBy(D, "curve_id").orderBy("pos")) - 1)
    w = Window.partitionBy(D, "curve_id").orderBy("pos")
    ahead = F.lead(F.struct("point_id", *XYZ)).over(w)
    s = v.withColumn("n", ahead).where("n is not null")
    s = s.select(D, "curve_id", "curve_ord", F.col("pos").alias("seg_idx"), F.col("point_id").alias("a_id"), F.col("n.point_id").alias("b_id"), *[F.col(c).alias(f"a{c}") for c in XYZ], *[F.col(f"n.{c}").alias(f"b{c}") for c in XYZ])
    return s.where("ax is not null and bx is not null")


def curve_ends(t: Topology) -> DataFrame:
    """First and last vertex of each curve that has vertices."""
    return t.curve_vertex.groupBy(D, "curve_id").agg(F.min_by("point_id", "pos").alias("first_id"), F.max_by("point_id", "pos").alias("last_id"))


def solid_boxes(t: Topology) -> DataFrame:
    """Bounding box of every solid with at least one known vertex."""
    at = located(t).where("x is not null").groupBy(D, "curve_id").agg(*[f(c).alias(f"{c}{i}") for c in XYZ for f, i in ((F.min, 1), (F.max, 2))])
    faces = t.ring_member.join(at, [D, "curve_id"]).groupBy(D, F.col("surface_id").alias("face_id")).agg(*[f(f"{c}{i}").alias(f"{c}{i}") for c in XYZ for f, i in ((F.min, 1), (F.max, 2))])
    return t.solid_face.join(faces, [D, "face_id"]).groupBy(D, "solid_id").agg(*[f(f"{c}{i}").alias(f"{c}{i}") for c in XYZ for f, i in ((F.min, 1), (F.max, 2))])


def ring_coordinates(t: Topology) -> DataFrame:
    """Per ring its vertices in order (each member without its directed last one; unknown curves and points are skipped)."""
    v = located(t)
    last = F.max("pos").over(Window.partitionBy(D, "curve_id"))
    v = v.withColumn("last", last).where("x is not null").select(D, "curve_id", "pos", "last", *XYZ)
    m = t.ring_member.join(v, [D, "curve_id"])
    m = m.withColumn("at", F.when(F.col("orientation") == "-", F.col("last") - F.col("pos")).otherwise(F.col("pos"))).where("at < last")
    ring = F.array_sort(F.collect_list(F.struct("member_idx", "at", *XYZ)))
    return m.groupBy(D, "surface_id", "ring_idx").agg(ring.alias("ring"))

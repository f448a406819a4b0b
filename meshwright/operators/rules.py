"""The twenty-five topology rules: each a function from a Topology to a table of issues.

Issues: dataset_id, rule, code, severity, object_id, detail (the facts beside the object, as text with ``|`` between them).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import cross, distance, dot, fan_volume, inside_both
from ..model import Tolerances, Topology
from ..plans.derive import XYZ, D, curve_ends, located, ring_coordinates, segments, solid_boxes
from ..storage import stored
from .spatial import SMALL, box_pairs, group_pairs

RULES: dict[str, tuple[str, str, Callable]] = {}
#: Conformance classes by number, as reports name them (fixed values).
CLASSES = {1: "Points", 2: "Curves", 3: "Surfaces", 4: "Shells", 5: "Solids", 6: "Relationships", 7: "Containment"}


def rule(number: int, group: int, name: str) -> Callable:
    def keep(f: Callable) -> Callable:
        RULES[f"TR-{number:02d}"] = (name, f"CC-{group:02d}", f)
        return f

    return keep


def issues(df: DataFrame, number: int, code: str | Column, object_id: str, *detail: str | Column) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    text = F.concat_ws("|", *[F.coalesce((F.col(d) if isinstance(d, str) else d).cast("string"), F.lit("")) for d in detail]) if detail else F.lit("")
    return df.select(D, F.lit(f"TR-{number:02d}").alias("rule"), code.alias("code"), F.lit("error").alias("severity"), F.col(object_id).alias("object_id"), text.alias("detail"))


def number_text(value: str | Column) -> Column:
    """A double as SQL engines and JSON libraries write it: without an exponent from 1e-4 up to 1e16, else with a small e, its sign and two digits at least."""
    value = F.col(value) if isinstance(value, str) else value
    text = value.cast("string")
    plain = F.regexp_replace(value.try_cast("decimal(38,21)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    exponent = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return F.when(~text.contains("E"), text).when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e16), plain).otherwise(F.concat(mantissa, exponent))


def crossed(pairs: DataFrame) -> DataFrame:
    """Pairs of segments (a_ax … a_bz, b_ax … b_bz) that properly cross (``geometry.properly_cross`` says when).

    Every step has columns of its own, and the last a row number that the filter reads: that keeps the optimizer from moving it, with all steps written out,
    into the join's condition, where the pair loop grows beyond what the JVM compiles.
    """
    c = F.col
    minus = lambda to, of, name: {f"_{name}{x}": c(f"{to}{x}") - c(f"{of}{x}") for x in XYZ}
    vector = lambda name: tuple(c(f"_{name}{x}") for x in XYZ)
    named = lambda name, v: {f"_{name}{x}": e for x, e in zip(XYZ, v, strict=True)}
    kept = pairs.columns
    pairs = pairs.withColumns(minus("a_b", "a_a", "d") | minus("b_b", "b_a", "e") | minus("b_a", "a_a", "r"))
    d, e, r, n = map(vector, "dern")
    pairs = pairs.withColumns(named("n", cross(d, e)) | named("u", cross(r, e)) | named("v", cross(r, d)))
    pairs = pairs.withColumns({"_q": dot(n, n), "_rn": dot(r, n), "_t": dot(vector("u"), n), "_s": dot(vector("v"), n)})
    pairs = pairs.withColumn("_hit", inside_both(c("_q"), c("_rn"), c("_t"), c("_s"))).withColumn("_row", F.monotonically_increasing_id())
    return pairs.where("_hit and _row >= 0").select(kept)


SEGMENT = [f"{e}{c}" for e in "ab" for c in XYZ]


def boxed(s: DataFrame, pad: float = 1e-6) -> DataFrame:
    for c in XYZ:
        s = s.withColumn(f"{c}1", F.least(f"a{c}", f"b{c}") - pad).withColumn(f"{c}2", F.greatest(f"a{c}", f"b{c}") + pad)
    return s


def long_groups(t: Topology, members: DataFrame, *keys: str) -> DataFrame:
    """Keys of the groups of members (of n curves, one if there is no such column) that may have over SMALL segments, were each curve as long as the longest."""
    longest = t.curve_vertex.agg(F.max("pos")).first()[0] or 0
    n = F.col("n") if "n" in members.columns else F.lit(1)
    return members.groupBy(D, *keys).agg(F.sum(n).alias("_n")).where(F.col("_n") * longest > SMALL).select(D, *keys)


@rule(1, 1, "Unique points")
def duplicate_points(t: Topology, tol: Tolerances) -> DataFrame:
    boxes = t.point.where("x is not null")
    for c in XYZ:
        boxes = boxes.withColumn(f"{c}1", F.col(c) - 2 * tol.point).withColumn(f"{c}2", F.col(c) + 2 * tol.point)
    if tol.point <= 0:
        boxes = boxes.where("false")
    pairs = box_pairs(boxes, [D], ["id", *XYZ], ["id", *XYZ], 4 * tol.point)
    d = distance(*[tuple(F.col(f"{s}_{c}") for c in XYZ) for s in "ab"])
    return issues(pairs.where(d < tol.point), 1, "DUPLICATE_POINT_PROXIMITY", "a_id", "b_id")


@rule(11, 1, "Point fabric consistency")
def unknown_points(t: Topology, tol: Tolerances) -> DataFrame:
    lost = t.curve_vertex.join(t.point.select(D, F.col("id").alias("point_id")), [D, "point_id"], "left_anti")
    return issues(lost, 11, "UNKNOWN_POINT_REFERENCE", "curve_id", "point_id")


@rule(2, 2, "Curve self-intersection")
def curve_self_intersection(t: Topology, tol: Tolerances) -> DataFrame:
    # the few curves come first: segments of all of them take a sort of every vertex
    long = t.dealt(stored(t.curve.where("n_vertices >= 4").select(D, F.col("id").alias("curve_id"), "n_vertices")), "shuffle_hash")
    s = boxed(segments(replace(t, curve_vertex=t.curve_vertex.join(long, [D, "curve_id"], "left_semi")), dense=True)).withColumn("ord", F.col("seg_idx"))
    pairs = crossed(group_pairs(s, [D, "curve_id"], SEGMENT, SEGMENT, F.col("b_ord") >= F.col("a_ord") + 2, long.where(F.col("n_vertices") > SMALL).select(D, "curve_id").distinct()))
    first = pairs.groupBy(D, "curve_id").agg(F.min(F.struct("a_ord", "b_ord")).alias("m"))
    return issues(first, 2, "CURVE_SELF_INTERSECTION", "curve_id", "m.a_ord", "m.b_ord")


@rule(3, 2, "No dangling curves")
def dangling_curves(t: Topology, tol: Tolerances) -> DataFrame:
    used = t.ring_member.select(D, F.col("curve_id").alias("id")).unionByName(t.observation_curve.select(D, F.col("ref").alias("id")))
    return issues(t.curve.join(used, [D, "id"], "left_anti"), 3, "DANGLING_CURVE", "id")


@rule(12, 2, "Minimum curve length")
def short_curves(t: Topology, tol: Tolerances) -> DataFrame:
    # a curve of known points is no shorter than its box; only the others are measured, which takes a sort of their vertices
    side = [F.max(c) - F.min(c) >= tol.length * (1 + 1e-6) for c in XYZ]
    whole = (F.count(F.lit(1)) >= 2) & (F.count("x") == F.count(F.lit(1)))
    long = located(t).groupBy(D, F.col("curve_id").alias("id")).agg((whole & (side[0] | side[1] | side[2])).alias("_long"))
    # no anti-join: it would be done for each part that the curves are put together from
    few = t.dealt(stored(t.curve.join(long, [D, "id"], "left").where(~F.coalesce("_long", F.lit(False))).drop("_long")), "shuffle_hash")
    t = replace(t, curve=few, curve_vertex=t.curve_vertex.join(few.select(D, F.col("id").alias("curve_id")), [D, "curve_id"], "left_semi"))
    a, b = (tuple(F.col(f"{e}{c}") for c in XYZ) for e in "ab")
    length = segments(t).groupBy(D, F.col("curve_id").alias("id")).agg(F.sum(distance(a, b)).alias("length"))
    short = t.curve.join(length, [D, "id"], "left").where(F.coalesce("length", F.lit(0.0)) < tol.length)
    return issues(short, 12, "CURVE_BELOW_MINIMUM_LENGTH", "id", number_text(F.round(F.coalesce("length", F.lit(0.0)), 6)))


@rule(13, 2, "No duplicate curves")
def duplicate_curves(t: Topology, tol: Tolerances) -> DataFrame:
    h, vertices = F.xxhash64("point_id"), t.curve_vertex.withColumnRenamed("curve_id", "id")
    signs = vertices.groupBy(D, "id").agg(F.count(F.lit(1)).alias("s_0"), F.min(h).alias("s_1"), F.max(h).alias("s_2"), F.bit_xor(h).alias("s_3"))
    few = t.dealt(stored(alike(t.curve, signs)), "shuffle_hash")
    v = vertices.join(few, [D, "id"], "left_semi").groupBy(D, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "point_id"))), lambda s: s["point_id"]).alias("v"))
    c = few.join(v, [D, "id"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<string>")))
    return issues(repeats(stored(c.withColumn("key", F.least("v", F.reverse("v"))))), 13, "DUPLICATE_CURVE", "id", "first_id")


def alike(objects: DataFrame, signs: DataFrame) -> DataFrame:
    """Objects (id, ord) of which another in the dataset has the same signs, or that have none: all that may be equal, and few others.

    signs: per id, numbers (s_…) that are equal where the objects are.  They are summed up without a sort, unlike lists or sets of texts, which then are made of few objects.
    """
    names = [c for c in signs.columns if c.startswith("s_")]
    every = objects.select(D, "id", "ord").join(signs, [D, "id"], "left").na.fill(0, names)
    more = every.groupBy(D, *names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(D, *names).hint("shuffle_hash")
    return every.join(more, [D, *names], "left_semi").select(D, "id", "ord")


def repeats(df: DataFrame) -> DataFrame:
    """Rows (id, ord, key) after the first of their key, with first_id.

    The key's first row comes by a join with the keys that occur more than once, on the key and a salt, so that the rows of a hot
    key (all empty ones share one) are spread over tasks.
    """
    salts = 32
    df = df.select(D, "id", "ord", "key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    first = df.groupBy(D, "key").agg(F.min(F.struct("ord", "id")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(D, "key", "f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return df.join(first, [D, "key", "salt"]).where("ord > f.ord").withColumn("first_id", F.col("f.id"))


@rule(14, 2, "Curves meet at nodes only")
def curve_crossings(t: Topology, tol: Tolerances) -> DataFrame:
    s = stored(boxed(segments(t)).withColumn("ord", F.col("curve_ord")))
    cols = ["curve_id", "a_id", "b_id", *SEGMENT]
    pairs = box_pairs(s, [D], cols, cols, deal=t.dealt)
    apart = (F.col("a_a_id") != F.col("b_a_id")) & (F.col("a_a_id") != F.col("b_b_id")) & (F.col("a_b_id") != F.col("b_a_id")) & (F.col("a_b_id") != F.col("b_b_id"))
    hit = crossed(pairs.where((F.col("a_curve_id") != F.col("b_curve_id")) & apart)).select(D, "a_curve_id", "b_curve_id").distinct()
    return issues(hit, 14, "CURVE_INTERSECTION_NOT_AT_NODE", "a_curve_id", "b_curve_id")


@rule(22, 2, "No repeated curves in rings")
def repeated_curves(t: Topology, tol: Tolerances) -> DataFrame:
    w = Window.partitionBy(D, "surface_id", "ring_idx", "curve_id")
    m = t.ring_member.withColumn("first", F.min("member_idx").over(w)).where("member_idx > first")
    return issues(m, 22, "CURVE_REPEATED_IN_RING", "surface_id", "ring_idx", "curve_id", "first", "member_idx")


def directed(t: Topology) -> DataFrame:
    """Ring members with start_id and end_id in their direction (null: unknown curve or one without vertices)."""
    m = t.ring_member.join(curve_ends(t), [D, "curve_id"], "left")
    back = F.col("orientation") == "-"
    return m.withColumn("start_id", F.when(back, F.col("last_id")).otherwise(F.col("first_id"))).withColumn("end_id", F.when(back, F.col("first_id")).otherwise(F.col("last_id")))


def ring_window(*keys: str):
    """A window by dataset and keys, sorted by a number made of them first: rows are then told apart by it, and long texts of the same start need seldom be compared."""
    return Window.partitionBy(F.xxhash64(*keys), D, *keys)


@rule(4, 3, "Closed surface rings")
def open_rings(t: Topology, tol: Tolerances) -> DataFrame:
    w = ring_window("surface_id", "ring_idx").orderBy("member_idx")
    m = directed(t).withColumn("me", F.struct("start_id"))
    m = m.withColumn("next", F.coalesce(F.lead("me").over(w), F.first("me").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    bad = m.where("end_id <> next.start_id").groupBy(D, "surface_id", "ring_idx").agg(F.min(F.struct("member_idx", "curve_id")).alias("f"))
    return issues(bad, 4, "SURFACE_RING_NOT_CLOSED", "surface_id", "ring_idx", "f.member_idx", "f.curve_id")


@rule(5, 3, "Shared edges in both directions")
def same_orientation(t: Topology, tol: Tolerances) -> DataFrame:
    g = t.ring_member.groupBy(D, "curve_id").agg(F.count(F.lit(1)).alias("n"), F.min("orientation").alias("lo"), F.max("orientation").alias("hi"))
    return issues(g.where("n >= 2 and lo = hi"), 5, "SHARED_EDGE_SAME_ORIENTATION", "curve_id", "lo", "n")


@rule(15, 3, "Surface self-intersection")
def ring_self_intersection(t: Topology, tol: Tolerances) -> DataFrame:
    n = t.curve_vertex.groupBy(D, "curve_id").agg(F.max("pos").alias("k"))
    w = Window.partitionBy(D, "surface_id", "ring_idx").orderBy("member_idx")
    m = t.ring_member.join(n, [D, "curve_id"]).withColumn("before", F.sum("k").over(w) - F.col("k"))
    m = m.withColumn("total", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = boxed(segments(t).join(m.select(D, "curve_id", "surface_id", "ring_idx", "before", "total"), [D, "curve_id"])).withColumn("ord", F.col("before") + F.col("seg_idx"))
    cols = ["a_id", "b_id", "total", *SEGMENT]
    apart = (F.col("a_a_id") != F.col("b_a_id")) & (F.col("a_a_id") != F.col("b_b_id")) & (F.col("a_b_id") != F.col("b_a_id")) & (F.col("a_b_id") != F.col("b_b_id"))
    closing = (F.col("a_ord") == 0) & (F.col("b_ord") == F.col("a_total") - 1)
    p = crossed(group_pairs(s, [D, "surface_id", "ring_idx"], cols, cols, (F.col("b_ord") >= F.col("a_ord") + 2) & ~closing & apart, long_groups(t, t.ring_member, "surface_id", "ring_idx")))
    first = p.groupBy(D, "surface_id", "ring_idx").agg(F.min(F.struct("a_ord", "b_ord")).alias("m"))
    return issues(first, 15, "SURFACE_SELF_INTERSECTION", "surface_id", "ring_idx", "m.a_ord", "m.b_ord")


@rule(16, 3, "No duplicate surfaces")
def duplicate_surfaces(t: Topology, tol: Tolerances) -> DataFrame:
    h, members = F.xxhash64("curve_id"), t.ring_member.withColumnRenamed("surface_id", "id")
    # a set's numbers: they don't change with how often a curve occurs
    signs = members.groupBy(D, "id").agg(F.min(h).alias("s_0"), F.max(h).alias("s_1"), F.bit_or(h).alias("s_2"), F.bit_and(h).alias("s_3"))
    few = t.dealt(stored(alike(t.surface, signs)), "shuffle_hash")
    key = members.join(few, [D, "id"], "left_semi").groupBy(D, "id").agg(F.array_sort(F.collect_set("curve_id")).alias("key"))
    s = few.join(key, [D, "id"], "left").withColumn("key", F.coalesce("key", F.array().cast("array<string>")))
    return issues(repeats(stored(s)), 16, "DUPLICATE_SURFACE", "id", "first_id")


@rule(17, 3, "Surface-curve consistency")
def unknown_curves(t: Topology, tol: Tolerances) -> DataFrame:
    lost = t.ring_member.join(t.curve.select(D, F.col("id").alias("curve_id")), [D, "curve_id"], "left_anti")
    return issues(lost, 17, "UNKNOWN_CURVE_REFERENCE", "surface_id", "ring_idx", "member_idx", "curve_id")


@rule(23, 3, "Connected surface interior")
def repeated_vertices(t: Topology, tol: Tolerances) -> DataFrame:
    w = ring_window("surface_id", "ring_idx", "start_id")
    m = directed(t).where("start_id is not null").withColumn("first", F.min("member_idx").over(w)).where("member_idx > first")
    return issues(m, 23, "SURFACE_RING_REPEATED_VERTEX", "surface_id", "ring_idx", "start_id", "first", "member_idx")


@rule(6, 4, "Closed solids")
def open_shells(t: Topology, tol: Tolerances) -> DataFrame:
    m = t.solid_face.join(t.ring_member.withColumnRenamed("surface_id", "face_id"), [D, "face_id"])
    place = F.struct("face_idx", "ring_idx", "member_idx")
    c = m.groupBy(D, "solid_id", "curve_id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).where("n <> 2")
    g = c.groupBy(D, "solid_id").agg(F.count(F.lit(1)).alias("open"), F.array_sort(F.collect_list(F.struct("at", "curve_id"))).alias("all"))
    sample = F.array_join(F.transform(F.slice("all", 1, 10), lambda s: s["curve_id"]), ",")
    return issues(g, 6, "OPEN_SOLID_SHELL", "solid_id", "open", sample)


@rule(18, 4, "No dangling faces")
def dangling_faces(t: Topology, tol: Tolerances) -> DataFrame:
    return issues(t.surface.join(t.solid_face.select(D, F.col("face_id").alias("id")), [D, "id"], "left_anti"), 18, "DANGLING_FACE", "id")


@rule(7, 5, "Positive volume")
def no_volume(t: Topology, tol: Tolerances) -> DataFrame:
    return issues(t.solid.where(F.col("volume") <= tol.volume), 7, "ZERO_OR_NEGATIVE_VOLUME", "id", number_text("volume"))


@rule(19, 5, "Minimum solid thickness")
def thin_solids(t: Topology, tol: Tolerances) -> DataFrame:
    thin = F.concat_ws(",", *[F.when(F.col(f"{c}2") - F.col(f"{c}1") < tol.thickness, F.lit(c)) for c in XYZ])
    return issues(solid_boxes(t).withColumn("thin", thin).where("thin <> ''"), 19, "SOLID_BELOW_MINIMUM_THICKNESS", "solid_id", "thin")


@rule(24, 5, "Solid self-intersection")
def solid_self_intersection(t: Topology, tol: Tolerances) -> DataFrame:
    m = t.solid_face.join(t.ring_member.withColumnRenamed("surface_id", "face_id"), [D, "face_id"])
    sides = t.ring_member.groupBy(D, F.col("surface_id").alias("face_id")).agg(F.count(F.lit(1)).alias("n"))
    faces = t.solid_face.join(sides, [D, "face_id"])
    # segments of one face are not compared, so the face alone orders a pair
    s = boxed(m.join(segments(t), [D, "curve_id"])).withColumn("ord", F.col("face_idx"))
    place = ["face_idx", "ring_idx", "member_idx", "seg_idx"]
    p = crossed(group_pairs(s, [D, "solid_id"], [*place, *SEGMENT], [*place, *SEGMENT], F.col("a_face_idx") != F.col("b_face_idx"), long_groups(t, faces, "solid_id")))
    at = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in place])
    first = p.groupBy(D, "solid_id").agg(F.min(F.struct(at("a").alias("a_ord"), at("b").alias("b_ord"))).alias("m"))
    return issues(first, 24, "SOLID_SELF_INTERSECTION", "solid_id", "m.a_ord.face_idx", "m.b_ord.face_idx")


def shell_volumes(t: Topology) -> DataFrame:
    """Signed volume of every shell: the rings of its faces in order, those of "-" faces reversed."""
    r = ring_coordinates(t)
    f = t.shell_face.join(r.withColumnRenamed("surface_id", "face_id"), [D, "face_id"])
    ring = F.when(F.col("orientation") == "-", F.reverse("ring")).otherwise(F.col("ring"))
    f = f.withColumn("six", fan_volume(ring))
    parts = F.array_sort(F.collect_list(F.struct("face_idx", "ring_idx", "six")))
    g = f.groupBy(D, "solid_id", "shell_idx", "shell_type").agg(parts.alias("parts"))
    return g.withColumn("volume", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["six"]) / 6.0)


@rule(25, 5, "Shell orientation")
def reversed_shells(t: Topology, tol: Tolerances) -> DataFrame:
    v = shell_volumes(t)
    outer = F.col("shell_type") == "outer"
    bad = v.where((outer & (F.col("volume") < -tol.volume)) | (~outer & (F.col("volume") > tol.volume)))
    return issues(bad, 25, F.when(outer, "SHELL_ORIENTATION_REVERSED").otherwise("INNER_SHELL_ORIENTATION_REVERSED"), "solid_id", "shell_idx", number_text(F.round("volume", 6)))


@rule(8, 6, "No solid overlap")
def overlaps(t: Topology, tol: Tolerances) -> DataFrame:
    s = stored(t.solid.withColumnRenamed("id", "solid_id").join(solid_boxes(t), [D, "solid_id"]).select(D, "solid_id", "ord", "theme", "parent_id", "level", *[f"{c}{i}" for c in XYZ for i in (1, 2)]))
    cols = ["solid_id", "parent_id", "level", *[f"{c}{i}" for c in XYZ for i in (1, 2)]]
    p = box_pairs(s, [D, "theme"], cols, cols, deal=t.dealt)
    for c in XYZ:
        p = p.where((F.col(f"a_{c}1") < F.col(f"b_{c}2")) & (F.col(f"b_{c}1") < F.col(f"a_{c}2")))
    family = F.coalesce(F.col("a_parent_id") == F.col("b_solid_id"), F.lit(False)) | F.coalesce(F.col("b_parent_id") == F.col("a_solid_id"), F.lit(False))
    la, lb = F.split("a_level", r"\|"), F.split("b_level", r"\|")
    floors = F.coalesce((F.col("a_level") != "") & (F.col("b_level") != "") & ~F.arrays_overlap(la, lb), F.lit(False))
    p = p.where(~family & ~floors).select(D, "a_solid_id", "b_solid_id", "theme")
    faces = t.solid_face.groupBy(D, "solid_id").agg(F.collect_set("face_id").alias("faces"))
    for side in "ab":
        p = p.join(faces.select(D, F.col("solid_id").alias(f"{side}_solid_id"), F.col("faces").alias(f"{side}_faces")), [D, f"{side}_solid_id"], "left")
    shared = F.coalesce(F.arrays_overlap("a_faces", "b_faces"), F.lit(False))
    return issues(p.where(~shared), 8, "SOLID_OVERLAP", "a_solid_id", "b_solid_id", "theme")


@rule(10, 6, "Face adjacency limit")
def crowded_faces(t: Topology, tol: Tolerances) -> DataFrame:
    g = t.solid_face.groupBy(D, "face_id").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    return issues(g, 10, "FACE_ADJACENCY_LIMIT_EXCEEDED", "face_id", "n")


def contained(t: Topology, s: DataFrame, ref: str, number: int, unknown: str, outside: str) -> DataFrame:
    """Issues of solids whose ref is no solid, or whose box isn't within that solid's (inclusive; no box: within)."""
    known = t.solid.select(D, F.col("id").alias(ref), F.lit(True).alias("known"))
    s = s.join(known, [D, ref], "left")
    b = solid_boxes(t)
    mine = b.select(D, F.col("solid_id").alias("id"), *[F.col(f"{c}{i}").alias(f"m{c}{i}") for c in XYZ for i in (1, 2)])
    its = b.withColumnRenamed("solid_id", ref)
    s = s.join(mine, [D, "id"], "left").join(its, [D, ref], "left")
    out = F.lit(False)
    for c in XYZ:
        out = out | (F.col(f"m{c}1") < F.col(f"{c}1")) | (F.col(f"m{c}2") > F.col(f"{c}2"))
    bad = s.where(F.col("known").isNull() | F.coalesce(out, F.lit(False)))
    return issues(bad, number, F.when(F.col("known").isNull(), unknown).otherwise(outside), "id", ref)


@rule(9, 7, "Parent containment")
def parents(t: Topology, tol: Tolerances) -> DataFrame:
    return contained(t, t.solid.where("parent_id <> ''").select(D, "id", "parent_id"), "parent_id", 9, "UNKNOWN_PARENT_REFERENCE", "CHILD_NOT_CONTAINED_IN_PARENT")


@rule(20, 7, "Easement containment")
def easements(t: Topology, tol: Tolerances) -> DataFrame:
    s = t.solid.where(F.col("parcel_type").isin("easement", "secondary")).withColumn("burdened", F.coalesce(F.expr("nullif(burdened_id, '')"), F.expr("nullif(servient_id, '')")))
    missing = issues(s.where("burdened is null"), 20, "EASEMENT_MISSING_BURDENED", "id", F.lit(""))
    return missing.unionByName(contained(t, s.where("burdened is not null").select(D, "id", "burdened"), "burdened", 20, "UNKNOWN_BURDENED_REFERENCE", "EASEMENT_NOT_CONTAINED_IN_BURDENED"))


@rule(21, 7, "Thematic hosts")
def hosts(t: Topology, tol: Tolerances) -> DataFrame:
    s = t.solid.where("parcel_type = 'thematic'").withColumn("host", F.expr("nullif(host_id, '')"))
    known = t.solid.select(D, F.col("id").alias("host"), F.lit(True).alias("known"))
    bad = s.join(known, [D, "host"], "left").where("known is null")
    return issues(bad, 21, F.when(F.col("host").isNull(), "THEMATIC_SOLID_MISSING_HOST").otherwise("UNKNOWN_HOST_REFERENCE"), "id", "host")

"""Queries over the mesh of a folder's tables, and DuckDB SQL that states the same rules in other ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Tolerances
from ..functions import crs
from ..operators import curves, inline, namespaces, resolve
from ..operators.rules import RULES
from ..storage import spread
from . import conversion, graphs, mesh, samples, structure
from .validate import rule_results

SEG = """seg AS (SELECT a.curve_id, a.curve_ord, a.pos AS i, a.point_id AS ia, b.point_id AS ib, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz
 FROM curve_vertex a JOIN curve_vertex b ON a.curve_id = b.curve_id AND b.pos = a.pos + 1 JOIN point p ON p.id = a.point_id JOIN point q ON q.id = b.point_id)"""
BOX = """box AS MATERIALIZED (SELECT solid_id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2
 FROM solid_face sf JOIN ring_member rm ON rm.surface_id = sf.face_id JOIN curve_vertex cv ON cv.curve_id = rm.curve_id JOIN point p ON p.id = cv.point_id GROUP BY solid_id)"""
DIR = """cend AS (SELECT curve_id, arg_min(point_id, pos) AS f, arg_max(point_id, pos) AS l FROM curve_vertex GROUP BY curve_id),
dir AS (SELECT rm.*, CASE orientation WHEN '-' THEN l ELSE f END AS s, CASE orientation WHEN '-' THEN f ELSE l END AS e FROM ring_member rm LEFT JOIN cend USING (curve_id))"""
#: Proper crossing of segments u and v, as a macro's body: n = d1 x d2, both parameters strictly inside, coplanar.
CROSS = """(CASE WHEN q < 1e-18 THEN false ELSE (rn * rn) / q <= 1e-18 AND t / q > 0 AND t / q < 1 AND s / q > 0 AND s / q < 1 END)"""


def crossings(pairs: str, cols: str) -> str:
    """Pairs (with u's and v's coordinates) that cross; pairs: a FROM clause of seg-like u and v."""
    return f"""
    d AS (SELECT {cols}, u.bx - u.ax AS d1x, u.by_ - u.ay AS d1y, u.bz - u.az AS d1z, v.bx - v.ax AS d2x, v.by_ - v.ay AS d2y, v.bz - v.az AS d2z,
                 v.ax - u.ax AS rx, v.ay - u.ay AS ry, v.az - u.az AS rz {pairs}),
    n AS (SELECT *, d1y * d2z - d1z * d2y AS nx, d1z * d2x - d1x * d2z AS ny, d1x * d2y - d1y * d2x AS nz FROM d),
    q AS (SELECT *, nx * nx + ny * ny + nz * nz AS q, rx * nx + ry * ny + rz * nz AS rn,
                 (ry * d2z - rz * d2y) * nx + (rz * d2x - rx * d2z) * ny + (rx * d2y - ry * d2x) * nz AS t,
                 (ry * d1z - rz * d1y) * nx + (rz * d1x - rx * d1z) * ny + (rx * d1y - ry * d1x) * nz AS s FROM n),
    hit AS (SELECT * FROM q WHERE {CROSS})"""


OVERLAP = "u.x1 <= v.x2 AND v.x1 <= u.x2"
BANDS = "least(u.ax, u.bx) <= greatest(v.ax, v.bx) + 1e-6 AND least(v.ax, v.bx) <= greatest(u.ax, u.bx) + 1e-6 AND least(u.ay, u.by_) <= greatest(v.ay, v.by_) + 1e-6 AND least(v.ay, v.by_) <= greatest(u.ay, u.by_) + 1e-6"

#: Per rule: further tables, then a select of code, object_id and detail.
ORACLES = {
    "TR-01": ("", """SELECT 'DUPLICATE_POINT_PROXIMITY' AS code, a.id AS object_id, b.id AS detail FROM (SELECT *, unnest([floor(x), floor(x) + 1, floor(x) - 1]) AS bx FROM point) a
              JOIN point b ON a.bx = floor(b.x) AND floor(a.y) = floor(b.y) AND floor(a.z) = floor(b.z) AND a.ord < b.ord AND b.x BETWEEN a.x - 1e-6 AND a.x + 1e-6 AND b.y BETWEEN a.y - 1e-6 AND a.y + 1e-6
              WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 1e-12"""),
    "TR-02": (SEG + ", " + crossings("FROM seg u JOIN seg v ON u.curve_id = v.curve_id AND v.i >= u.i + 2 JOIN (SELECT curve_id FROM curve_vertex GROUP BY 1 HAVING count(*) >= 4) c ON c.curve_id = u.curve_id", "u.curve_id, u.i AS i, v.i AS j"),
              "SELECT 'CURVE_SELF_INTERSECTION' AS code, curve_id AS object_id, concat(min(i * 1000 + j) // 1000, '|', min(i * 1000 + j) % 1000) AS detail FROM hit GROUP BY curve_id"),
    "TR-03": ("", "SELECT DISTINCT 'DANGLING_CURVE' AS code, curve_id AS object_id, '' AS detail FROM curve_vertex WHERE curve_id NOT IN (SELECT curve_id FROM ring_member)"),
    "TR-04": (DIR, """SELECT 'SURFACE_RING_NOT_CLOSED' AS code, a.surface_id AS object_id, concat(a.ring_idx, '|', min(a.member_idx), '|', arg_min(a.curve_id, a.member_idx)) AS detail
              FROM (SELECT *, count(*) OVER (PARTITION BY surface_id, ring_idx) AS n FROM dir) a JOIN dir b ON a.surface_id = b.surface_id AND a.ring_idx = b.ring_idx AND b.member_idx = (a.member_idx + 1) % a.n
              WHERE a.e <> b.s GROUP BY a.surface_id, a.ring_idx"""),
    "TR-05": ("", "SELECT 'SHARED_EDGE_SAME_ORIENTATION' AS code, curve_id AS object_id, concat(any_value(orientation), '|', count(*)) AS detail FROM ring_member GROUP BY curve_id HAVING count(*) >= 2 AND count(DISTINCT orientation) = 1"),
    "TR-06": ("""c AS (SELECT solid_id, curve_id, count(*) AS n, min(face_idx * 1000 + member_idx) AS place FROM solid_face JOIN ring_member ON surface_id = face_id GROUP BY 1, 2 HAVING count(*) <> 2)""",
              "SELECT 'OPEN_SOLID_SHELL' AS code, solid_id AS object_id, concat(count(*), '|', array_to_string(list_slice(list(curve_id ORDER BY place), 1, 10), ',')) AS detail FROM c GROUP BY solid_id"),
    "TR-07": ("", "SELECT 'ZERO_OR_NEGATIVE_VOLUME' AS code, id AS object_id, '0.0' AS detail FROM solid WHERE NOT volume > 1e-9"),
    "TR-08": (BOX + ", sb AS (SELECT s.id, s.ord, s.theme, s.parent_id, box.* FROM solid s JOIN box ON box.solid_id = s.id)",
              """SELECT 'SOLID_OVERLAP' AS code, u.id AS object_id, concat(v.id, '|', u.theme) AS detail FROM (SELECT *, unnest(range(CAST(floor(x1 / 10) AS BIGINT), CAST(floor(x2 / 10) AS BIGINT) + 1)) AS c, floor(y1 / 1000) AS cy FROM sb) u
              JOIN (SELECT *, unnest(range(CAST(floor(x1 / 10) AS BIGINT), CAST(floor(x2 / 10) AS BIGINT) + 1)) AS c FROM sb) v ON u.theme = v.theme AND u.c = v.c AND u.ord < v.ord AND u.x1 < v.x2 AND v.x1 < u.x2 AND u.y1 < v.y2 AND v.y1 < u.y2 AND u.z1 < v.z2 AND v.z1 < u.z2
              WHERE u.parent_id IS DISTINCT FROM v.id AND v.parent_id IS DISTINCT FROM u.id AND NOT EXISTS (SELECT 1 FROM solid_face f JOIN solid_face g ON f.face_id = g.face_id WHERE f.solid_id = u.id AND g.solid_id = v.id)
              GROUP BY u.id, v.id, u.theme"""),
    "TR-09": (BOX, """SELECT CASE WHEN p.id IS NULL THEN 'UNKNOWN_PARENT_REFERENCE' ELSE 'CHILD_NOT_CONTAINED_IN_PARENT' END AS code, c.id AS object_id, c.parent_id AS detail
              FROM solid c LEFT JOIN solid p ON p.id = c.parent_id LEFT JOIN box m ON m.solid_id = c.id LEFT JOIN box o ON o.solid_id = p.id
              WHERE c.parent_id <> '' AND (p.id IS NULL OR NOT coalesce(m.x1 >= o.x1 AND m.x2 <= o.x2 AND m.y1 >= o.y1 AND m.y2 <= o.y2 AND m.z1 >= o.z1 AND m.z2 <= o.z2, true))"""),
    "TR-10": ("", "SELECT 'FACE_ADJACENCY_LIMIT_EXCEEDED' AS code, face_id AS object_id, CAST(count(*) AS VARCHAR) AS detail FROM solid_face GROUP BY face_id HAVING count(*) > 2"),
    "TR-11": ("", "SELECT 'UNKNOWN_POINT_REFERENCE' AS code, curve_id AS object_id, point_id AS detail FROM curve_vertex LEFT JOIN point ON id = point_id WHERE id IS NULL"),
    "TR-12": (SEG, """SELECT 'CURVE_BELOW_MINIMUM_LENGTH' AS code, c.curve_id AS object_id, CAST(round(coalesce(len, 0.0), 6) AS VARCHAR) AS detail FROM (SELECT DISTINCT curve_id FROM curve_vertex) c
              LEFT JOIN (SELECT curve_id, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az))) AS len FROM seg GROUP BY 1) s ON s.curve_id = c.curve_id WHERE coalesce(len, 0.0) < 1e-3"""),
    "TR-13": ("l AS (SELECT curve_id, max(curve_ord) AS ord, list(point_id ORDER BY pos) AS v FROM curve_vertex GROUP BY 1)",
              """SELECT 'DUPLICATE_CURVE' AS code, b.curve_id AS object_id, arg_min(a.curve_id, a.ord) AS detail FROM (SELECT *, v AS w FROM l UNION ALL SELECT *, list_reverse(v) FROM l WHERE v <> list_reverse(v)) a
              JOIN l b ON a.w = b.v AND a.ord < b.ord GROUP BY b.curve_id"""),
    "TR-14": (SEG + ", cell AS (SELECT *, unnest(range(CAST(floor((least(ax, bx) - 1e-6) / 16) AS BIGINT), CAST(floor((greatest(ax, bx) + 1e-6) / 16) AS BIGINT) + 1)) AS cx FROM seg), c2 AS (SELECT *, unnest(range(CAST(floor((least(ay, by_) - 1e-6) / 16) AS BIGINT), CAST(floor((greatest(ay, by_) + 1e-6) / 16) AS BIGINT) + 1)) AS cy FROM cell), "
              + crossings(f"FROM c2 u JOIN c2 v ON u.cx = v.cx AND u.cy = v.cy AND u.curve_ord < v.curve_ord AND u.ia NOT IN (v.ia, v.ib) AND u.ib NOT IN (v.ia, v.ib) AND {BANDS}", "u.curve_id AS a, v.curve_id AS b"),
              "SELECT DISTINCT 'CURVE_INTERSECTION_NOT_AT_NODE' AS code, a AS object_id, b AS detail FROM hit"),
    "TR-15": (SEG + ", rs AS (SELECT rm.surface_id, rm.member_idx AS m, seg.*, max(rm.member_idx) OVER (PARTITION BY rm.surface_id) AS last FROM ring_member rm JOIN seg USING (curve_id)), "
              + crossings("FROM rs u JOIN rs v ON u.surface_id = v.surface_id AND v.m >= u.m + 2 AND NOT (u.m = 0 AND v.m = u.last) AND u.ia NOT IN (v.ia, v.ib) AND u.ib NOT IN (v.ia, v.ib)", "u.surface_id, u.m AS i, v.m AS j"),
              "SELECT 'SURFACE_SELF_INTERSECTION' AS code, surface_id AS object_id, concat('0|', min(i * 1000 + j) // 1000, '|', min(i * 1000 + j) % 1000) AS detail FROM hit GROUP BY surface_id"),
    "TR-16": ("l AS (SELECT surface_id, max(surface_ord) AS ord, list_sort(list_distinct(list(curve_id))) AS v FROM ring_member GROUP BY 1)",
              "SELECT 'DUPLICATE_SURFACE' AS code, b.surface_id AS object_id, arg_min(a.surface_id, a.ord) AS detail FROM l a JOIN l b ON a.v = b.v AND a.ord < b.ord GROUP BY b.surface_id"),
    "TR-17": ("", "SELECT 'UNKNOWN_CURVE_REFERENCE' AS code, surface_id AS object_id, concat(ring_idx, '|', member_idx, '|', curve_id) AS detail FROM ring_member WHERE curve_id NOT IN (SELECT curve_id FROM curve_vertex)"),
    "TR-18": ("", "SELECT DISTINCT 'DANGLING_FACE' AS code, surface_id AS object_id, '' AS detail FROM ring_member WHERE surface_id NOT IN (SELECT face_id FROM solid_face)"),
    "TR-19": (BOX, """SELECT 'SOLID_BELOW_MINIMUM_THICKNESS' AS code, solid_id AS object_id, array_to_string(list_filter([CASE WHEN x2 - x1 < 1e-3 THEN 'x' END, CASE WHEN y2 - y1 < 1e-3 THEN 'y' END, CASE WHEN z2 - z1 < 1e-3 THEN 'z' END], lambda c: c IS NOT NULL), ',') AS detail
              FROM box WHERE least(x2 - x1, y2 - y1, z2 - z1) < 1e-3"""),
    "TR-20": (BOX + ", e AS (SELECT id, coalesce(nullif(burdened_id, ''), nullif(servient_id, '')) AS b FROM solid WHERE parcel_type IN ('easement', 'secondary'))",
              """SELECT CASE WHEN b IS NULL THEN 'EASEMENT_MISSING_BURDENED' WHEN p.id IS NULL THEN 'UNKNOWN_BURDENED_REFERENCE' ELSE 'EASEMENT_NOT_CONTAINED_IN_BURDENED' END AS code, e.id AS object_id, coalesce(b, '') AS detail
              FROM e LEFT JOIN solid p ON p.id = b LEFT JOIN box m ON m.solid_id = e.id LEFT JOIN box o ON o.solid_id = p.id
              WHERE p.id IS NULL OR NOT coalesce(m.x1 >= o.x1 AND m.x2 <= o.x2 AND m.y1 >= o.y1 AND m.y2 <= o.y2 AND m.z1 >= o.z1 AND m.z2 <= o.z2, true)"""),
    "TR-21": ("", "SELECT CASE WHEN coalesce(t.host_id, '') = '' THEN 'THEMATIC_SOLID_MISSING_HOST' ELSE 'UNKNOWN_HOST_REFERENCE' END AS code, t.id AS object_id, coalesce(t.host_id, '') AS detail FROM solid t WHERE parcel_type = 'thematic' AND (t.host_id IS NULL OR NOT EXISTS (SELECT 1 FROM solid h WHERE h.id = t.host_id))"),
    "TR-22": ("", "SELECT 'CURVE_REPEATED_IN_RING' AS code, b.surface_id AS object_id, concat(b.ring_idx, '|', b.curve_id, '|', min(a.member_idx), '|', b.member_idx) AS detail FROM ring_member a JOIN ring_member b USING (surface_id, ring_idx, curve_id) WHERE a.member_idx < b.member_idx GROUP BY b.surface_id, b.ring_idx, b.curve_id, b.member_idx"),
    "TR-23": (DIR, "SELECT 'SURFACE_RING_REPEATED_VERTEX' AS code, b.surface_id AS object_id, concat(b.ring_idx, '|', b.s, '|', min(a.member_idx), '|', b.member_idx) AS detail FROM dir a JOIN dir b ON a.surface_id = b.surface_id AND a.ring_idx = b.ring_idx AND a.s = b.s WHERE a.member_idx < b.member_idx GROUP BY b.surface_id, b.ring_idx, b.s, b.member_idx"),
    "TR-24": (SEG + ", ss AS (SELECT sf.solid_id, sf.face_idx AS f, rm.member_idx AS m, seg.* FROM solid_face sf JOIN ring_member rm ON rm.surface_id = sf.face_id JOIN seg ON seg.curve_id = rm.curve_id), "
              + crossings("FROM ss u JOIN ss v ON u.solid_id = v.solid_id AND u.f < v.f", "u.solid_id, u.f AS f, v.f AS g, u.m AS i, v.m AS j"),
              "SELECT 'SOLID_SELF_INTERSECTION' AS code, solid_id AS object_id, concat(arg_min(f, f * 1000000 + i * 10000 + g * 100 + j), '|', arg_min(g, f * 1000000 + i * 10000 + g * 100 + j)) AS detail FROM hit GROUP BY solid_id"),
    "TR-25": (DIR + """, v AS (SELECT sf.solid_id, sf.face_idx, sf.orientation AS o, list(struct_pack(x := p.x, y := p.y, z := p.z) ORDER BY d.member_idx) AS r FROM solid_face sf JOIN dir d ON d.surface_id = sf.face_id JOIN point p ON p.id = d.s GROUP BY 1, 2, 3),
              w AS (SELECT solid_id, face_idx, CASE o WHEN '-' THEN list_reverse(r) ELSE r END AS r FROM v),
              t AS (SELECT solid_id, r[1] AS a, r[i] AS b, r[i + 1] AS c FROM (SELECT *, unnest(range(2, len(r))) AS i FROM w)),
              vol AS (SELECT solid_id, sum(a.x * (b.y * c.z - b.z * c.y) + a.y * (b.z * c.x - b.x * c.z) + a.z * (b.x * c.y - b.y * c.x)) / 6 AS volume FROM t GROUP BY 1)""",
              "SELECT 'SHELL_ORIENTATION_REVERSED' AS code, solid_id AS object_id, concat('0|', CAST(round(volume, 6) AS VARCHAR)) AS detail FROM vol WHERE volume < -1e-9"),
}


def rule_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mesh.owned(RULES[name][2](mesh.tiled(spark, sf_dir), Tolerances()), "object_id").drop("dataset_id")

    run.__doc__ = f"{name} over the mesh: {RULES[name][0]}."
    return run


def rule_sql(name: str) -> str:
    tables, select = ORACLES[name]
    return f"{mesh.ctes()}{', ' + tables if tables else ''}\nSELECT '{name}' AS rule, code, 'error' AS severity, object_id, detail FROM ({select}) r"


def key(name: str) -> str:
    return f"{name.lower().replace('-', '')}_{RULES[name][0].lower().replace(' ', '_').replace('-', '_')}"


QUERIES = {key(n): rule_query(n) for n in sorted(RULES)}
SQL = {key(n): rule_sql(n) for n in sorted(ORACLES)}


def geometry_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        line = {"edges": resolve.curve_lines, "faces": resolve.polygons, "solids": resolve.solids}[kind](mesh.tiled(spark, sf_dir))
        line, c = mesh.owned(line, "id"), line.columns[-1]
        depth = {"edges": c, "faces": F.flatten(c), "solids": F.flatten(F.flatten(c))}[kind]
        text = F.array_join(F.transform(depth, lambda p: F.concat_ws(" ", *[F.get(p, F.lit(i)).cast("decimal(20,6)") for i in range(3)])), ",")
        return line.select("id", F.size(depth).cast("long").alias("n_vertices"), text.alias("vertices"))

    run.__doc__ = f"The geometry of all {kind}."
    return run


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges and points lie below every surface and solid."""
    return mesh.owned(resolve.reachable(mesh.tiled(spark, sf_dir)).groupBy("dataset_id", "feature_id", "kind").agg(F.count(F.lit(1)).alias("n")), "feature_id").drop("dataset_id")


ARC = """SELECT CAST(p_partkey AS BIGINT) AS k, 5 + p_partkey % 50 AS r, p_partkey % 7 AS a0, 1 + p_partkey % 5 AS turn, p_partkey % 2 AS cw FROM part"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs and circles made from the parts: vertices and length of each within a sagitta of 0.02."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    a = spark.sql(ARC.replace("part", "{part}").replace("p_{part}key", "p_partkey"), part=part)
    at = lambda angle: F.array(F.col("r") * F.cos(angle), F.col("r") * F.sin(angle))
    sign = F.when(F.col("cw") == 1, -1).otherwise(1)
    end = F.col("a0") + sign * F.col("turn")
    zero = F.array(F.lit(0.0), F.lit(0.0))
    rows = a.select(F.col("k").cast("string").alias("id"), F.when(F.col("k") % 10 == 0, "CircleByCenter").otherwise("ArcWithCenter").alias("type"), F.when(F.col("k") % 10 == 0, F.array(zero)).otherwise(F.array(at(F.col("a0")), zero, at(end))).alias("p"), F.col("r").cast("double").alias("radius"), F.when(F.col("cw") == 1, "cw").otherwise("ccw").alias("orientation"))
    line = curves.densified(rows)
    step = lambda i: (F.get("line", i), F.get("line", i + 1))
    d = lambda u, v: F.sqrt((u[0] - v[0]) * (u[0] - v[0]) + (u[1] - v[1]) * (u[1] - v[1]))
    length = F.aggregate(F.sequence(F.lit(0), F.size("line") - 2), F.lit(0.0), lambda acc, i: acc + d(*step(i)))
    return line.select("id", "type", F.size("line").cast("long").alias("n_vertices"), F.round(length, 4).alias("length"))


ARC_SQL = f"""WITH a AS ({ARC}), s AS (SELECT *, CASE WHEN k % 10 = 0 THEN 2 * pi() ELSE CAST(turn AS DOUBLE) END AS sweep, 2 * acos(1 - 0.02 / r) AS th FROM a),
n AS (SELECT *, CASE WHEN k % 10 = 0 THEN greatest(3, CAST(ceil(sweep / th) AS BIGINT)) ELSE greatest(1, CAST(ceil(sweep / th) AS BIGINT)) END AS n FROM s)
SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 10 = 0 THEN 'CircleByCenter' ELSE 'ArcWithCenter' END AS type, CAST(n + 1 AS BIGINT) AS n_vertices, round(n * 2 * r * sin(sweep / n / 2), 4) AS length FROM n"""


def splines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splines through five points made from each part, every other one clamped: vertices of each within a sagitta of 0.02."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    k = F.col("p_partkey")
    pts = F.array(*[F.array(F.lit(4.0 * i), ((k * (i + 3)) % 11).cast("double")) for i in range(5)])
    clamp = lambda x, y: F.when(k % 2 == 0, F.array(F.lit(x), F.lit(y)))
    rows = part.select(k.cast("string").alias("id"), pts.alias("p"), clamp(1.0, 0.0).alias("first"), clamp(0.0, 2.0).alias("last"))
    vertices = F.array_join(F.transform("line", lambda v: F.concat(F.get(v, F.lit(0)).cast("decimal(20,6)").cast("string"), F.lit(" "), F.get(v, F.lit(1)).cast("decimal(20,6)").cast("string"))), ",")
    return curves.splined(rows).select("id", F.size("line").cast("long").alias("n_vertices"), vertices.alias("vertices"))


_AT_U = "(2*{u}*{u}*{u} - 3*{u}*{u} + 1) * p{c} + ({u}*{u}*{u} - 2*{u}*{u} + {u}) * h * d{c} + (3*{u}*{u} - 2*{u}*{u}*{u}) * q{c} + ({u}*{u}*{u} - {u}*{u}) * h * e{c}"
_AT = {(u, c): _AT_U.format(u=u, c=c) for u in ("lo", "hi", "((lo + hi) / 2)") for c in "xy"}
_SPAN = f"SELECT *, {_AT['lo', 'x']} AS ax, {_AT['lo', 'y']} AS ay, {_AT['hi', 'x']} AS bx, {_AT['hi', 'y']} AS by_, {_AT['((lo + hi) / 2)', 'x']} AS mx, {_AT['((lo + hi) / 2)', 'y']} AS my FROM"
_FLAT = "(SELECT sqrt((mx - ax - t * (bx - ax)) ** 2 + (my - ay - t * (by_ - ay)) ** 2) <= 0.02 FROM (SELECT least(1.0, greatest(0.0, ((mx - ax) * (bx - ax) + (my - ay) * (by_ - ay)) / nullif((bx - ax) ** 2 + (by_ - ay) ** 2, 0))) AS t) z)"
SPLINE_SQL = f"""WITH RECURSIVE p AS (SELECT p_partkey AS k, i, CAST(4 * i AS DOUBLE) AS x, CAST(p_partkey * (i + 3) % 11 AS DOUBLE) AS y FROM part CROSS JOIN (SELECT unnest(range(5)) AS i) r),
h AS (SELECT a.k, a.i, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy, sqrt(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) AS h FROM p a JOIN p b ON b.k = a.k AND b.i = a.i + 1),
sys AS (SELECT p.k, p.i, CASE WHEN p.k % 2 = 0 AND p.i IN (0, 4) THEN 0 WHEN p.i = 4 THEN l.h ELSE coalesce(1 / l.h, 0) END AS a,
  CASE WHEN p.k % 2 = 0 AND p.i IN (0, 4) THEN 1 WHEN p.i = 0 THEN 2 * r.h WHEN p.i = 4 THEN 2 * l.h ELSE 2 * (1 / l.h + 1 / r.h) END AS b,
  CASE WHEN p.i = 4 OR p.k % 2 = 0 AND p.i = 0 THEN 0 WHEN p.i = 0 THEN (SELECT n.h FROM h n WHERE n.k = p.k AND n.i = 1) ELSE 1 / r.h END AS c,
  CASE WHEN p.k % 2 = 0 AND p.i = 0 THEN 1.0 WHEN p.k % 2 = 0 AND p.i = 4 THEN 0.0 WHEN p.i = 0 THEN 3 * (r.qx - r.px) WHEN p.i = 4 THEN 3 * (l.qx - l.px) ELSE 3 * ((r.qx - r.px) / r.h ** 2 + (l.qx - l.px) / l.h ** 2) END AS rx,
  CASE WHEN p.k % 2 = 0 AND p.i = 0 THEN 0.0 WHEN p.k % 2 = 0 AND p.i = 4 THEN 2.0 WHEN p.i = 0 THEN 3 * (r.qy - r.py) WHEN p.i = 4 THEN 3 * (l.qy - l.py) ELSE 3 * ((r.qy - r.py) / r.h ** 2 + (l.qy - l.py) / l.h ** 2) END AS ry
  FROM p LEFT JOIN h l ON l.k = p.k AND l.i = p.i - 1 LEFT JOIN h r ON r.k = p.k AND r.i = p.i),
fwd(k, i, c, dx, dy) AS (SELECT k, i, c / b, rx / b, ry / b FROM sys WHERE i = 0
  UNION ALL SELECT s.k, s.i, s.c / (s.b - s.a * f.c), (s.rx - s.a * f.dx) / (s.b - s.a * f.c), (s.ry - s.a * f.dy) / (s.b - s.a * f.c) FROM fwd f JOIN sys s ON s.k = f.k AND s.i = f.i + 1),
bwd(k, i, x, y) AS (SELECT k, i, dx, dy FROM fwd WHERE i = 4 UNION ALL SELECT f.k, f.i, f.dx - f.c * w.x, f.dy - f.c * w.y FROM bwd w JOIN fwd f ON f.k = w.k AND f.i = w.i - 1),
cubic AS (SELECT h.*, u.x AS dx, u.y AS dy, v.x AS ex, v.y AS ey FROM h JOIN bwd u ON u.k = h.k AND u.i = h.i JOIN bwd v ON v.k = h.k AND v.i = h.i + 1),
span AS ({_SPAN} (SELECT *, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS depth FROM cubic)
  UNION ALL {_SPAN} (SELECT k, i, px, py, qx, qy, h, dx, dy, ex, ey, CASE half WHEN 0 THEN lo ELSE (lo + hi) / 2 END AS lo, CASE half WHEN 0 THEN (lo + hi) / 2 ELSE hi END AS hi, depth + 1 AS depth
    FROM span CROSS JOIN (VALUES (0), (1)) AS z(half) WHERE depth < 20 AND NOT {_FLAT})),
leaf AS (SELECT k, i, hi, bx AS x, by_ AS y FROM span WHERE depth >= 20 OR {_FLAT} UNION ALL SELECT k, -1, 0.0, x, y FROM p WHERE i = 0)
SELECT CAST(k AS VARCHAR) AS id, count(*) AS n_vertices, string_agg(concat(CAST(CAST(x AS DECIMAL(20,6)) AS VARCHAR), ' ', CAST(CAST(y AS DECIMAL(20,6)) AS VARCHAR)), ',' ORDER BY i, hi) AS vertices FROM leaf GROUP BY k"""


def reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in a zone of MGA2020 made from the orders, in longitude and latitude."""
    k = F.col("o_orderkey")
    at = F.array((350000 + k % 300 * 1000).cast("double"), (6200000 + k % 911 * 1000).cast("double"), (k % 7).cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.cast("long").alias("k"), crs.reprojected(at, "EPSG:7850").alias("c"))
    return rows.select("k", *[F.round(F.get("c", F.lit(i)), 9).alias(n) for i, n in enumerate(("lon", "lat", "height"))])


def rule_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and counts of structure and all rules for the mesh and for a dataset without issues, over the issues of four quick rules."""
    t = mesh.tiled(spark, sf_dir)
    found = None
    for name in QUICK:
        rows = RULES[name][2](t, Tolerances())
        found = rows if found is None else found.unionByName(rows)
    known = found.sparkSession.createDataFrame([("mesh",), ("sound",)], "dataset_id string")
    return rule_results(mesh.owned(found, "object_id"), known).select("dataset_id", "rule", "name", F.col("class").alias("conformance_class"), "status", "issues", "errors")


QUICK = ("TR-05", "TR-07", "TR-10", "TR-18")


#: One document: a square of side #, its edges in mixed directions, and features of every type of inline topology.
SQUARE = """{"points":[{"features":[{"id":"a","place":{"coordinates":[0,0]}},{"id":"b","place":{"coordinates":[#,0]}},{"id":"c","geometry":{"coordinates":[#,#]}},{"id":"d","place":{"coordinates":[0,#]}}]}],
"edges":[{"features":[{"id":"ab","topology":{"type":"LineString","references":["a","b"]}},{"id":"cb","topology":{"type":"Edge","references":["c","b"]}},{"id":"cd","topology":{"references":["c","nobody","d"]}},{"id":"ad","topology":{"type":"linestring","references":["a","d"]}},{"id":"short","topology":{"type":"Edge","references":["a","nobody"]}}]}],
"faces":[{"features":[{"id":"square","topology":{"type":"Polygon","references":[["ab","cb","cd","ad"]]}},{"id":"both","topology":{"type":"MultiLineString","references":[["a","b"],["c","nobody"],["c","d","a"]]}},{"id":"one","topology":{"type":"Node","references":["c"]}},{"id":"walk","topology":{"directed_references":[{"ref":"ab"},{"ref":"cb","orientation":"-"},{"ref":"cd"}]}},{"id":"whole","topology":{"type":"AggregatePolygon","references":["square","walk","nobody"]}},{"id":"odd","topology":{"type":"Node","references":[["a"]]}}]}]}"""
_RING, _WALK = "[[0.0,0.0],[#.0,0.0],[#.0,#.0],[0.0,#.0],[0.0,0.0]]", "[[0.0,0.0],[#.0,0.0],[#.0,#.0],[0.0,#.0]]"
#: Its geometries.
SQUARES = [
    ("ab", "LineString", "[[0.0,0.0],[#.0,0.0]]"), ("cb", "LineString", "[[#.0,#.0],[#.0,0.0]]"), ("cd", "LineString", "[[#.0,#.0],[0.0,#.0]]"), ("ad", "LineString", "[[0.0,0.0],[0.0,#.0]]"),
    ("square", "Polygon", f"[{_RING}]"), ("both", "MultiLineString", "[[[0.0,0.0],[#.0,0.0]],[[#.0,#.0],[0.0,#.0],[0.0,0.0]]]"), ("one", "Point", "[#.0,#.0]"),
    ("walk", "Polygon", f"[{_WALK}]"), ("whole", "MultiPolygon", f"[[{_RING}],[{_WALK}]]"),
]


def inline_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries of inline topology in one document for each part."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    docs = part.select(F.concat(F.lit("d:"), "p_partkey").alias("dataset_id"), F.parse_json(F.replace(F.lit(SQUARE), F.lit("#"), (1 + F.col("p_partkey") % 7).cast("string"))).alias("doc"))
    return inline.converted(docs)


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' compact names mean among the suppliers' and nations' full ones, by prefixes of several sources."""
    names = namespaces.merged(namespaces.of_context([{"s": "http://e/supplier/", "x": "http://e/x", "n": {"@id": "http://e/nation#"}}, "http://remote/"]), namespaces.normalised(["s=http://other/", "http://e/supplier/"]))
    c = F.col("c_custkey").cast("string")
    refs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("d").alias("dataset_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("s:"), c)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("q:"), c)).otherwise(F.concat(F.lit("http://e/nation#"), c)).alias("ref"))
    known = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("http://e/supplier/"), "s_suppkey").alias("id")).unionByName(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("http://e/nation#"), "n_nationkey").alias("id")))
    return namespaces.looked_up(refs, known.withColumn("dataset_id", F.lit("d")), namespaces.table(spark, names)).select("ref", "found")


FMT = "concat(CAST(CAST(x AS DECIMAL(20,6)) AS VARCHAR), ' ', CAST(CAST(y AS DECIMAL(20,6)) AS VARCHAR), ' ', CAST(CAST(z AS DECIMAL(20,6)) AS VARCHAR))"
RING = """m AS (SELECT rm.surface_id, rm.member_idx, CASE rm.orientation WHEN '-' THEN -cv.pos ELSE cv.pos END AS o, cv.curve_id, p.x, p.y, p.z
 FROM ring_member rm JOIN curve_vertex cv USING (curve_id) JOIN point p ON p.id = cv.point_id),
ok AS (SELECT surface_id, member_idx, row_number() OVER (PARTITION BY surface_id ORDER BY member_idx) AS nth FROM m GROUP BY surface_id, member_idx HAVING count(*) >= 2),
w AS (SELECT m.*, nth, row_number() OVER (PARTITION BY m.surface_id, m.member_idx ORDER BY o) AS j FROM m JOIN ok USING (surface_id, member_idx)),
v AS (SELECT surface_id, list(struct_pack(x := x, y := y, z := z) ORDER BY nth, j) AS l FROM w WHERE nth = 1 OR j > 1 GROUP BY surface_id),
ring AS (SELECT surface_id, CASE WHEN l[1] = l[len(l)] THEN l ELSE list_append(l, l[1]) END AS l FROM v)"""
TEXT = "array_to_string(list_transform(l, lambda q: concat(CAST(CAST(q.x AS DECIMAL(20,6)) AS VARCHAR), ' ', CAST(CAST(q.y AS DECIMAL(20,6)) AS VARCHAR), ' ', CAST(CAST(q.z AS DECIMAL(20,6)) AS VARCHAR))), ',')"

QUERIES |= {f"geometry_{k}": geometry_query(k) for k in ("edges", "faces", "solids")} | {"components": components, "curves_arcs": arcs, "curves_splines": splines}
QUERIES |= {"structure_codes": structure.planted, "reprojection": reprojection, "rule_statuses": rule_statuses, "namespace_lookups": lookups, "document_rules": samples.issues, "inline_topology": inline_topology}
SQL |= {
    "geometry_edges": f"{mesh.ctes()} SELECT curve_id AS id, count(*) AS n_vertices, string_agg({FMT}, ',' ORDER BY pos) AS vertices FROM curve_vertex JOIN point ON point.id = point_id GROUP BY curve_id HAVING count(*) >= 2",
    "geometry_faces": f"{mesh.ctes()}, {RING} SELECT surface_id AS id, CAST(len(l) AS BIGINT) AS n_vertices, {TEXT} AS vertices FROM ring",
    "geometry_solids": f"{mesh.ctes()}, {RING}, f AS (SELECT solid_id, face_idx, CASE orientation WHEN '-' THEN list_reverse(l) ELSE l END AS l FROM solid_face JOIN ring ON surface_id = face_id) SELECT solid_id AS id, CAST(sum(len(l)) AS BIGINT) AS n_vertices, string_agg({TEXT}, ',' ORDER BY face_idx) AS vertices FROM f GROUP BY solid_id",
    "components": f"""{mesh.ctes()}, up AS (SELECT surface_id AS feature_id, surface_id AS s FROM ring_member UNION SELECT solid_id, face_id FROM solid_face)
 SELECT feature_id, 'edges' AS kind, count(DISTINCT curve_id) AS n FROM up JOIN ring_member ON surface_id = s GROUP BY feature_id
 UNION ALL SELECT feature_id, 'points', count(DISTINCT point_id) FROM up JOIN ring_member rm ON surface_id = s JOIN curve_vertex cv ON cv.curve_id = rm.curve_id GROUP BY feature_id""",
    "curves_arcs": ARC_SQL,
    "curves_splines": SPLINE_SQL,
}

_N = "(1.0 / 298.257222101 / (2 - 1.0 / 298.257222101))"
#: The series in the third flattening n, written as powers of n by multiple of the angle.
_BETA = ("n/2 - 2*n*n/3 + 37*n*n*n/96 - n*n*n*n/360", "n*n/48 + n*n*n/15 - 437*n*n*n*n/1440", "17*n*n*n/480 - 37*n*n*n*n/840", "4397*n*n*n*n/161280")
_DELTA = ("2*n - 2*n*n/3 - 2*n*n*n + 116*n*n*n*n/45", "7*n*n/3 - 8*n*n*n/5 - 227*n*n*n*n/45", "56*n*n*n/15 - 136*n*n*n*n/35", "4279*n*n*n*n/630")
_SINH, _COSH = "((exp({0}) - exp(-({0}))) / 2)", "((exp({0}) + exp(-({0}))) / 2)"
REPROJECTION_SQL = f"""
WITH a AS (SELECT CAST(o_orderkey AS BIGINT) AS k, 350000.0 + o_orderkey % 300 * 1000 AS x, 6200000.0 + o_orderkey % 911 * 1000 AS y, CAST(o_orderkey % 7 AS DOUBLE) AS h, CAST({_N} AS DOUBLE) AS n FROM orders),
b AS (SELECT *, 0.9996 * 6378137.0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) AS r FROM a),
c AS (SELECT *, (y - 10000000.0) / r AS xi, (x - 500000.0) / r AS eta FROM b),
d AS (SELECT *, xi - {" - ".join(f"({c}) * sin({2 * j} * xi) * {_COSH.format(f'{2 * j} * eta')}" for j, c in enumerate(_BETA, 1))} AS u,
             eta - {" - ".join(f"({c}) * cos({2 * j} * xi) * {_SINH.format(f'{2 * j} * eta')}" for j, c in enumerate(_BETA, 1))} AS v FROM c),
e AS (SELECT *, asin(sin(u) / {_COSH.format('v')}) AS chi, atan2({_SINH.format('v')}, cos(u)) AS l FROM d)
SELECT k, round(117 + degrees(l), 9) AS lon, round(degrees(chi + {" + ".join(f"({c}) * sin({2 * j} * chi)" for j, c in enumerate(_DELTA, 1))}), 9) AS lat, h AS height FROM e"""
_TITLES = ", ".join(f"({i}, '{r}', '{RULES[r][0]}', '{RULES[r][1]}')" for i, r in enumerate(sorted(RULES), 1))
_QUICK_SQL = " UNION ALL ".join(f"SELECT '{n}' AS rule FROM ({ORACLES[n][1]}) r" for n in QUICK)
SQL |= {
    "structure_codes": structure.planted_sql(),
    "document_rules": samples.issues_sql(),
    "inline_topology": "SELECT concat('d:', p_partkey) AS dataset_id, id, geom_type, replace(c, '#', CAST(1 + p_partkey % 7 AS VARCHAR)) AS coordinates FROM part CROSS JOIN (VALUES "
    + ", ".join(f"('{i}', '{t}', '{c}')" for i, t, c in SQUARES) + ") AS v(id, geom_type, c)",
    "reprojection": REPROJECTION_SQL,
    "rule_statuses": f"""{mesh.ctes()}, found AS ({_QUICK_SQL}), titles(i, rule, name, class) AS (VALUES (0, 'Structure', 'Structure', ''), {_TITLES})
 SELECT d AS dataset_id, t.rule, name, class AS conformance_class, CASE WHEN count(f.rule) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(f.rule) AS issues, count(f.rule) AS errors
 FROM (VALUES ('mesh'), ('sound')) AS v(d) CROSS JOIN titles t LEFT JOIN found f ON f.rule = t.rule AND d = 'mesh' GROUP BY ALL""",
    "namespace_lookups": """WITH refs AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN concat('s:', c_custkey) WHEN 1 THEN concat('q:', c_custkey) ELSE concat('http://e/nation#', c_custkey) END AS ref FROM customer)
 SELECT ref, CASE WHEN k % 3 = 2 AND k IN (SELECT n_nationkey FROM nation) THEN ref
   ELSE CASE WHEN k IN (SELECT s_suppkey FROM supplier) THEN concat('http://e/supplier/', k) WHEN k IN (SELECT n_nationkey FROM nation) THEN concat('http://e/nation#', k) END END AS found FROM refs""",
}
QUERIES |= graphs.QUERIES | conversion.QUERIES
SQL |= graphs.SQL | conversion.SQL

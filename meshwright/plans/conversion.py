"""Planted documents made from the parts, converted, and SQL that derives the results from the part alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convert, graph, namespaces, resolve
from ..sources import features, turtle
from ..storage import in_place, placed, stored

D = "dataset_id"


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset for each part, in a session of its own for what is made of it."""
    near = placed(spark, spark.read.parquet(f"{sf_dir}/part.parquet").count())
    return in_place(near.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("d:"), F.col("p_partkey").cast("string")).alias(D), F.col("p_partkey").cast("int").alias("k")))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features nested one to six levels deep in lists and collections: their order, depth and the system of the nearest collection."""
    k = F.col("k")
    wrap = lambda acc, i: F.when((k + i) % 2 == 0, text("[", acc, ',{"type":"Feature","id":"s', i, '"}]')).otherwise(text('{"type":"FeatureCollection","coordRefSys":"c', i, '","features":[', acc, ',{"type":"Feature","id":"s', i, '"}]}'))
    inner = F.aggregate(F.sequence(F.lit(1), 1 + k % 6), F.lit('{"type":"Feature","id":"a"},{"type":"Feature","id":"b"}'), wrap)
    docs = part(spark, sf_dir).select(D, F.parse_json(text('{"features":[', inner, "]}")).alias("doc"))
    rows = features.walked(features.values(docs, ("features",)))
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(D).orderBy("at"))
    return rows.select(D, F.try_variant_get("f", "$.id", "string").alias("id"), rank.cast("long").alias("place"), (F.length("at") - F.length(F.replace("at", F.lit("."), F.lit("")))).cast("long").alias("depth"), "crs")


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in the system that is nearest to each feature: its own, its collection's, or the document's by either name."""
    k = F.col("k")
    at = text("[", 350000 + k % 300 * 1000, ",", 6200000 + k % 911 * 1000, ",", k % 7, "]")
    own = F.when(k % 7 == 0, text('"coordRefSys":"EPSG:3857",')).otherwise("")
    around = F.when(k % 5 == 0, text('"coordRefSys":["[EPSG:', 7849 + k % 3, ']","EPSG:9458"],')).otherwise("")
    root = F.concat(F.when(k % 3 == 0, text('"coordRefSys":"EPSG:', 28350 + k % 4, '",')).otherwise(""), F.when(k % 2 == 0, text('"horizontalCRS":"urn:ogc:def:crs:EPSG::', 32748 + k % 5, '",')).otherwise(""), F.when(k % 11 == 0, text('"crs":{"properties":{"name":"EPSG:2193"}},')).otherwise(""))
    feature = lambda name, body: text(f'{{"type":"Feature","id":"{name}",', own, body, "}")
    point = lambda c: text('{"type":"Point","coordinates":', c, "}")
    every = F.concat_ws(",", feature("p", text('"geometry":null,"place":', point(at))), feature("g", text('"geometry":', point(text("[1600000,", 5400000 + k, ",1]")), ',"place":', point(at))), feature("n", F.lit('"geometry":null')))
    doc = text("{", root, '"type":"FeatureCollection","features":[],"points":[{', around, '"type":"FeatureCollection","features":[', every, "]}]}")
    rows = features.normalised(part(spark, sf_dir).select(D, F.parse_json(doc).alias("doc")))
    c = lambda name, i: F.round(F.get(name, F.lit(i)), 9)
    return rows.select(D, "id", "geom_type", c("point", 0).alias("lon"), c("point", 1).alias("lat"), c("point", 2).alias("height"), c("native", 0).alias("native_x"), c("native", 1).alias("native_y"))


def document(k: Column) -> Column:
    """A triangle of points (the third is missing in every fourth document), edges, and features whose geometry comes from every source."""
    side = (1 + k % 7).cast("double")
    p = [text("[", k * 20.0, ",", F.lit(0.0), "]"), text("[", k * 20.0 + side, ",", F.lit(0.0), "]"), text("[", k * 20.0, ",", side, "]")]
    point = lambda i: text(f'{{"type":"Feature","id":"P{i}","geometry":{{"type":"Point","coordinates":', p[i], "}}")
    edge = lambda i: F.when(k % 3 == 0, text(f'{{"type":"Feature","id":"E{i}","topology":{{"type":"Edge","references":["P{(i + 1) % 3}","P{i}"]}}}}')).otherwise(text(f'{{"type":"Feature","id":"E{i}","topology":{{"type":"Edge","references":["P{i}","P{(i + 1) % 3}"]}}}}'))
    own = lambda id_, topology: text('{"type":"Feature","id":"', id_, '","properties":{"k":', k, '},"topology":', topology, "}")
    name = F.when(k % 2 == 0, text("g:f", k)).otherwise(text("http://g/f", k))
    refs = lambda type_, body: F.lit(f'{{"type":"{type_}","references":{body}}}')
    all_ = [
        own("poly", refs("Polygon", '[["E0","E1","E2"]]')), own("line", refs("LineString", '["P0","nobody","P1"]')), own("lone", refs("LineString", '["P0","nobody"]')),
        own("arc", refs("ArcWithCenter", '["P1","P2","P0"]')), own("spline", refs("CubicSpline", '["P0","P1"]')), own(name, refs("Polygon", '[["nothing"]]')),
        own("walk", F.lit('{"directed_references":[{"ref":"E0"},{"ref":"E0","orientation":"-"}]}')), own("angle", refs("SubtendedAngle", '["P0","P1"]')), own("all", refs("AggregatePolygon", '["poly","face"]')),
    ]
    points = F.concat_ws(",", point(0), point(1), F.when(k % 4 != 1, point(2)))
    face = '{"type":"Feature","id":"face","topology":{"type":"Polygon","references":[["E0","E1","E2"]]}}'
    return F.parse_json(text('{"type":"FeatureCollection","features":[', F.concat_ws(",", *all_), '],"points":[{"type":"FeatureCollection","features":[', points, ']}],"edges":[{"type":"FeatureCollection","features":[', F.concat_ws(",", *[edge(i) for i in range(3)]), ']}],"faces":[', face, "]}"))


def graphs(parts: DataFrame) -> DataFrame:
    """The index of graphs with a square for every part, and for every third a point where its document has its second one."""
    k = F.col("k")
    x, side = k * 20.0, (1 + k % 7).cast("double")
    square = text(":f", k, " a geojson:Feature ; geojson:geometry [ a geojson:Polygon ; geojson:coordinates ( ( ( ", x, " 5.0 ) ( ", x + 1.0, " 5.0 ) ( ", x, " 6.0 ) ( ", x, " 5.0 ) ) ) ] .\n")
    point = F.when(k % 3 == 1, text(":p", k, " a geojson:Feature ; geojson:geometry [ a geojson:Point ; geojson:coordinates ( ", x + side, " 0.0 ) ] .\n")).otherwise("")
    rows = parts.select(F.format_string("f%06d", F.floor(k / 500).cast("int")).alias(D), "k", F.concat(square, point).alias("t"))
    body = rows.groupBy(D).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda s: s["t"]), "").alias("t"))
    texts = body.select(D, F.concat(F.lit("@prefix : <http://g/> . @prefix geojson: <https://purl.org/geojson/vocab#> .\n"), "t").alias("text"))
    return stored(graph.merged(graph.index(stored(turtle.named(in_place(texts))))))


def parts(spark: SparkSession, sf_dir: str, mode: str) -> tuple[DataFrame, DataFrame]:
    every = part(spark, sf_dir)
    docs = every.select(D, document(F.col("k")).alias("doc"))
    return convert.converted(docs, graphs(every), None, namespaces.table(every.sparkSession, {"g": "http://g/"}), mode, densify=True, sagitta=0.5)


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature that documents come to, with its geometry or the reason why it has none."""
    rows, reasons = parts(spark, sf_dir, "edges,faces")
    n = F.coalesce(F.when(F.col("point").isNotNull(), F.lit(1)), F.size("line"), F.size(F.flatten("rings")), F.size(F.flatten(F.flatten("polygons"))))
    short = F.when(F.col("geom_type") != "LineString", features.coordinates())
    none = lambda t: F.lit(None).cast(t)
    made = rows.where(~F.contains("ord", F.lit(".d"))).select(D, "id", "mode", "geom_type", n.cast("long").alias("n_vertices"), short.alias("coordinates"), F.to_json(F.get("line", F.lit(0))).alias("first"), F.to_json(F.get("line", F.size("line") - 1)).alias("last"), none("string").alias("reason"))
    return made.unionByName(reasons.select(D, "id", none("string").alias("mode"), none("string").alias("geom_type"), none("long").alias("n_vertices"), *[none("string").alias(c) for c in ("coordinates", "first", "last")], "reason"))


def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges and points that polygons of documents are made of, with their ids."""
    rows, _ = parts(spark, sf_dir, "points,edges")
    return rows.where(F.contains("ord", F.lit(".d"))).select(D, "mode", "id", features.coordinates().alias("coordinates"))


def coincident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point that each of some shifted points becomes when coincident ones are one: those made from the suppliers lie in chains across cells of the tolerance."""
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("d"), (k % 3).cast("string")).alias(D), k.cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    # the second is near the first, the third near the second and only in some chains near the first, the last far off
    offset = F.element_at(F.array(*map(F.lit, (0.45, 1.2, 1.9, 40.0))), F.col("j") + 1) * (0.6 + 0.2 * (F.col("k") % 3)) * 2.0**-10
    point = rows.select(D, F.format_string("%d-%d", "k", "j").alias("id"), (F.col("k") * 4 + F.col("j")).cast("long").alias("ord"), (F.col("k").cast("double") + offset).alias("x"), F.lit(0.5).alias("y"), (F.col("k") % 5).cast("double").alias("z"))
    return resolve.representatives(point, 2.0**-10)


_N = "(1.0 / {f} / (2 - 1.0 / {f}))"
_BETA = ("n/2 - 2*n*n/3 + 37*n*n*n/96 - n*n*n*n/360", "n*n/48 + n*n*n/15 - 437*n*n*n*n/1440", "17*n*n*n/480 - 37*n*n*n*n/840", "4397*n*n*n*n/161280")
_DELTA = ("2*n - 2*n*n/3 - 2*n*n*n + 116*n*n*n*n/45", "7*n*n/3 - 8*n*n*n/5 - 227*n*n*n*n/45", "56*n*n*n/15 - 136*n*n*n*n/35", "4279*n*n*n*n/630")
_SINH, _COSH = "((exp({0}) - exp(-({0}))) / 2)", "((exp({0}) + exp(-({0}))) / 2)"
_SYSTEMS = f"""WITH k AS (SELECT p_partkey AS k FROM part),
f AS (SELECT k, 'p' AS id, 350000.0 + k % 300 * 1000 AS x, 6200000.0 + k % 911 * 1000 AS y, CAST(k % 7 AS DOUBLE) AS h,
   CASE WHEN k % 7 = 0 THEN 3857 WHEN k % 5 = 0 THEN 7849 + k % 3 WHEN k % 3 = 0 THEN 28350 + k % 4 WHEN k % 2 = 0 THEN 32748 + k % 5 END AS code FROM k
 UNION ALL SELECT k, 'g', 1600000.0, 5400000.0 + k, 1.0, CASE WHEN k % 11 = 0 THEN 2193 END FROM k),
z AS (SELECT *, CASE WHEN code = 2193 THEN 173 WHEN code BETWEEN 7846 AND 7859 THEN 6 * (code - 7800) - 183 WHEN code BETWEEN 28346 AND 28359 THEN 6 * (code - 28300) - 183 ELSE 6 * (code - 32700) - 183 END AS l0,
   CASE WHEN code = 2193 THEN 1600000.0 ELSE 500000.0 END AS e0, CASE WHEN code > 32000 THEN {_N.format(f='298.257223563')} ELSE {_N.format(f='298.257222101')} END::DOUBLE AS n FROM f),
b AS (SELECT *, 0.9996 * 6378137.0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) AS r FROM z),
c AS (SELECT *, (y - 10000000.0) / r AS xi, (x - e0) / r AS eta FROM b),
d AS (SELECT *, xi - {" - ".join(f"({c}) * sin({2 * j} * xi) * {_COSH.format(f'{2 * j} * eta')}" for j, c in enumerate(_BETA, 1))} AS u,
             eta - {" - ".join(f"({c}) * cos({2 * j} * xi) * {_SINH.format(f'{2 * j} * eta')}" for j, c in enumerate(_BETA, 1))} AS v FROM c),
e AS (SELECT *, asin(sin(u) / {_COSH.format('v')}) AS chi, atan2({_SINH.format('v')}, cos(u)) AS l FROM d)
SELECT concat('d:', k) AS dataset_id, id, 'Point' AS geom_type,
  round(CASE WHEN code IS NULL THEN x WHEN code = 3857 THEN degrees(x / 6378137.0) ELSE l0 + degrees(l) END, 9) AS lon,
  round(CASE WHEN code IS NULL THEN y WHEN code = 3857 THEN degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2) ELSE degrees(chi + {" + ".join(f"({c}) * sin({2 * j} * chi)" for j, c in enumerate(_DELTA, 1))}) END, 9) AS lat, h AS height,
  CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN 350000.0 + k % 300 * 1000 END AS native_x, CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN 6200000.0 + k % 911 * 1000 END AS native_y FROM e
UNION ALL SELECT concat('d:', k), 'n', NULL, NULL, NULL, NULL, NULL, NULL FROM k"""

_DOC = """k AS (SELECT p_partkey AS k, CAST(1 + p_partkey % 7 AS DOUBLE) AS s, p_partkey % 4 <> 1 AS whole, p_partkey % 3 = 0 AS back FROM part),
p AS (SELECT *, concat('[', k * 20.0::DOUBLE, ',0.0]') AS p0, concat('[', k * 20.0::DOUBLE + s, ',0.0]') AS p1, concat('[', k * 20.0::DOUBLE, ',', s, ']') AS p2 FROM k),
-- the first edge decides which way round the ring goes; without the third point it is that edge there and back
r AS (SELECT *, CASE WHEN whole AND back THEN concat('[', p2, ',', p1, ',', p0, ',', p2, ']') WHEN whole THEN concat('[', p0, ',', p1, ',', p2, ',', p0, ']') WHEN back THEN concat('[', p1, ',', p0, ',', p1, ']') ELSE concat('[', p0, ',', p1, ',', p0, ']') END AS ring FROM p),
e AS (SELECT *, unnest([0, 1, 2]) AS i FROM r), ee AS (SELECT *, CASE i WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS a, CASE i WHEN 0 THEN p1 WHEN 1 THEN p2 ELSE p0 END AS b FROM e WHERE whole OR i = 0)"""
SQL = {
    "feature_walk": """WITH k AS (SELECT p_partkey AS k, 1 + p_partkey % 6 AS d FROM part),
 f AS (SELECT k, d, 'a' AS id, 1 AS i, 1 AS place FROM k UNION ALL SELECT k, d, 'b', 1, 2 FROM k UNION ALL SELECT k, d, concat('s', i), i, i + 2 FROM (SELECT k, d, unnest(range(1, d + 1)) AS i FROM k) q)
 SELECT concat('d:', k) AS dataset_id, id, CAST(place AS BIGINT) AS place, CAST(d - i + 2 AS BIGINT) AS depth, CASE WHEN i + (k + i + 1) % 2 <= d THEN concat('c', i + (k + i + 1) % 2) END AS crs FROM f""",
    "document_systems": _SYSTEMS,
    "converted_features": f"""WITH {_DOC},
 theta AS (SELECT *, CASE WHEN 0.5 >= s THEN pi() ELSE 2 * acos(1 - 0.5 / s) END AS th FROM r)
 SELECT concat('d:', k) AS dataset_id, id, mode, geom_type, CAST(n AS BIGINT) AS n_vertices, coordinates, first, last, reason FROM (
  SELECT k, concat('E', i) AS id, 'edges' AS mode, 'LineString' AS geom_type, 2 AS n, NULL AS coordinates, CASE WHEN back THEN b ELSE a END AS first, CASE WHEN back THEN a ELSE b END AS last, NULL AS reason FROM ee
  UNION ALL SELECT k, unnest(['face', 'poly']), 'faces', 'Polygon', CASE WHEN whole THEN 4 ELSE 3 END, concat('[', ring, ']'), NULL, NULL, NULL FROM r
  UNION ALL SELECT k, 'all', 'faces', 'MultiPolygon', CASE WHEN whole THEN 4 ELSE 3 END, concat('[[', ring, ']]'), NULL, NULL, NULL FROM r
  UNION ALL SELECT k, 'walk', 'faces', 'Polygon', 3, concat('[[', CASE WHEN back THEN concat(p1, ',', p0, ',', p1) ELSE concat(p0, ',', p1, ',', p0) END, ']]'), NULL, NULL, NULL FROM r
  UNION ALL SELECT k, unnest(['line', 'spline']), 'edges', 'LineString', 2, NULL, p0, p1, NULL FROM r
  UNION ALL SELECT k, unnest(['E1', 'E2']), NULL, NULL, NULL, NULL, NULL, NULL, 'REFERENCES_AND_ID_UNKNOWN' FROM r WHERE NOT whole
  UNION ALL SELECT k, 'lone', NULL, NULL, NULL, NULL, NULL, NULL, 'REFERENCES_AND_ID_UNKNOWN' FROM r
  UNION ALL SELECT k, 'arc', 'edges', 'LineString', greatest(1, CAST(ceil(pi() / 2 / th - 1e-12) AS BIGINT)) + 1, NULL, p1, p2, NULL FROM theta WHERE whole
  -- without its end the arc is the line through the points that there are
  UNION ALL SELECT k, 'arc', 'edges', 'LineString', 2, NULL, p1, p0, NULL FROM r WHERE NOT whole
  UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN concat('g:f', k) ELSE concat('http://g/f', k) END, 'faces', 'Polygon', 4, concat('[[[', k * 20.0::DOUBLE, ',5.0],[', k * 20.0::DOUBLE + 1, ',5.0],[', k * 20.0::DOUBLE, ',6.0],[', k * 20.0::DOUBLE, ',5.0]]]'), NULL, NULL, NULL FROM r
 ) q""",
    "decomposed_polygons": f"""WITH {_DOC},
 v AS (SELECT k, s, back, i, 0 AS j, CASE WHEN back THEN b ELSE a END AS c FROM ee UNION ALL SELECT k, s, back, i, 1, CASE WHEN back THEN a ELSE b END FROM ee),
 u AS (SELECT k, s, c, min(i * 2 + j) AS o FROM v GROUP BY k, s, c), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS n FROM u),
 line AS (SELECT k, i, concat('[', string_agg(c, ',' ORDER BY j), ']') AS c FROM v GROUP BY k, i)
 SELECT concat('d:', k) AS dataset_id, 'edges' AS mode, concat('E', i) AS id, c AS coordinates FROM line
 UNION ALL SELECT concat('d:', w.k), 'points', CASE WHEN w.k % 3 = 1 AND c = p1 THEN concat('http://g/p', w.k) ELSE concat('E', o // 2, ':', n) END, c FROM w JOIN p ON p.k = w.k
 -- a walk there and back over the first edge has that edge and its points too, in the order in which the edge is stored
 UNION ALL SELECT concat('d:', k), 'edges', 'E0', c FROM line WHERE i = 0
 UNION ALL SELECT concat('d:', v.k), 'points', CASE WHEN v.k % 3 = 1 AND c = p1 THEN concat('http://g/p', v.k) ELSE concat('E0:', j + 1) END, c FROM v JOIN p ON p.k = v.k WHERE i = 0""",
    "coincident_points": """WITH p AS (SELECT concat('d', s_suppkey % 3) AS dataset_id, s_suppkey AS k, j, s_suppkey + [0.45, 1.2, 1.9, 40.0][j + 1] * (0.6 + 0.2 * (s_suppkey % 3)) / 1024 AS x FROM supplier CROSS JOIN (SELECT unnest(range(4)) AS j) z),
 near AS (SELECT a.k, a.j, b.j AS before FROM p a JOIN p b ON a.k = b.k AND b.j < a.j AND abs(a.x - b.x) < 1.0 / 1024),
 -- chains have at most three points: the first stands for itself, its near ones don't, and so those may that are near to none but them
 one AS (SELECT k, j FROM p EXCEPT SELECT k, j FROM near), gone AS (SELECT DISTINCT n.k, n.j FROM near n JOIN one ON one.k = n.k AND one.j = n.before), own AS (SELECT k, j FROM p EXCEPT SELECT k, j FROM gone)
 SELECT dataset_id, concat(p.k, '-', p.j) AS id, concat(p.k, '-', coalesce((SELECT min(before) FROM near n JOIN own ON own.k = n.k AND own.j = n.before WHERE n.k = p.k AND n.j = p.j), p.j)) AS "to" FROM p""",
}
QUERIES = {"feature_walk": walk, "document_systems": systems, "converted_features": converted, "decomposed_polygons": decomposed, "coincident_points": coincident}

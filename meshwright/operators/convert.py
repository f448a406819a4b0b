"""Documents to features with geometry: collections level by level, then features with a topology of their own, each from the first source that has it.

A reference means what the document says (points, then what earlier levels made), else what the index of graphs says.  A feature's geometry is that of its arc or
spline, else of its references, else what the index has under its id; where all fail, the reason says so.  Coordinates are columns by depth (``sources.features.SHAPE``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import crs
from ..functions.geometry import chain
from ..sources.csdm import get, items, kind, number, text
from ..sources.features import KEYS, LEVELS, SHAPE, D, coordinates, normalised
from ..storage import discard, stored
from . import curves, namespaces

KEY = [D, "key", "at"]
#: Types of topology that are never drawn, the arcs by their lower-case names, what a geometry counts as, and the style of tangents.
SKIPPED = ("subtendedangle",)
ARCS = {"arc": "Arc", "arcwithcenter": "ArcWithCenter", "arcbychord": "ArcByChord", "circlebycenter": "CircleByCenter"}
MODES = {"Point": "points", "LineString": "edges", "MultiLineString": "rings", "Polygon": "faces", "MultiPolygon": "faces"}
TANGENT_STYLE = '"stroke":"#d62728","stroke-width":2,"stroke-opacity":1,"stroke-dasharray":"6 4"'
OUT = [D, "ord", "mode", "id", "geom_type", *SHAPE, "geometries", "properties"]


def ordered(value: Column | str, *by: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, value.alias("_v")))), lambda s: s["_v"])


def shaped(**have: Column) -> list[Column]:
    return [have.get(c, F.lit(None)).cast(t).alias(c) for c, t in SHAPE.items()]


def as_shapes(rows: DataFrame, column: str = "coordinates") -> DataFrame:
    """rows with the columns of SHAPE, read from coordinates as JSON."""
    deep = F.length(F.regexp_extract(column, r"^(\[\s*)*", 0)) - F.length(F.regexp_replace(F.regexp_extract(column, r"^(\[\s*)*", 0), r"\[", ""))
    return rows.select("*", *[F.when(deep == n, F.from_json(column, t)).alias(c) for n, (c, t) in enumerate(SHAPE.items(), 1)])


class Sources:
    """What references mean: what each document has, by dataset and id, else what the index of graphs has under any name that the prefixes allow."""

    def __init__(self, graph: DataFrame | None, names: DataFrame | None):
        self.known: DataFrame | None = None
        self.graph = None if graph is None else stored(as_shapes(graph.where("coordinates is not null").select("key", "geom_type", "coordinates")).select("key", F.struct("geom_type", *SHAPE).alias("g")))
        self.names = names

    def add(self, rows: DataFrame) -> None:
        new = stored(rows.where("id is not null").select(D, "id", "at", *SHAPE).groupBy(D, "id").agg(F.max_by(F.struct(*SHAPE), "at").alias("x")))
        if self.known is None:
            self.known = new
        elif self.known.join(new, [D, "id"], "left_semi").isEmpty():
            self.known = self.known.unionByName(new)
        else:
            self.known = stored(new.unionByName(self.known.join(new, [D, "id"], "left_anti")))

    def graphed(self, refs: DataFrame) -> DataFrame:
        """dataset_id, ref and g, what the index has for references (dataset_id, ref)."""
        ids = refs.select(D, "ref").where("ref is not null").distinct()
        if self.names is not None:
            return namespaces.looked_up(ids, self.keys(ids), self.names, "key").where("found is not null").join(self.graph.withColumnRenamed("key", "found"), "found").select(D, "ref", "g")
        return ids.join(self.graph.withColumnRenamed("key", "ref"), "ref").select(D, "ref", "g")

    def keys(self, ids: DataFrame) -> DataFrame:
        """The keys of the index that any dataset's references may mean: those among the candidates of its references."""
        every = namespaces.candidates(ids, self.names).select(D, "key").distinct()
        return every.join(self.graph.select("key"), "key", "left_semi")

    def looked_up(self, refs: DataFrame) -> DataFrame:
        """refs with x (the columns of SHAPE), of the document or else of the index, and graph, the index's own."""
        out = refs.join(self.known.withColumnRenamed("id", "ref"), [D, "ref"], "left")
        if self.graph is None:
            return out.withColumn("graph", F.lit(None).cast("struct<" + ",".join(f"{c}:{t}" for c, t in {"geom_type": "string", **SHAPE}.items()) + ">"))
        out = out.join(self.graphed(refs).withColumnRenamed("g", "graph"), [D, "ref"], "left")
        return out.withColumn("x", F.coalesce("x", F.when(F.col("graph").isNotNull(), F.struct(*[F.col("graph")[c].alias(c) for c in SHAPE]))))


def topologies(f: DataFrame) -> DataFrame:
    """Features with a topology: f's columns and type (lower case), directed (whether its references are directed ones)."""
    t = f.where(kind(get("f", "$.topology")).startswith("OBJECT") & (kind(get("f", "$.topology")) != "OBJECT<>"))
    t = t.withColumn("type", F.lower(F.coalesce(text("f", "$.topology.type"), F.lit(""))))
    return t.where(~F.col("type").isin(*SKIPPED)).withColumn("directed", kind(get("f", "$.topology.references")) == "VOID")


def references(t: DataFrame) -> DataFrame:
    """dataset_id, key, at, type, directed, o and i (places in the outer and inner list), listed (whether the outer element is a list), ref, orientation."""
    cols = [*KEY, "type", "directed"]
    plain = t.where("not directed").select(*cols, F.posexplode(items("f", "$.topology.references")).alias("o", "r"))
    listed = kind("r").startswith("ARRAY")
    plain = plain.select(*cols, "o", listed.alias("listed"), F.posexplode(F.when(listed, items("r", "$")).otherwise(F.array("r"))).alias("i", "v")).select(*cols, "o", "listed", "i", text("v").alias("ref"), F.lit("+").alias("orientation"))
    given = F.when(kind(get("f", "$.topology.directed_references")) != "VOID", items("f", "$.topology.directed_references")).otherwise(items("f", "$.topology.shells"))
    walked = t.where("directed").select(*cols, F.posexplode(given).alias("o", "r")).select(*cols, "o", F.lit(False).alias("listed"), F.lit(0).alias("i"), text("r", "$.ref").alias("ref"), F.coalesce(text("r", "$.orientation"), F.lit("+")).alias("orientation"))
    return plain.unionByName(walked)


def assembled(t: DataFrame, sources: Sources, alone: bool) -> DataFrame:
    """dataset_id, key, at, geom_type and SHAPE's columns of topologies whose references lead to coordinates; others have no row.

    Polygons are rings of lines, chained, or single references that the index knows; AggregatePolygons put polygons together, MultiLineStrings lists of points, and other flat references points to a point or a line (a
    LineString or an Edge has two at least).  Directed references put together what lies one level below: lines to a ring, rings to a polygon, polygons to polygons; "-" reverses the list that it refers to.
    alone: for a feature of its own, whose directed points or lines are a polygon of one ring, without the joints.
    """
    at = stored(sources.looked_up(references(t)).where("x is not null"))
    x = F.col("x")
    segment = F.when(F.coalesce(F.col("graph.geom_type") == "LineString", F.lit(False)), F.col("graph.line")).otherwise(F.coalesce(x["line"], F.when(x["point"].isNotNull(), F.array(x["point"]))))
    give = lambda df, name, **have: df.select(*KEY, (F.lit(name) if isinstance(name, str) else name).alias("geom_type"), *shaped(**have))
    plain, typed = at.where("not directed"), lambda *names: F.col("type").isin(*names)

    ring = plain.where(typed("polygon") & F.col("listed")).withColumn("seg", segment).where("seg is not null").groupBy(*KEY, "o").agg(ordered("seg", "i").alias("segs")).select(*KEY, "o", F.array(chain(F.col("segs"))).alias("ring"))
    single = plain.where(typed("polygon") & ~F.col("listed")).select(*KEY, "o", F.coalesce(F.col("graph.rings"), F.when(F.col("graph.line").isNotNull(), F.array("graph.line"))).alias("ring")).where("ring is not null")
    parts = [give(ring.unionByName(single).groupBy(*KEY).agg(F.flatten(ordered("ring", "o")).alias("all")), "Polygon", rings=F.col("all"))]

    polygons = plain.where(typed("aggregatepolygon")).withColumn("c", F.coalesce(x["polygons"], F.when(x["rings"].isNotNull(), F.array(x["rings"])))).where("c is not null")
    parts.append(give(polygons.groupBy(*KEY).agg(F.flatten(ordered("c", "o", "i")).alias("all")), "MultiPolygon", polygons=F.col("all")))

    lines = plain.where(typed("multilinestring") & x["point"].isNotNull()).groupBy(*KEY, "o").agg(ordered(x["point"], "i").alias("each")).where("size(each) >= 2")
    parts.append(give(lines.groupBy(*KEY).agg(ordered("each", "o").alias("all")), "MultiLineString", rings=F.col("all")))

    flat = plain.where(~typed("polygon", "aggregatepolygon", "multilinestring"))
    nested = flat.where("listed").select(*KEY).distinct()
    points = flat.where(x["point"].isNotNull() & ~F.col("listed")).join(nested, KEY, "left_anti").groupBy(*KEY, "type").agg(ordered(x["point"], "o").alias("pts"))
    one = (F.size("pts") == 1) & ~typed("linestring", "edge")
    parts.append(give(points.where(one | (F.size("pts") >= 2)), F.when(one, "Point").otherwise("LineString"), point=F.when(one, F.get("pts", F.lit(0))), line=F.when(~one, F.col("pts"))))

    walked = at.where("directed")
    turned = lambda c: F.when(F.col("orientation") == "-", F.reverse(c)).otherwise(c)
    below = walked.select(*KEY, "o", turned(F.coalesce(x["line"], F.when(x["point"].isNotNull(), F.array(x["point"])))).alias("l"), turned(x["rings"]).alias("r"), turned(x["polygons"]).alias("s"))
    whole = below.groupBy(*KEY).agg(*[F.filter(ordered(c, "o"), lambda v: v.isNotNull()).alias(c) for c in "lrs"])
    line = F.flatten(F.transform("l", lambda p, i: F.when(i == 0, p).otherwise(F.slice(p, F.lit(2), F.size(p)))))
    bare = F.flatten("l")
    edge = F.lit(alone) | (F.col("key") == "edges")
    level = F.when(F.size("s") > 0, 4).when(F.size("r") > 0, 3).otherwise(2)
    put = whole.withColumn("level", level).withColumn("line", F.when(edge, line).otherwise(bare))
    name = F.when(F.col("level") > 2, "MultiPolygon").when(F.lit(alone), "Polygon").when(F.col("key") == "edges", "LineString").otherwise("MultiLineString")
    as_line = (F.col("level") == 2) & (F.col("key") == "edges") & F.lit(not alone)
    parts.append(give(put, name, line=F.when(as_line, F.col("line")), rings=F.when((F.col("level") == 2) & ~as_line, F.array("line")), polygons=F.when(F.col("level") == 3, F.array(F.flatten("r"))).when(F.col("level") == 4, F.flatten("s"))))
    return reduce(DataFrame.unionByName, parts)


def curved(t: DataFrame, sources: Sources, natives: DataFrame, densify: bool, sagitta: float, alpha: float) -> DataFrame:
    """dataset_id, key, at, geom_type and SHAPE's columns of splines and (on request) arcs and circles.

    Where all points that a curve refers to have a native position, it is drawn there, as the tolerance is in those units, and then moved to longitude and latitude; else among the coordinates at hand.
    """
    t = t.where(F.col("type").isin("cubicspline", *(ARCS if densify else ())))
    if t.isEmpty():
        return t.select(*KEY, F.lit("").alias("geom_type"), *shaped()).limit(0)
    role = lambda path, name: t.select(*KEY, F.lit(name).alias("role"), F.posexplode(items("f", path)).alias("o", "v")).select(*KEY, "role", "o", text("v").alias("ref"))
    refs = role("$.topology.references", "a").unionByName(role("$.topology.startTangentVector.references", "b")).unionByName(role("$.topology.endTangentVector.references", "c")).where("ref is not null")
    at = sources.looked_up(refs).join(natives.select(D, F.col("id").alias("ref"), "native", "system"), [D, "ref"], "left")
    of = lambda r, c: F.filter(F.transform(F.filter("all", lambda s: s["role"] == r), lambda s: s[c]), lambda v: v.isNotNull())
    g = at.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("role", "o", F.col("x.point").alias("c"), "native"))).alias("all"), F.bool_and(F.col("native").isNotNull()).alias("own"), F.first("system", ignorenulls=True).alias("system"))
    pick = lambda r: F.when(F.col("own"), of(r, "native")).otherwise(of(r, "c"))
    radius = F.coalesce(number("f", "$.topology.radius"), number("f", "$.radius"), number("f", "$.properties.radius"))
    rows = t.select(*KEY, "type", radius.alias("radius"), F.lower(F.coalesce(text("f", "$.topology.orientation"), F.lit("ccw"))).alias("orientation")).join(g, KEY)
    rows = rows.select(*KEY, "type", "radius", "orientation", F.when(F.col("own"), F.col("system")).alias("system"), pick("a").alias("p"), pick("b").alias("_s"), pick("c").alias("_e"))
    rows = stored(rows.withColumn("first", curves.tangent("_s")).withColumn("last", curves.tangent("_e")).drop("_s", "_e"))
    spline = curves.splined(rows.where("type = 'cubicspline' and size(p) >= 2"), sagitta, alpha)
    # a spline that can't be drawn is the straight line through its points
    made = spline.select(*KEY, F.coalesce("line", "p").alias("line"), "system", F.lit(False).alias("round"))
    if densify:
        arcs = rows.where("type <> 'cubicspline'").drop("first", "last")
        name = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), ARCS.items(), F.when(F.lit(False), ""))
        # the centre comes last in a document
        p = F.when((F.col("type") == "arcwithcenter") & (F.size("p") >= 3), F.array(F.get("p", F.lit(0)), F.get("p", F.lit(2)), F.get("p", F.lit(1)))).otherwise(F.col("p"))
        arcs = curves.densified(arcs.withColumn("p", p).withColumn("type", name), sagitta)
        made = made.unionByName(arcs.where("line is not null").select(*KEY, "line", "system", (F.col("type") == "CircleByCenter").alias("round")))
    made = made.withColumn("line", F.transform("line", lambda q: crs.moved(q, F.col("system"))))
    return stored(made.select(*KEY, F.when(F.col("round"), "Polygon").otherwise("LineString").alias("geom_type"), *shaped(line=F.when(~F.col("round"), F.col("line")), rings=F.when(F.col("round"), F.array("line")))))


def spline_extras(t: DataFrame, sources: Sources) -> DataFrame:
    """The control points of splines and their tangents, as features after them (ord, mode, …)."""
    s = t.where("type = 'cubicspline'")
    base = [*KEY, "id", "ord"]
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    control = s.select(*base, F.posexplode(items("f", "$.topology.references")).alias("o", "v")).withColumn("ref", text("v")).where("ref is not null")
    control = sources.looked_up(control).where("x.point is not null")
    control = control.select(D, F.concat("ord", F.format_string(".b%06d", "o")).alias("ord"), F.lit("points").alias("mode"), F.col("ref").alias("id"), F.lit("Point").alias("geom_type"), *shaped(point=F.col("x.point")), F.concat(F.lit('{"role":"spline-control-point","spline":'), quoted(F.col("id")), F.lit("}")).alias("properties"))
    ends = []
    for k, name in enumerate(("start", "end")):
        refs = s.select(*base, F.posexplode(items("f", f"$.topology.{name}TangentVector.references")).alias("o", "v")).withColumn("ref", text("v")).where("ref is not null")
        seg = sources.looked_up(refs).where("x.point is not null").groupBy(*base).agg(ordered("x.point", "o").alias("seg")).where("size(seg) >= 2")
        ends.append(seg.select(D, F.concat("ord", F.lit(f".c{k}")).alias("ord"), F.lit("edges").alias("mode"), F.concat("id", F.lit(f"-{name}-tangent")).alias("id"), F.lit("LineString").alias("geom_type"), *shaped(line=F.col("seg")), F.concat(F.lit(f'{{"role":"spline-tangent","position":"{name}","spline":'), quoted(F.col("id")), F.lit(f",{TANGENT_STYLE}}}")).alias("properties")))
    return reduce(DataFrame.unionByName, ends, control).withColumn("geometries", F.lit(None).cast("string")).select(*OUT)


def decomposed(t: DataFrame, sources: Sources) -> DataFrame:
    """The edges and points of polygons (t: topologies with ord) whose references are lines or points, as features after them.

    An edge comes once for each id, a point once for each position, in the order of references; a point has the id under which the index has its exact position (of several keys an IRI), else that of its reference and its number among the points.  What lies deeper is left out.
    """
    refs = references(t).join(t.select(*KEY, "ord"), KEY)
    at = sources.looked_up(refs.where("ref is not null"))
    g = F.col("graph")
    line, point = F.when(g.isNotNull(), g["line"]).otherwise(F.col("x.line")), F.when(g.isNotNull(), g["point"]).otherwise(F.col("x.point"))
    at = stored(at.select(D, "ord", "o", "i", "ref", line.alias("line"), point.alias("point")).where("line is not null or point is not null"))
    edges = at.where("line is not null").groupBy(D, "ord", "ref").agg(F.min(F.struct("o", "i", "line")).alias("m"))
    edges = edges.select(D, "ord", F.struct("m.o", "m.i", F.lit(-1).alias("j")).alias("place"), F.lit("edges").alias("mode"), F.col("ref").alias("id"), F.col("m.line").alias("line"), F.lit(None).cast("array<double>").alias("point"))
    each = at.select(D, "ord", "o", "i", "ref", F.col("line").isNull().alias("bare"), F.posexplode(F.coalesce("line", F.array("point"))).alias("j", "c"))
    first = each.groupBy(D, "ord", "c").agg(F.min(F.struct("o", "i", "j", "ref", "bare")).alias("m"))
    # numbers run within a polygon, whose points fit a row as its geometry does
    listed = first.groupBy(D, "ord").agg(F.array_sort(F.collect_list(F.struct("m", "c"))).alias("all"))
    points = listed.select(D, "ord", F.posexplode("all").alias("n", "s")).select(D, "ord", (F.col("n") + 1).alias("n"), "s.m.*", "s.c")
    points = points.withColumn("ck", F.to_json("c"))
    if sources.graph is not None:
        named = sources.graph.where("g.point is not null").groupBy(F.to_json("g.point").alias("ck")).agg(F.max(F.struct(F.contains("key", F.lit("://")), "key"))["key"].alias("name"))
        points = points.join(named, "ck", "left")
    else:
        points = points.withColumn("name", F.lit(None).cast("string"))
    id_ = F.when(F.col("bare"), F.col("ref")).otherwise(F.coalesce("name", F.concat("ref", F.lit(":"), F.col("n").cast("string"))))
    points = points.select(D, "ord", F.struct("o", "i", "j").alias("place"), F.lit("points").alias("mode"), id_.alias("id"), F.lit(None).cast(SHAPE["line"]).alias("line"), F.col("c").alias("point"))
    out = edges.unionByName(points).withColumn("ord", F.concat("ord", F.format_string(".d%06d.%06d.%06d", F.col("place.o"), F.col("place.i"), F.col("place.j") + 1)))
    return out.select(D, "ord", "mode", "id", F.when(F.col("mode") == "edges", "LineString").otherwise("Point").alias("geom_type"), *shaped(line=F.col("line"), point=F.col("point")), F.lit(None).cast("string").alias("geometries"), F.lit("{}").alias("properties"))


def of_components(t: DataFrame, components: DataFrame) -> DataFrame:
    """The edges and points that an index of components (key, kind, component, coordinates) has for features (t: topologies with ord and found, their key)."""
    at = as_shapes(t.select(D, "ord", F.col("found").alias("key")).join(components, "key"))
    return at.select(D, F.concat("ord", F.when(F.col("kind") == "edges", ".e.").otherwise(".p."), F.col("component")).alias("ord"), F.col("kind").alias("mode"), F.col("component").alias("id"), F.when(F.col("kind") == "edges", "LineString").otherwise("Point").alias("geom_type"), *SHAPE, F.lit(None).cast("string").alias("geometries"), F.lit("{}").alias("properties"))


def custom(objects: str | None) -> dict[str, str]:
    """Further collections, written ``key:Type,…``."""
    out = {}
    for part in objects.split(",") if objects else ():
        key, colon, type_ = (x.strip() for x in part.partition(":"))
        if not (key and colon and type_):
            raise ValueError(f"objects are written key:Type, not {part!r}")
        out[key] = type_
    return out


def converted(
    docs: DataFrame, graph: DataFrame | None = None, components: DataFrame | None = None, names: DataFrame | None = None, mode: str = "points,edges,faces", objects: str | None = None,
    number: int | None = None, densify: bool = False, sagitta: float = 0.02, alpha: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """The features of documents (dataset_id, doc), and those that have none.

    Features: dataset_id, ord (their order), mode (what they count as), id, geom_type, SHAPE's columns, geometries and properties (JSON).  The others: dataset_id, id and reason.
    graph and components: indices (``graph.index``, ``graph.component_index`` or ``graph.merged`` of them), names: prefixes (``namespaces.table``).  mode: a text that names the kinds wanted.  number: at most so
    many features of a document; points of its own are not counted.  A document without points raises an error if no graph is given.
    """
    extra = custom(objects)
    levels = [*LEVELS, *extra]
    f = stored(normalised(docs, tuple(dict.fromkeys([*KEYS, *extra]))))
    has_points = f.where("key = 'points'").select(D).distinct()
    inline = f.where("key = 'points'").unionByName(f.where("key = 'features' and geom_type = 'Point'").join(has_points, D, "left_anti"))
    if graph is None:
        lost = docs.select(D).join(inline.select(D), D, "left_anti")
        if not lost.isEmpty():
            raise ValueError("no point geometries found in documents or graphs")
    sources = Sources(graph, names)
    sources.add(inline.where("point is not null or line is not null or rings is not null or polygons is not null"))
    natives = stored(f.where("native is not null and id is not null").groupBy(D, "id").agg(F.max_by("native", "at").alias("native"), F.first("system").alias("system")))
    properties = lambda v: F.coalesce(F.when(kind(get(v, "$.properties")).startswith("OBJECT"), F.to_json(get(v, "$.properties"))), F.lit("{}"))
    place = lambda n: F.concat(F.lit(f"{n:02d}"), F.col("at"))
    out = [inline.select(D, place(0).alias("ord"), F.lit("points").alias("mode"), "id", "geom_type", *SHAPE, "geometries", properties("f").alias("properties"))]
    t = stored(topologies(f).withColumn("ord", reduce(lambda c, k: c.when(F.col("key") == k[1], place(k[0])), enumerate(levels, 1), F.when(F.lit(False), ""))).withColumn("ord", F.coalesce("ord", place(90))))

    seen: list[DataFrame] = []  # the topologies that have come to something
    for key in levels:
        own = t.where(F.col("key") == key)
        if own.isEmpty():
            continue
        drawn = curved(own, sources, natives, densify, sagitta, alpha)
        made = stored(drawn.unionByName(assembled(own.join(drawn.select(*KEY), KEY, "left_anti"), sources, False)).join(own.select(*KEY, "id", "ord", "f"), KEY))
        # a circle's ring is what others chain
        ring = F.when((F.col("geom_type") == "Polygon") & F.lit(key == "edges"), F.get("rings", F.lit(0)))
        sources.add(made.withColumn("line", F.coalesce("line", ring)).withColumn("rings", F.when(ring.isNull(), F.col("rings"))))
        out.append(made.select(D, "ord", F.lit(key).alias("mode"), "id", "geom_type", *SHAPE, F.lit(None).cast("string").alias("geometries"), properties("f").alias("properties")))
        seen.append(made.select(*KEY))
        if not own.where("type = 'cubicspline'").isEmpty():
            out.append(stored(spline_extras(own, sources)))

    alone = t.where("key = 'features'")
    drawn = curved(alone, sources, natives, densify, sagitta, alpha).withColumn("geometries", F.lit(None).cast("string"))
    rest = alone.join(alone.where("type = 'cubicspline'").select(*KEY).unionByName(drawn.select(*KEY)).distinct(), KEY, "left_anti")
    chained = assembled(rest, sources, True).withColumn("geometries", F.lit(None).cast("string"))
    found = stored(drawn.unionByName(chained))
    if graph is not None:
        asked = rest.join(found.select(*KEY), KEY, "left_anti").withColumn("ref", F.col("id"))
        whole = asked.join(sources.graphed(asked), [D, "ref"]).select(*KEY, "g.geom_type", *[F.col("g")[c].alias(c) for c in SHAPE], F.lit(None).cast("string").alias("geometries"))
        found = stored(found.unionByName(whole))
    single = stored(found.join(alone.select(*KEY, "id", "ord", "f"), KEY))
    seen.append(found.select(*KEY))
    kinds = reduce(lambda c, kv: c.when(F.col("geom_type") == kv[0], kv[1]), MODES.items(), F.when(F.lit(False), ""))
    out.append(single.select(D, "ord", F.coalesce(kinds, F.lit("faces")).alias("mode"), "id", "geom_type", *SHAPE, "geometries", properties("f").alias("properties")))
    if not alone.where("type = 'cubicspline'").isEmpty():
        out.append(stored(spline_extras(alone, sources)))
    areas = stored(alone.join(found.where(F.col("geom_type").isin("Polygon", "MultiPolygon")).select(*KEY), KEY, "left_semi").join(drawn.select(*KEY), KEY, "left_anti"))
    wanted = "edges" in mode or "points" in mode
    if wanted and components is not None:
        held = components.select("key").distinct()
        ids = areas.select(D, F.col("id").alias("ref")).where("ref is not null").distinct()
        if names is not None:
            every = namespaces.candidates(ids, names).select(D, "key").distinct().join(held, "key", "left_semi")
            named = namespaces.looked_up(ids, every, names, "key").where("found is not null").select(D, F.col("ref").alias("id"), "found")
        else:
            named = ids.join(held.withColumnRenamed("key", "ref"), "ref", "left_semi").select(D, F.col("ref").alias("id"), F.col("ref").alias("found"))
        known = stored(areas.join(named, [D, "id"], "left"))
        out.append(stored(of_components(known.where("found is not null"), components)))
        areas = known.where("found is null").drop("found")
    if wanted:
        out.append(stored(decomposed(areas, sources)))

    rows = stored(reduce(DataFrame.unionByName, [o.select(*OUT) for o in out]).where(F.contains(F.lit(mode), F.col("mode"))))
    points = rows.where(F.startswith("ord", F.lit("00"))).select(D, "id").distinct()
    control = F.contains("properties", F.lit('"role":"spline-control-point"'))
    again = rows.where(control).join(points, [D, "id"], "left_semi").select(D, "ord")
    rows = rows.join(again, [D, "ord"], "left_anti")
    if number is not None:
        w = Window.partitionBy(D).orderBy("ord")
        counted = rows.where(~F.startswith("ord", F.lit("00")))
        rows = rows.where(F.startswith("ord", F.lit("00"))).unionByName(counted.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= number).drop("_n"))
    why = F.when(F.size(items("f", "$.topology.references")) + F.size(items("f", "$.topology.directed_references")) + F.size(items("f", "$.topology.shells")) == 0, "NO_REFERENCES").when(F.lit(graph is None), "REFERENCES_UNKNOWN").otherwise("REFERENCES_AND_ID_UNKNOWN")
    reasons = t.join(reduce(DataFrame.unionByName, seen).distinct(), KEY, "left_anti").select(D, "id", why.alias("reason"))
    rows, reasons = stored(rows), stored(reasons)
    discard(f)
    return rows, reasons


def cleaned(rows: DataFrame) -> DataFrame:
    """dataset_id, ord, mode, id and feature (GeoJSON text): only type, geometry, properties and id."""
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    body = F.when(F.col("geometries").isNotNull(), F.concat(F.lit(',"geometries":'), "geometries")).otherwise(F.concat(F.lit(',"coordinates":'), coordinates()))
    geometry = F.when(F.col("geom_type").isNull(), "null").otherwise(F.concat(F.lit('{"type":"'), "geom_type", F.lit('"'), body, F.lit("}")))
    id_ = F.when(F.col("id").isNotNull(), F.concat(F.lit(',"id":'), quoted("id"))).otherwise("")
    return rows.select(D, "ord", "mode", "id", F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), "properties", id_, F.lit("}")).alias("feature"))

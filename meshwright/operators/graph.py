"""Geometries and components of the features of graphs, from their triples (``sources.turtle.named``, ``sources.jsonld.named``).

Every level of topology (edges, rings, faces, shells, solids) is a join; lists, nested coordinates and the closure of references have no depth that is known
beforehand, so they are made in rounds until a round adds nothing, and every round's rows are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import chain, local_name
from ..sources.turtle import DCT, GEOJSON, RDF, TOPO, D, directed, items, value
from ..storage import discard, stored

GEOMETRY = ["geom_type", "coordinates", "geometries"]
#: Geometry types of the vocabulary, whose names are those of GeoJSON.
DIRECT = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
LINES = (TOPO + "Edge", GEOJSON + "LineString")
DIRECTED = (TOPO + "Ring", TOPO + "Face", TOPO + "Shell")


def ordered(value: str | Column, *by: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, value.alias("_v")))), lambda s: s["_v"])


def joined(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def with_lists(t: DataFrame) -> DataFrame:
    """t with the lists written as chains of rdf:first and rdf:rest as items of their heads, like those in brackets.

    A cell finds its head by doubling the distance that it looks back, so a list of n cells takes log2(n) rounds.  Cells of chains without a head (circles) are in no list; of
    chains that share a tail, the one whose cell has the least name has it.
    """
    rest = t.where((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).groupBy(D, F.col("o").alias("cell")).agg(F.min("s").alias("up"))
    first = t.where(F.col("p") == RDF + "first")
    at = stored(first.select(D, F.col("s").alias("cell")).distinct().join(rest, [D, "cell"], "left").withColumn("pos", F.when(F.col("up").isNull(), 0).otherwise(1)))
    many = at.count()
    for _ in range(max(many, 1).bit_length()):
        if at.where("up is not null").isEmpty():
            break
        over = at.select(D, F.col("cell").alias("up"), F.col("up").alias("_up"), F.col("pos").alias("_pos"))
        # a cell whose predecessor is a head has found it: it keeps it as head and looks no further
        step = at.join(over, [D, "up"], "left")
        known = step.select(D, "cell", F.when(F.col("_up").isNotNull(), F.col("_up")).otherwise(F.col("up")).alias("up"), (F.col("pos") + F.when(F.col("_up").isNotNull(), F.col("_pos")).otherwise(0)).alias("pos"), F.col("_up").isNull().alias("done"))
        nxt = stored(known)
        moved = not nxt.where("not done and up is not null").isEmpty()
        discard(at)
        at = nxt.drop("done")
        if not moved:
            break
    if not many:
        return t
    heads = at.where("pos = 0").select(D, F.col("cell").alias("head"))
    place = at.select(D, F.col("cell").alias("s"), F.coalesce("up", "cell").alias("head"), F.col("pos").alias("at")).join(heads, [D, "head"])
    moved = first.join(place, [D, "s"]).withColumn("s", F.col("head")).withColumn("s_id", F.col("head")).withColumn("p", F.lit(RDF + "li")).withColumn("pos", F.col("at").cast("int"))
    return t.where(~F.col("p").isin(RDF + "first", RDF + "rest")).unionByName(moved.select(*t.columns))


def kinds(t: DataFrame) -> DataFrame:
    """node and type (IRI) of every topology node."""
    return value(t, RDF + "type", "type", "node")


def related(t: DataFrame) -> DataFrame:
    """node and head of its list of related features, whose predicate is of either vocabulary."""
    return t.where(F.col("p").isin(TOPO + "relatedFeatures", GEOJSON + "relatedFeatures")).groupBy(D, F.col("s").alias("node")).agg(F.min_by("o", F.struct("p", "o")).alias("head"))


def first_nodes(t: DataFrame) -> DataFrame:
    """s and node: the topology of a feature that others refer to; of several that with the least name."""
    return t.where(F.col("p") == GEOJSON + "topology").groupBy(D, "s").agg(F.min_by("o", F.struct(F.length("o"), "o")).alias("node"))


def nested(t: DataFrame) -> DataFrame:
    """head, coordinates (JSON) and depth of every list of numbers, or of such lists, however deep; IRIs in them are skipped."""
    li = t.where(F.col("p") == RDF + "li").select(D, F.col("s").alias("head"), "pos", F.col("o").alias("item"), (F.col("o_kind") == "literal").alias("plain"))
    first = li.where("pos = 0").select(D, "head", F.col("plain").alias("numbers"))
    li = stored(li.join(first, [D, "head"]))
    number = F.expr("try_cast(item AS double)")
    done = li.where("numbers").groupBy(D, "head").agg(F.to_json(ordered(number, "pos")).alias("coordinates"), F.bool_and(F.col("plain") & number.isNotNull()).alias("ok"))
    done = stored(done.where("ok").select(D, "head", "coordinates", F.lit(1).alias("depth")))
    found, frontier = [done], done
    inner = li.where("not numbers and not plain").join(first.select(D, F.col("head").alias("item")), [D, "item"], "left_semi")
    while not frontier.isEmpty():
        all_ = reduce(DataFrame.unionByName, found)
        # the lists above the last round's, once all lists in them are known
        up = inner.join(frontier.select(D, F.col("head").alias("item")), [D, "item"], "left_semi").select(D, "head").distinct()
        rows = inner.join(up, [D, "head"]).join(all_.select(D, F.col("head").alias("item"), "coordinates", "depth"), [D, "item"], "left")
        made = rows.groupBy(D, "head").agg(joined(ordered("coordinates", "pos")).alias("coordinates"), (F.max("depth") + 1).alias("depth"), F.bool_and(F.col("coordinates").isNotNull()).alias("ok"))
        frontier = stored(made.where("ok").drop("ok"))
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)


def direct(t: DataFrame) -> DataFrame:
    """s, geom_type and coordinates (JSON) of the features with coordinates of their own: of geojson:geometry, else of dct:spatial.

    The type is that of the geometry node, or else follows from the depth of its coordinates.
    """
    lists = nested(t).where("coordinates <> '[]'")
    of = value(t, GEOJSON + "coordinates", "head", "at").join(lists, [D, "head"]).join(value(t, RDF + "type", "type", "at"), [D, "at"], "left")
    named = F.when(F.col("type").isin(*[GEOJSON + x for x in DIRECT]), F.substring("type", len(GEOJSON) + 1, 100))
    of = of.withColumn("geom_type", F.coalesce(named, F.when(F.col("depth") == 1, "Point").when(F.col("depth") == 2, "LineString").otherwise("Polygon")))
    own = [value(t, p, "at").join(of, [D, "at"]).select(D, "s", F.lit(k).alias("k"), F.struct("geom_type", "coordinates", "depth").alias("g")) for k, p in enumerate((GEOJSON + "geometry", DCT + "spatial"))]
    return own[0].unionByName(own[1]).groupBy(D, "s").agg(F.min_by("g", "k").alias("g")).select(D, "s", "g.*")


def positions(own: DataFrame) -> DataFrame:
    """s and c of the features whose own coordinates are one position."""
    return own.where("depth = 1").select(D, "s", F.from_json("coordinates", "array<double>").alias("c"))


class Levels:
    """What the levels of topology are made of, by topology node and by the feature that is referred to."""

    def __init__(self, t: DataFrame, own: DataFrame):
        self.t, self.own = t, own
        self.node = stored(first_nodes(t))
        self.points = positions(own)
        self.refs = stored(value(t, TOPO + "directedReferences", "head", "node").join(directed(t), [D, "head"]).select(D, "node", "refs"))
        self.lines = stored(self.line())
        self.by_feature = self.called(self.lines, "line")
        self.rings = stored(self.ring())

    def called(self, rows: DataFrame, *columns: str) -> DataFrame:
        return self.node.join(rows, [D, "node"]).select(D, F.col("s").alias("ref"), *columns)

    def line(self) -> DataFrame:
        """node and line: known positions of its related features in order (one at least)."""
        at = related(self.t).join(items(self.t, "head"), [D, "head"]).join(self.points.withColumnRenamed("s", "item"), [D, "item"])
        return at.groupBy(D, "node").agg(ordered("c", "pos").alias("line"))

    def each(self, refs: DataFrame) -> DataFrame:
        """node, pos, ref and sign (1 or -1) of directed references."""
        return refs.select(D, "node", F.explode("refs").alias("r")).select(D, "node", F.col("r.pos").alias("pos"), F.col("r.ref").alias("ref"), F.when(F.col("r.orientation") == "-", -1).otherwise(1).alias("sign"))

    def ring(self) -> DataFrame:
        """node and ring: directed lines one after the other, each without the position that it shares with the one before, closed."""
        walked = F.when(F.col("sign") < 0, F.reverse("line")).otherwise(F.col("line"))
        at = self.each(self.refs).join(self.by_feature, [D, "ref"]).groupBy(D, "node").agg(ordered(walked, "pos").alias("parts"))
        ring = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p).otherwise(F.slice(p, F.lit(2), F.size(p)))))
        at = at.withColumn("ring", ring)
        closed = F.when(F.get("ring", F.lit(0)) == F.get("ring", F.size("ring") - 1), F.col("ring")).otherwise(F.array_append("ring", F.get("ring", F.lit(0))))
        return at.select(D, "node", closed.alias("ring"))

    def faces(self) -> DataFrame:
        """node and rings: signs and rings of the rings that it refers to."""
        return self.each(self.refs).join(self.called(self.rings, "ring"), [D, "ref"]).groupBy(D, "node").agg(ordered(F.struct("sign", "ring"), "pos").alias("rings"))

    def shells(self, faces: DataFrame) -> DataFrame:
        """node and faces: signs and rings of the faces that it refers to."""
        return self.each(self.refs).join(self.called(faces, "rings"), [D, "ref"]).groupBy(D, "node").agg(ordered(F.struct("sign", "rings"), "pos").alias("faces"))

    def solids(self, shells: DataFrame) -> DataFrame:
        """node and faces of all its shells, their signs combined with the shell's."""
        refs = value(self.t, TOPO + "shells", "head", "node").join(directed(self.t), [D, "head"]).select(D, "node", "refs")
        at = self.each(refs).join(self.called(shells, "faces"), [D, "ref"])
        turned = F.transform("faces", lambda f: F.struct((f["sign"] * F.col("sign")).alias("sign"), f["rings"].alias("rings")))
        return at.groupBy(D, "node").agg(F.flatten(ordered(turned, "pos")).alias("faces"))

    def chains(self) -> DataFrame:
        """node and rings: lists of lines, each chained and closed; an item that is no list is a ring of that one line."""
        li = items(self.t, "head")
        outer = related(self.t).join(kinds(self.t).where(F.col("type") == GEOJSON + "Polygon"), [D, "node"]).join(li.withColumnRenamed("pos", "o"), [D, "head"]).select(D, "node", "o", F.col("item").alias("list"))
        inner = outer.join(li.select(D, F.col("head").alias("list"), "pos", "item"), [D, "list"], "left").select(D, "node", "o", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("item", "list").alias("ref"))
        segs = inner.join(self.by_feature, [D, "ref"]).groupBy(D, "node", "o").agg(ordered("line", "pos").alias("segs"))
        return segs.select(D, "node", "o", chain(F.col("segs")).alias("ring")).groupBy(D, "node").agg(ordered("ring", "o").alias("rings"))

    def close(self) -> None:
        discard(self.node, self.refs, self.lines, self.rings)


def oriented(rings: Column, sign: Column) -> Column:
    return F.transform(rings, lambda r: F.when(r["sign"] * sign < 0, F.reverse(r["ring"])).otherwise(r["ring"]))


def resolved(t: DataFrame) -> DataFrame:
    """s, geom_type, coordinates and geometries (JSON texts) of every subject with a geometry.

    Coordinates of its own come before topology.  Of several topologies lines become a MultiLineString, polygons a MultiPolygon, and others a GeometryCollection, which
    has geometries instead of coordinates.  References that lead nowhere, or around to themselves, are left out.
    """
    own = stored(direct(t))
    level = Levels(t, own)
    faces = stored(level.faces())
    shells = stored(level.shells(faces))
    one = F.lit(1)
    many = lambda df: df.select(D, "node", F.transform("faces", lambda f: oriented(f["rings"], f["sign"])).alias("c"))
    made = {
        LINES: ("LineString", level.lines.where("size(line) >= 2").select(D, "node", F.col("line").alias("c"))),
        (TOPO + "Ring",): ("Polygon", level.rings.select(D, "node", F.array("ring").alias("c"))),
        (TOPO + "Face",): ("Polygon", faces.select(D, "node", oriented(F.col("rings"), one).alias("c"))),
        (GEOJSON + "Polygon",): ("Polygon", level.chains().select(D, "node", F.col("rings").alias("c"))),
        (TOPO + "Shell",): ("MultiPolygon", many(shells)),
        (TOPO + "Solid",): ("MultiPolygon", many(level.solids(shells))),
    }
    kind = stored(kinds(t))
    parts = [rows.join(kind.where(F.col("type").isin(*types)).select(D, "node"), [D, "node"], "left_semi").select(D, "node", F.lit(name).alias("type"), F.to_json("c").alias("coordinates")) for types, (name, rows) in made.items()]
    nodes = t.where(F.col("p") == GEOJSON + "topology").select(D, "s", F.col("o").alias("node")).distinct().join(own.select(D, "s"), [D, "s"], "left_anti")
    each = nodes.join(reduce(DataFrame.unionByName, parts), [D, "node"]).withColumn("at", F.struct(F.length("node"), "node"))
    all_ = each.groupBy(D, "s").agg(F.collect_set("type").alias("types"), ordered(F.struct("type", "coordinates"), "at").alias("g"))
    kind_ = F.get("types", F.lit(0))
    single = F.size("g") == 1
    merged = F.when(single, kind_).when((F.size("types") == 1) & kind_.isin("LineString", "Polygon"), F.concat(F.lit("Multi"), kind_)).otherwise("GeometryCollection")
    all_ = all_.withColumn("geom_type", merged)
    text = F.transform("g", lambda g: g["coordinates"])
    whole = F.transform("g", lambda g: F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), g["coordinates"], F.lit("}")))
    none = F.lit(None).cast("string")
    topology = all_.select(D, "s", "geom_type", F.when(single, F.get(text, F.lit(0))).when(F.col("geom_type") != "GeometryCollection", joined(text)).alias("coordinates"), F.when(F.col("geom_type") == "GeometryCollection", joined(whole)).alias("geometries"))
    out = stored(own.select(D, "s", "geom_type", "coordinates", none.alias("geometries")).unionByName(topology))
    level.close()
    discard(own, faces, shells, kind)
    return out


def features(t: DataFrame, collections: bool = False) -> DataFrame:
    """s, s_id and s_ord of the features (on request also of the collections) that have an IRI."""
    types = [GEOJSON + "Feature", *([GEOJSON + "FeatureCollection"] if collections else [])]
    return t.where((F.col("p") == RDF + "type") & F.col("o").isin(*types) & ~F.col("s").startswith("_:")).select(D, "s", "s_id", "s_ord").distinct()


def keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """rows (s, s_id, s_ord) once for each key: the IRI, and the prefixed name where that is another."""
    keys = F.array_distinct(F.filter(F.array("s", "s_id"), lambda k: k.isNotNull()))
    return rows.select(D, "s", "s_ord", F.explode(keys).alias("key"), *columns)


def index(t: DataFrame, collections: bool = False) -> DataFrame:
    """The geometry index of graphs: key (IRI and prefixed name), s, s_ord, geom_type, coordinates, geometries; features without a geometry are left out."""
    return keyed(features(t, collections).join(resolved(t), [D, "s"]), *GEOMETRY)


def links(t: DataFrame) -> DataFrame:
    """s and to: what the first topology of each feature refers to, whatever its level."""
    node = first_nodes(t).join(kinds(t), [D, "node"])
    li = items(t, "head")
    heads = node.join(related(t), [D, "node"])
    flat = heads.where(F.col("type").isin(*LINES)).join(li, [D, "head"]).select(D, "s", F.col("item").alias("to"))
    outer = heads.where(F.col("type") == GEOJSON + "Polygon").join(li, [D, "head"]).select(D, "s", F.col("item").alias("list"))
    inner = outer.join(li.select(D, F.col("head").alias("list"), F.col("item").alias("to")), [D, "list"], "left").select(D, "s", F.coalesce("to", "list").alias("to"))
    of = value(t, TOPO + "directedReferences", "head", "node").withColumn("solid", F.lit(False)).unionByName(value(t, TOPO + "shells", "head", "node").withColumn("solid", F.lit(True)))
    walked = node.where(F.col("type").isin(*DIRECTED, TOPO + "Solid")).join(of, [D, "node"]).where(F.col("solid") == (F.col("type") == TOPO + "Solid"))
    walked = walked.join(directed(t), [D, "head"]).select(D, "s", F.explode("refs").alias("r")).select(D, "s", F.col("r.ref").alias("to"))
    return flat.unionByName(inner).unionByName(walked).distinct()


def reached(starts: DataFrame, link: DataFrame) -> DataFrame:
    """s and to: everything that links (s, to) lead to from starts (s), itself included, at any depth; circles end where they meet themselves.

    The last round's rows are joined with the links, and those that are new are the next round's, until there are none.
    """
    frontier = stored(starts.select(D, "s", F.col("s").alias("to")).distinct())
    known, rounds = frontier, [frontier]
    step = stored(link.select(D, F.col("s").alias("to"), F.col("to").alias("next")))
    while not frontier.isEmpty():
        new = frontier.join(step, [D, "to"]).select(D, "s", F.col("next").alias("to")).distinct()
        frontier = stored(new.join(known, [D, "s", "to"], "left_anti"))
        rounds.append(frontier)
        known = reduce(DataFrame.unionByName, rounds)
    discard(step)
    return known


def components(t: DataFrame, collections: bool = False) -> DataFrame:
    """s, kind (edges or points), component and coordinates (JSON): the edges and points below every feature, however many levels lie between."""
    own = stored(direct(t))
    level = Levels(t, own)
    feature = features(t, collections)
    known = reached(feature, links(t))
    edge = level.node.join(kinds(t).where(F.col("type").isin(*LINES)), [D, "node"]).join(level.lines.where("size(line) >= 2"), [D, "node"]).select(D, F.col("s").alias("to"), F.lit("edges").alias("kind"), F.to_json("line").alias("coordinates"))
    point = level.points.join(level.node, [D, "s"], "left_anti").select(D, F.col("s").alias("to"), F.lit("points").alias("kind"), F.to_json("c").alias("coordinates"))
    out = stored(known.join(edge.unionByName(point), [D, "to"]).select(D, "s", "kind", F.col("to").alias("component"), "coordinates"))
    level.close()
    discard(own)
    return out


def component_index(t: DataFrame, collections: bool = False) -> DataFrame:
    """The component index of graphs: key (IRI and prefixed name), s, s_ord, kind, component, coordinates."""
    return keyed(features(t, collections).join(components(t, collections), [D, "s"]), "kind", "component", "coordinates")


def merged(rows: DataFrame) -> DataFrame:
    """One index of several graphs (rows of ``index`` or ``component_index``, dataset_id: the files, in the order of their names): key, source and the other columns.

    A key that is an IRI or a prefixed name is that of the last file that has it; a local name is that of the first feature of the first file, unless it is such
    a key too.  One group-by finds what every key stands for; its rows come back by a join.
    """
    whole = rows.select(D, "s", "s_ord", "key", F.lit(True).alias("full"))
    alias = rows.select(D, "s", "s_ord", local_name(F.col("key")).alias("key"), F.lit(False).alias("full"))
    place = F.struct(D, "s_ord", "s")
    said = whole.unionByName(alias).distinct().groupBy("key").agg(F.max(F.when(F.col("full"), F.struct(D, "s"))).alias("last"), F.min(F.when(~F.col("full"), place)).alias("first"))
    chosen = said.select("key", F.coalesce(F.col("last.dataset_id"), F.col("first.dataset_id")).alias(D), F.coalesce("last.s", "first.s").alias("s"))
    return chosen.join(rows.drop("key", "s_ord").distinct(), [D, "s"]).withColumnRenamed(D, "source")

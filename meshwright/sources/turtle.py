"""Turtle texts as triples, the geometry features that they describe, and the Topology of their graphs (``load``).

The grammar covers prefixes, ``a``, ``;`` and ``,``, blank-node property lists, collections, string, number and boolean literals and
comments.  Every document is parsed whole by one Arrow batch row; all that follows are joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Topology

D = "dataset_id"
TRIPLES = f"{D} string, s string, p string, o string, o_kind string, pos int"
#: Rows that a Python worker hands over at a time: a batch of texts has many times more triples than texts.
ROWS = 50_000
#: The vocabularies of the graphs.
GEOJSON, TOPO, DCT = "https://purl.org/geojson/vocab#", "https://purl.org/geojson/topo#", "http://purl.org/dc/terms/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TOKEN = re.compile(
    r"""(?:\s+|\#[^\n]*)*+(?:(?P<mark>[\[\](),;])|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}.*?\"{3})|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?|\.?[0-9]+(?:[eE][+-]?[0-9]+)?)(?![\w:]))
    |(?P<name>_:[\w.-]*\w|[\w-]*(?:\.[\w-]+)*:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*|\w+)|(?P<dot>\.)|\Z)""",
    re.VERBOSE | re.DOTALL,
)
BLANK = re.compile(r"(?:\s+|\#[^\n]*)*")


class Parser:
    """Triples (s, p, o, kind, pos) of one text; items of a collection are triples of its head with the predicate rdf:li and their place."""

    def __init__(self, text: str):
        self.tokens = self.scan(text)
        self.at, self.blank, self.out, self.prefixes, self.base = 0, 0, [], {}, ""

    @staticmethod
    def scan(text: str) -> list[tuple[str, str]]:
        out, at = [], None
        for m in iter(TOKEN.scanner(text).match, None):
            if kind := m.lastgroup:
                out.append((kind, m[kind]))
            at = m
        at = at.end() if at else 0
        if at < len(text):
            at = BLANK.match(text, at).end()
            raise ValueError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        return out

    def peek(self) -> tuple[str, str]:
        try:
            return self.tokens[self.at]
        except IndexError:
            return "end", ""

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if value is not None and t[1] != value:
            raise ValueError(f"expected {value!r}, found {t[1]!r}")
        self.at += 1
        return t

    def fresh(self) -> str:
        self.blank += 1
        return f"_:b{self.blank}"

    def name(self, t: tuple[str, str]) -> str:
        kind, v = t
        if kind == "iri":
            return v[1:-1] if ":" in v else self.base + v[1:-1]
        prefix, _, local = v.partition(":")
        return v if prefix == "_" else self.prefixes.get(prefix, f"{prefix}:") + local.replace("\\", "")

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, v = self.peek()
            if v.lower() in ("@prefix", "prefix", "@base", "base"):
                self.take()
                if v.lower().endswith("prefix"):
                    label = self.take()[1]
                    self.prefixes[label.rstrip(":")] = self.take()[1][1:-1]
                else:
                    self.base = self.take()[1][1:-1]
                if self.peek()[1] == ".":
                    self.take()
                continue
            subject = self.thing()[0]
            if self.peek()[1] != ".":
                self.predicates(subject)
            self.take(".")
        return self.out

    def predicates(self, subject: str) -> None:
        while True:
            kind, v = self.take()
            predicate = RDF + "type" if (kind, v) == ("name", "a") else self.name((kind, v))
            while True:
                o, k = self.thing()
                self.out.append((subject, predicate, o, k, 0))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return

    def thing(self) -> tuple[str, str]:
        kind, v = self.take()
        if v == "[":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(node)
            self.take("]")
            return node, "blank"
        if v == "(":
            head, pos = self.fresh(), 0
            while self.peek()[1] != ")":
                o, k = self.thing()
                self.out.append((head, RDF + "li", o, k, pos))
                pos += 1
            self.take(")")
            return head, "list"
        if kind in ("text", "long"):
            body = v[3:-3] if kind == "long" else v[1:-1]
            body = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)
            if self.peek()[0] == "lang":
                self.take()
            elif self.peek()[0] == "type":
                self.take()
                self.take()
            return body, "literal"
        if kind == "number" or v in ("true", "false"):
            return v, "literal"
        if kind in ("iri", "name"):
            node = self.name((kind, v))
            return node, "blank" if node.startswith("_:") else "iri"
        raise ValueError(f"unexpected {v!r}")


def triples(texts: DataFrame) -> DataFrame:
    """Triples of texts (dataset_id, text)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *t) for d, text in zip(pdf[D], pdf["text"], strict=True) for t in Parser(text).parse()]
            yield pd.DataFrame(rows, columns=[D, "s", "p", "o", "o_kind", "pos"])

    return texts.select(D, "text").mapInPandas(parse, TRIPLES)


def items(t: DataFrame, head: str) -> DataFrame:
    """The items of collections: head, pos, item."""
    return t.where(F.col("p") == RDF + "li").select(D, F.col("s").alias(head), F.col("pos"), F.col("o").alias("item"))


def related(t: DataFrame) -> DataFrame:
    """feature, type and head of the list of related features of every inline topology."""
    node = t.where(F.col("p") == GEOJSON + "topology").select(D, F.col("s").alias("feature"), F.col("o").alias("node"))
    kind = t.where(F.col("p") == RDF + "type").select(D, F.col("s").alias("node"), F.regexp_extract("o", "[^#/]*$", 0).alias("type"))
    head = t.where(F.col("p").isin(TOPO + "relatedFeatures", GEOJSON + "relatedFeatures")).groupBy(D, F.col("s").alias("node")).agg(F.max_by("o", "p").alias("head"))
    return node.join(kind, [D, "node"]).join(head, [D, "node"])


def points(t: DataFrame) -> DataFrame:
    """id and c (coordinates) of features with a point of their own."""
    node = t.where(F.col("p").isin(GEOJSON + "geometry", DCT + "spatial")).select(D, F.col("s").alias("id"), F.col("o").alias("node"))
    head = t.where(F.col("p") == GEOJSON + "coordinates").select(D, F.col("s").alias("node"), F.col("o").alias("head"))
    c = node.join(head, [D, "node"]).join(items(t, "head"), [D, "head"]).withColumn("v", F.expr("try_cast(item AS double)"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    return c.groupBy(D, "id").agg(ordered.alias("c"), F.bool_and(F.col("v").isNotNull()).alias("ok")).where("ok").drop("ok")


def lines(t: DataFrame) -> DataFrame:
    """id and line of edges: their related points in order (unknown ones are left out), at least two."""
    r = related(t).where(F.col("type").isin("LineString", "Edge")).join(items(t, "head"), [D, "head"])
    at = r.join(points(t).withColumnRenamed("id", "item"), [D, "item"])
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"])
    return at.groupBy(D, F.col("feature").alias("id")).agg(line.alias("line")).where("size(line) >= 2")


def polygons(t: DataFrame) -> DataFrame:
    """id and polygon: each ring is a list of edges, chained and closed."""
    from ..functions.geometry import chain

    outer = related(t).where("type = 'Polygon'").join(items(t, "head").withColumnRenamed("pos", "ring").withColumnRenamed("item", "list"), [D, "head"])
    inner = outer.join(items(t, "list"), [D, "list"]).join(lines(t).withColumnRenamed("id", "item"), [D, "item"])
    segs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"])
    ring = inner.groupBy(D, F.col("feature").alias("id"), "ring").agg(segs.alias("segs")).select(D, "id", "ring", chain(F.col("segs")).alias("closed"))
    return ring.groupBy(D, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "closed"))), lambda s: s["closed"]).alias("polygon"))


NAMED = f"{TRIPLES}, s_id string, s_ord long, ref string, ref_id string"


def named(texts: DataFrame) -> DataFrame:
    """Triples with what loading needs: s_id and ref_id (the prefixed names of subject and object; without a prefix that fits, the IRIs),
    s_ord (the place of the subject among its text's subjects) and ref (the IRI of the object; topo:ref literals are prefixed names).
    Prefixes are those of the text."""

    columns, ref_ = [c.split()[0] for c in NAMED.split(", ")], TOPO + "ref"

    def rows_of(d: str, text: str) -> Iterator[tuple]:
        parser, place = Parser(text), {}
        found = parser.parse()
        spaces = sorted(parser.prefixes.items(), key=lambda x: -len(x[1]))
        starts = tuple(parser.prefixes.values())

        class Short(dict):  # the prefixed name of each IRI, worked out once a text
            def __missing__(self, iri: str) -> str:
                if not iri.startswith(starts):
                    self[iri] = iri
                    return iri
                prefix, space = next((x for x in spaces if iri.startswith(x[1]) and len(iri) > len(x[1])), ("", ""))
                self[iri] = out = f"{prefix}:{iri[len(space) :]}" if prefix else iri[len(space) :]
                return out

        short = Short()
        for s, p, o, kind, pos in found:
            ref = o
            if p == ref_:
                prefix, colon, local = o.partition(":")
                if colon and prefix in parser.prefixes:
                    ref = parser.prefixes[prefix] + local
            yield d, s, p, o, kind, pos, short[s], place.setdefault(s, len(place)), ref, short[ref]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = (row for d, text in zip(pdf[D], pdf["text"], strict=True) for row in rows_of(d, text))
            while some := list(islice(rows, ROWS)):
                yield pd.DataFrame(dict(zip(columns, zip(*some, strict=True), strict=True)))

    return texts.select(D, "text").mapInPandas(parse, NAMED)


def value(t: DataFrame, p: str, name: str, of: str = "s") -> DataFrame:
    """The object (of several, the least) of each subject's triples with one predicate, as columns name and of."""
    return t.where(F.col("p") == p).groupBy(D, F.col("s").alias(of)).agg(F.min("o").alias(name))


def directed(t: DataFrame) -> DataFrame:
    """head and refs: the directed references (ref, ref_id, orientation, + by default) of each list in order; items without topo:ref are dropped."""
    ref = t.where(F.col("p") == TOPO + "ref").groupBy(D, F.col("s").alias("item")).agg(F.min(F.struct("ref", "ref_id")).alias("r"))
    at = items(t, "head").join(ref, [D, "item"]).join(value(t, TOPO + "orientation", "orientation", "item"), [D, "item"], "left")
    each = F.struct("pos", "r.ref", "r.ref_id", F.coalesce(F.expr("nullif(orientation, '')"), F.lit("+")).alias("orientation"))
    return at.groupBy(D, "head").agg(F.array_sort(F.collect_list(each)).alias("refs"))


def load(t: DataFrame) -> Topology:
    """The tables of all graphs, from their triples (``named``; persist them, as each table reads them again).

    A feature with a point of its own is a point, whatever topology it has.  Edges and LineStrings of fewer than two references,
    faces without ring members and solids without shells are left out; Polygons are not faces.  Solids have
    default properties and there are no observed curves, as the vocabulary has neither.
    """
    feature = t.where((F.col("p") == RDF + "type") & (F.col("o") == GEOJSON + "Feature") & ~F.col("s").startswith("_:")).select(D, "s", F.col("s_id").alias("id"), F.col("s_ord").alias("ord")).distinct()
    number = F.struct("pos", F.expr("try_cast(o AS double)").alias("v"), (F.col("o_kind") == "literal").alias("ok"))
    lists = t.where(F.col("p") == RDF + "li").groupBy(D, F.col("s").alias("head")).agg(F.array_sort(F.collect_list(number)).alias("c")).where(F.forall("c", lambda c: c["ok"]))
    coordinates = value(t, GEOJSON + "coordinates", "head", "at").join(lists, [D, "head"]).drop("head")
    own = [value(t, p, "at").join(coordinates, [D, "at"]).select(D, "s", F.lit(k).alias("k"), "c") for k, p in enumerate((GEOJSON + "geometry", DCT + "spatial"))]
    point = feature.join(own[0].unionByName(own[1]).groupBy(D, "s").agg(F.min_by("c", "k").alias("c")), [D, "s"])
    node = value(t, GEOJSON + "topology", "node")
    other = feature.join(point.select(D, "s"), [D, "s"], "left_anti").join(node, [D, "s"]).join(value(t, RDF + "type", "type", "node"), [D, "node"])

    related = t.where(F.col("p").isin(TOPO + "relatedFeatures", GEOJSON + "relatedFeatures")).groupBy(D, F.col("s").alias("node")).agg(F.min_by("o", F.struct("p", "o")).alias("head"))
    vertices = t.where(F.col("p") == RDF + "li").groupBy(D, F.col("s").alias("head")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_id"))), lambda x: x["ref_id"]).alias("v")).where("size(v) >= 2")
    curve = other.where(F.col("type").isin(TOPO + "Edge", GEOJSON + "LineString")).join(related, [D, "node"]).join(vertices, [D, "head"])

    refs = directed(t)
    of = node.join(value(t, TOPO + "directedReferences", "head", "node"), [D, "node"]).join(refs, [D, "head"]).select(D, "s", "refs")
    on_face = other.where(F.col("type") == TOPO + "Face").join(of, [D, "s"]).select(D, "id", "ord", F.posexplode("refs").alias("pos", "r")).select(D, "id", "ord", "pos", F.col("r.ref").alias("s"))
    face = on_face.join(of, [D, "s"]).groupBy(D, "id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "refs"))), lambda x: x["refs"]).alias("rings"))
    member = face.select(D, F.col("id").alias("surface_id"), F.col("ord").alias("surface_ord"), F.posexplode("rings").alias("ring_idx", "m"))
    member = member.select(D, "surface_id", "surface_ord", "ring_idx", F.posexplode("m").alias("member_idx", "e"))

    on_solid = other.where(F.col("type") == TOPO + "Solid").join(value(t, TOPO + "shells", "head", "node"), [D, "node"]).join(refs, [D, "head"])
    on_solid = on_solid.select(D, "id", "ord", F.posexplode("refs").alias("raw", "r")).select(D, "id", "ord", "raw", F.col("r.ref").alias("s"))
    on_solid = on_solid.join(node.select(D, "s"), [D, "s"]).join(of, [D, "s"], "left")
    solid = on_solid.groupBy(D, "id", "ord").agg(F.array_sort(F.collect_list(F.struct("raw", "refs"))).alias("shells"))
    bound = solid.select(D, F.col("id").alias("solid_id"), F.col("ord").alias("solid_ord"), F.posexplode("shells").alias("shell_idx", "x"))
    bound = bound.select(D, "solid_id", "solid_ord", "shell_idx", F.when(F.col("x.raw") == 0, "outer").otherwise("inner").alias("shell_type"), F.posexplode("x.refs").alias("k", "e"))
    # a face that a shell lists twice keeps both places and the last orientation
    bound = bound.select("*", F.col("e.ref_id").alias("face_id"), F.col("e.orientation").alias("o"))
    final = bound.groupBy(D, "solid_id", "shell_idx", "face_id").agg(F.max_by("o", "k").alias("orientation"))
    bound = bound.join(final, [D, "solid_id", "shell_idx", "face_id"]).withColumn("face_idx", (F.col("shell_idx").cast("long") * (1 << 20) + F.col("k")).cast("int"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return Topology(
        point=point.select(D, "id", "ord", *[F.get("c", F.lit(i))["v"].alias(n) for i, n in enumerate("xyz")], F.size("c").alias("n")),
        curve=curve.select(D, "id", "ord", F.size("v").cast("long").alias("n_vertices")),
        curve_vertex=curve.select(D, F.col("id").alias("curve_id"), F.col("ord").alias("curve_ord"), F.posexplode("v").alias("pos", "point_id")),
        surface=face.select(D, "id", "ord"),
        ring_member=member.select(D, "surface_id", "surface_ord", "ring_idx", "member_idx", F.col("e.ref_id").alias("curve_id"), F.col("e.orientation").alias("orientation")),
        solid=solid.select(D, "id", "ord", F.lit(0.0).alias("volume"), F.lit("default").alias("theme"), F.lit("primary").alias("parcel_type"), *map(none, ("parent_id", "servient_id", "burdened_id", "host_id")), F.lit("").alias("level")),
        solid_face=bound.select(D, "solid_id", "solid_ord", "face_idx", "face_id"),
        shell_face=bound.select(D, "solid_id", "solid_ord", "shell_idx", "shell_type", "face_idx", "face_id", "orientation"),
        observation_curve=t.where("false").select(D, none("ref"), none("source")),
    )

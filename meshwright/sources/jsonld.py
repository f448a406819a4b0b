"""JSON-LD documents as the triples that Turtle texts give (``sources.turtle.named``), so that all that follows is the same.

Documents are VARIANT values.  Every round expands one level of nesting by exploding the fields of objects and the elements of lists, and hands what is nested
to the next round, until nothing is.  A level's context is its parent's with its own terms on top.

Known are @context (objects and lists of them; remote contexts are skipped), @id, @type, @graph, @value, @list, @set, @vocab, terms with @id, @type and @container, keywords under other names
and lists of lists.  Not known, and skipped: @reverse, @included, @index, @nest, language maps and scoped contexts.  Keys that mean nothing in the context are left out, as are nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let
from ..storage import discard, stored
from .csdm import items, kind
from .turtle import RDF, TOPO, D

TERM = "struct<iri:string,type:string,container:string>"
CONTEXT = f"map<string,{TERM}>"
#: Keywords of the format that terms may stand for.
KEYWORDS = ("@id", "@type", "@graph", "@value", "@list", "@set")


def fields(v: Column) -> Column:
    """The fields of an object as (key, value)."""
    return F.when(kind(v).startswith("OBJECT"), F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))).otherwise(F.array().cast("array<struct<key:string,value:variant>>"))


def string(v: Column) -> Column:
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def listed(v: Column) -> Column:
    """A list's elements; anything else is a list of itself."""
    return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(kind(v) != "VOID", F.array(v)).otherwise(F.array().cast("array<variant>"))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def context(parent: Column, v: Column) -> Column:
    """parent with the terms that v's own @context declares."""

    def term(e: Column) -> Column:
        value = e["value"]
        of = lambda name: F.coalesce(string(field(value, name)), F.lit(""))
        iri = F.coalesce(string(value), string(field(value, "@id")), e["key"])
        return F.struct(e["key"].alias("key"), F.struct(iri.alias("iri"), of("@type").alias("type"), of("@container").alias("container")).cast(TERM).alias("value"))

    def merged(own: Column) -> Column:
        # of a term that several parts declare the last counts
        last = F.filter(own, lambda e, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda x: x["key"] == e["key"]))
        return let(last, lambda x: F.map_from_entries(F.concat(F.filter(F.map_entries(parent), lambda e: ~F.exists(x, lambda y: y["key"] == e["key"])), x)))

    terms = lambda c: F.flatten(F.transform(listed(c), lambda c: F.transform(F.filter(fields(c), lambda e: ~kind(e["value"]).isin("VOID")), term)))
    return let(field(v, "@context"), lambda c: F.when(c.isNull(), parent).otherwise(let(terms(c), merged)))


def compact(name: Column, ctx: Column, rounds: int = 2) -> Column:
    """The IRI of prefix:name by the prefix's term; any other name as it is."""

    def one(name: Column) -> Column:
        prefix = F.substring_index(name, ":", 1)
        return let(F.struct(name.alias("n"), F.try_element_at(ctx, prefix)["iri"].alias("iri"), F.substr(name, F.length(prefix) + 2).alias("rest")), lambda x: F.when(x["iri"].isNotNull() & F.contains(x["n"], F.lit(":")) & ~F.startswith(x["rest"], F.lit("//")), F.concat(x["iri"], x["rest"])).otherwise(x["n"]))

    for _ in range(rounds):  # the IRI of a prefix may be compact too
        name = let(name, one)
    return name


def meaning(key: Column, ctx: Column) -> Column:
    """The IRI (or keyword) that a key or a type stands for; null for none."""
    vocab = F.try_element_at(ctx, F.lit("@vocab"))["iri"]
    full = compact(let(key, lambda k: F.coalesce(F.try_element_at(ctx, k)["iri"], k)), ctx)
    return let(full, lambda f: F.when(f.isin(*KEYWORDS) | F.contains(f, F.lit(":")), f).otherwise(F.concat(vocab, f)))


#: One value that waits: s, p and pos are those of the triple that it is the object of (null at the top), at its place in the document.
WAITING = [D, "at", "s", "p", "pos", "v", "ctx", "type", "container"]


class Step:
    """The expressions of one round (built once, as all rounds have the same)."""

    def __init__(self) -> None:
        k, v, ctx, type_ = F.col("k"), F.col("v"), F.col("ctx"), F.col("type")
        array, object_ = k.startswith("ARRAY"), k.startswith("OBJECT")
        word = lambda name: F.get(F.filter("entries", lambda e: e["iri"] == name), F.lit(0))["value"]
        self.context = F.when(object_, context(ctx, v)).otherwise(ctx)
        self.entries = F.transform(F.when(object_, F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))).otherwise(F.array().cast("array<struct<key:string,value:variant>>")), lambda e: F.struct(e["key"].alias("key"), meaning(e["key"], ctx).alias("iri"), e["value"].alias("value")))
        self.list = F.when(array & ((F.col("container") == "@list") | (F.col("p") == RDF + "li")), v).otherwise(word("@list"))
        self.set = F.when(array & F.col("list").isNull(), v).otherwise(word("@set"))
        self.scalar = F.when(~object_ & ~array, v).otherwise(word("@value"))
        self.what = F.when(k == "VOID", F.lit(None)).when(F.col("list").isNotNull(), "list").when(F.col("set").isNotNull(), "set").when(F.col("scalar").isNotNull(), "scalar").when(object_, "node")
        given = string(word("@id"))
        self.me = F.when(F.col("what") == "node", F.coalesce(let(given, lambda g: F.when(F.startswith(g, F.lit("_:")), g).otherwise(compact(g, ctx))), F.concat(F.lit("_:"), "at"))).when(F.col("what") == "list", F.concat(F.lit("_:"), "at"))

        said = string(F.col("scalar"))
        self.ref = type_.isin("@id", "@vocab") & said.isNotNull()
        self.text = F.when(self.ref & (type_ == "@vocab"), meaning(said, ctx)).when(self.ref, compact(said, ctx)).otherwise(F.try_variant_get("scalar", "$", "string"))
        node = F.when(F.startswith("me", F.lit("_:")), F.when(F.col("what") == "list", "list").otherwise("blank")).otherwise("iri")
        self.object = F.when(F.col("what") == "scalar", F.col("text")).otherwise(F.col("me"))
        self.kind = F.when(F.col("what") != "scalar", node).when(self.ref, F.when(F.startswith("text", F.lit("_:")), "blank").otherwise("iri")).otherwise("literal")
        self.types = F.explode(F.flatten(F.transform(F.filter("entries", lambda e: e["iri"] == "@type"), lambda e: F.transform(listed(e["value"]), lambda x: meaning(string(x), ctx)))))
        self.place = F.concat("at", F.lit("."), F.format_string("%06d", "i"))
        self.elements = F.posexplode(items("list", "$")).alias("i", "v")
        self.members = F.posexplode(listed(F.col("set"))).alias("i", "v")
        self.parts = F.posexplode(F.filter("entries", lambda e: e["iri"].isNotNull() & (~F.startswith(e["iri"], F.lit("@")) | (e["iri"] == "@graph")))).alias("i", "e")
        term, graph = F.try_element_at("ctx", F.col("e.key")), F.col("e.iri") == "@graph"
        self.inner = [F.when(~graph, F.col("me")).alias("s"), F.when(~graph, F.col("e.iri")).alias("p"), F.lit(0).alias("pos"), F.col("e.value").alias("v"), "ctx", F.coalesce(term["type"], F.lit("")).alias("type"), F.coalesce(term["container"], F.lit("")).alias("container")]

    def read(self, wait: DataFrame) -> DataFrame:
        """What each value is; what is null for those that mean nothing.  They aren't filtered out here, as Spark would work all of this out once more for the filter."""
        now = wait.withColumn("k", kind("v")).withColumn("ctx", self.context).withColumn("entries", self.entries)
        now = now.withColumns({"list": self.list, "scalar": self.scalar}).withColumn("set", self.set).withColumn("what", self.what)
        return now.withColumn("me", self.me).withColumn("text", F.when(F.col("what") == "scalar", self.text)).select(*WAITING, "entries", "list", "set", "what", "me", "text", "scalar")

    def told(self, now: DataFrame) -> DataFrame:
        """The triples of this round's values: what they are the object of, and their types."""
        of = now.where("s is not null and what <> 'set'").select(D, "at", "s", "p", self.object.alias("o"), self.kind.alias("o_kind"), "pos")
        typed = now.where("what = 'node'").select(D, "at", F.col("me").alias("s"), F.lit(RDF + "type").alias("p"), self.types.alias("o"), F.lit("iri").alias("o_kind"), F.lit(0).alias("pos"))
        return of.unionByName(typed).where("o is not null")

    def next(self, now: DataFrame) -> DataFrame:
        """What is nested in this round's values."""
        each = now.where("what = 'list'").select(D, "at", "me", "ctx", "type", self.elements).select(D, self.place.alias("at"), F.col("me").alias("s"), F.lit(RDF + "li").alias("p"), F.col("i").alias("pos"), "v", "ctx", "type", F.lit("@list").alias("container"))
        same = now.where("what = 'set'").drop("v").select(D, "at", "s", "p", "pos", "ctx", "type", "container", self.members).withColumn("at", self.place)
        inner = now.where("what = 'node'").select(D, "at", "me", "ctx", self.parts).select(D, self.place.alias("at"), *self.inner)
        return each.select(*WAITING).unionByName(same.select(*WAITING)).unionByName(inner.select(*WAITING))


def expanded(docs: DataFrame) -> DataFrame:
    """dataset_id, at (place in the document, for order), s, p, o, o_kind, pos of documents (dataset_id, doc)."""
    none, empty = F.lit(None).cast("string"), F.lit("")
    root = docs.select(D, F.posexplode(listed(F.col("doc"))).alias("i", "v"))
    wait = stored(root.select(D, F.format_string("%06d", "i").alias("at"), none.alias("s"), none.alias("p"), F.lit(0).alias("pos"), "v", F.create_map().cast(CONTEXT).alias("ctx"), empty.alias("type"), empty.alias("container")))
    step, out = Step(), []
    while not wait.isEmpty():
        now = stored(step.read(wait))
        discard(wait)
        out.append(stored(step.told(now)))
        wait = stored(step.next(now))
        discard(now)
    return reduce(DataFrame.unionByName, out) if out else wait.select(D, "at", "s", "p", empty.alias("o"), empty.alias("o_kind"), "pos")


def prefixes(docs: DataFrame) -> DataFrame:
    """dataset_id and spaces: the prefixes (prefix, uri) of each document's top contexts, longest IRI first: terms whose IRI ends in / or # (as prefixes do)."""
    top = docs.select(D, F.explode(listed(F.col("doc"))).alias("v")).select(D, context(F.create_map().cast(CONTEXT), F.col("v")).alias("ctx"))
    each = top.select(D, "ctx", F.explode(F.map_entries("ctx")).alias("e")).where(~F.startswith("e.key", F.lit("@")))
    each = each.select(D, F.col("e.key").alias("prefix"), compact(F.col("e.value.iri"), F.col("ctx")).alias("uri")).where(F.col("uri").rlike("[/#]$"))
    spaces = F.transform(F.array_sort(F.collect_set(F.struct((-F.length("uri")).alias("n"), "uri", "prefix"))), lambda x: F.struct(x["prefix"].alias("prefix"), x["uri"].alias("uri")))
    return each.groupBy(D).agg(spaces.alias("spaces"))


def named(docs: DataFrame) -> DataFrame:
    """Triples of documents (dataset_id, doc) with what loading needs, like ``turtle.named``."""
    t = stored(expanded(docs))
    spaces = prefixes(docs)
    # the order of subjects is that of their first place; numbers rise with it, over all documents
    first = t.groupBy(D, "s").agg(F.min("at").alias("at")).repartitionByRange(D, "at").sortWithinPartitions(D, "at").select(D, "s", F.monotonically_increasing_id().alias("s_ord"))
    out = t.join(first, [D, "s"]).join(spaces, D, "left").withColumn("spaces", F.coalesce("spaces", F.array().cast("array<struct<prefix:string,uri:string>>")))

    def short(iri: Column) -> Column:
        hit = F.get(F.filter("spaces", lambda x: F.startswith(iri, x["uri"]) & (F.length(iri) > F.length(x["uri"]))), F.lit(0))
        local = F.substr(iri, F.length(hit["uri"]) + 1)
        return F.when(hit.isNull(), iri).when(hit["prefix"] == "", local).otherwise(F.concat(hit["prefix"], F.lit(":"), local))

    prefix = F.get(F.filter("spaces", lambda x: x["prefix"] == F.substring_index(F.col("o"), ":", 1)), F.lit(0))
    whole = F.when((F.col("p") == TOPO + "ref") & F.contains("o", F.lit(":")) & prefix.isNotNull(), F.concat(prefix["uri"], F.substr("o", F.length(F.substring_index("o", ":", 1)) + 2))).otherwise(F.col("o"))
    out = out.withColumn("ref", whole)
    return out.select(D, "s", "p", "o", "o_kind", F.col("pos").cast("int").alias("pos"), short(F.col("s")).alias("s_id"), "s_ord", "ref", short(F.col("ref")).alias("ref_id"))


def is_jsonld(text: Column) -> Column:
    """Whether a graph's text is JSON-LD rather than Turtle, by its first character."""
    return F.substring(F.ltrim(text), 1, 1).isin("{", "[")


def graphs(texts: DataFrame) -> DataFrame:
    """Triples of texts (dataset_id, text) in either format."""
    from . import turtle

    marked = texts.withColumn("_json", F.coalesce(is_jsonld(F.col("text")), F.lit(False)))
    return turtle.named(marked.where("not _json")).unionByName(named(marked.where("_json").select(D, F.parse_json("text").alias("doc"))))

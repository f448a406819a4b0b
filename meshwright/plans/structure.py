"""Structural checks of topology models in their raw form: documents with points, curves, surfaces, solids and observation curves.

Documents are VARIANT values, one row each, and types are tested strictly.  Every level of nesting is one explode, and all checks of
a level are made in one pass over it, so a document of any size is checked in parallel.  Repeated or unreadable ids stop the other checks of
their dataset, as paths and references would not be safe.  detail holds the path, and for repeated ids the first place and the later one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.csdm import get, kind
from ..storage import spread, stored
from .derive import D

#: Collections that a model must have, fields with ids of other solids, and what orientations and shells may be.
REQUIRED = ("points", "curves", "surfaces", "solids")
OBSERVED = "observation_curves"
RELATED = ("parent_id", "servient_id", "burdened_id", "host_id")
ORIENTATIONS, SHELLS = ("+", "-"), ("outer", "inner")
NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"


def _is(v: Column, name: str) -> Column:
    return kind(v).startswith(name) if name != "NUMBER" else kind(v).rlike(NUMBER)


def _null(v: Column) -> Column:
    """Missing or null."""
    return kind(v) == "VOID"


def _one_of(v: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(_is(v, "STRING") & F.try_variant_get(v, "$", "string").isin(*values), F.lit(False))


def _list(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def _found(df: DataFrame, *faults: tuple, severity: str = "error") -> DataFrame:
    """The issues of rows with id: faults are (when it is one, code, path, names of further facts), all tested in one pass."""
    each = [F.when(bad, F.struct(F.lit(code).alias("code"), F.concat_ws("|", path, *[F.col(f).cast("string") for f in facts]).alias("detail"))) for bad, code, path, *facts in faults]
    rows = df.select(D, F.col("id").alias("object_id"), F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("e"))
    return rows.select(D, F.lit("Structure").alias("rule"), "e.code", F.lit(severity).alias("severity"), "object_id", "e.detail")


def _bad(code: str, field: str, good: Column) -> tuple:
    return ~good, code, F.concat("path", F.lit(f".{field}"))


def _not_object(code: str) -> tuple:
    return ~_is(F.col("v"), "OBJECT"), code, F.col("path")


def _each(df: DataFrame, values: Column, path: str, pos: str = "i", value: str = "v") -> DataFrame:
    """One row for each element of values, with its place; the path goes on with [place]."""
    rows = df.select(D, "id", "path", F.posexplode(values).alias(pos, value))
    return rows.withColumn("path", F.concat("path", F.lit(path), F.lit("["), F.col(pos), F.lit("]")))


def collections(docs: DataFrame) -> DataFrame:
    """dataset_id, collection, c (null: missing): a row for each collection that a document may have."""
    each = F.array(*[F.struct(F.lit(name).alias("collection"), get("doc", f"$.{name}").alias("c")) for name in (*REQUIRED, OBSERVED)])
    return docs.select(D, F.explode(each).alias("e")).select(D, "e.collection", "e.c")


def elements(docs: DataFrame) -> DataFrame:
    """dataset_id, collection, path, i, v and id (null: none that is a text) of the elements of all collections."""
    rows = collections(docs).select(D, "collection", F.posexplode(_list(F.col("c"))).alias("i", "v"))
    given = get("v", "$.id")
    id_ = F.when(_is(given, "STRING") & (F.col("collection") != OBSERVED), F.try_variant_get(given, "$", "string"))
    return rows.select(D, "collection", F.concat("collection", F.lit("["), "i", F.lit("]")).alias("path"), "i", "v", id_.alias("id"))


def identities(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Issues of the required collections and the ids in their elements (rows): at most one for each element."""
    whole = collections(docs).where(F.col("collection") != OBSERVED).select(D, F.lit(None).cast("string").alias("id"), F.col("collection").alias("path"), "c")
    rows = rows.where(F.col("collection") != OBSERVED)
    given, is_object = get("v", "$.id"), _is(F.col("v"), "OBJECT")
    known = rows.where("id is not null")
    first = known.groupBy(D, "collection", "id").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = known.join(first, [D, "collection", "id"]).where("i > first")
    return reduce(
        DataFrame.unionByName,
        [
            _found(whole, (F.col("c").isNull(), "MISSING_COLLECTION", F.col("path")), (F.col("c").isNotNull() & ~_is(F.col("c"), "ARRAY"), "INVALID_COLLECTION_TYPE", F.col("path"))),
            _found(rows, _not_object("INVALID_OBJECT_TYPE"), (is_object & _null(given), "MISSING_ID", F.col("path")), (is_object & ~_null(given) & F.col("id").isNull(), "INVALID_ID_TYPE", F.concat("path", F.lit(".id")))),
            _found(again, (F.lit(True), "DUPLICATE_ID", F.col("path"), "first", "i")),
        ],
    )


def points(rows: DataFrame) -> list[DataFrame]:
    """Coordinates: at least three numbers, or two where all points of a dataset are pairs of numbers (which is a warning)."""
    rows = rows.withColumn("c", get("v", "$.coordinates"))
    numbers = F.forall(_list(F.col("c")), lambda x: _is(x, "NUMBER"))
    pair = F.coalesce(_is(F.col("c"), "ARRAY") & (F.size(_list(F.col("c"))) == 2) & numbers, F.lit(False))
    flat = rows.groupBy(D).agg(F.bool_and(pair).alias("flat")).where("flat").select(D, F.lit(None).cast("string").alias("id"))
    long = _is(F.col("c"), "ARRAY") & (F.size(_list(F.col("c"))) >= 3)
    value = _each(rows.where(long), F.slice(_list(F.col("c")), 1, 3), ".coordinates", "k", "x")
    short = rows.where(~long).join(flat.select(D), D, "left_anti")  # the pairs of a flat dataset are numbers
    return [
        _found(short, (F.lit(True), "INVALID_COORDINATES", F.concat("path", F.lit(".coordinates")))),
        _found(value, (~_is(F.col("x"), "NUMBER"), "INVALID_COORDINATE_VALUE", F.col("path"))),
        _found(flat, (F.lit(True), "NO_3D_TOPOLOGY", F.lit("points")), severity="warning"),
    ]


def _ids(rows: DataFrame, field: str, code: str) -> DataFrame:
    """Elements of a list of ids that are no texts."""
    return _found(_each(rows, _list(get("v", f"$.{field}")), f".{field}", "k", "x"), (~_is(F.col("x"), "STRING"), code, F.col("path")))


def curves(rows: DataFrame) -> list[DataFrame]:
    return [_found(rows, _bad("INVALID_VERTICES", "vertices", _is(get("v", "$.vertices"), "ARRAY"))), _ids(rows, "vertices", "INVALID_VERTEX_ID")]


def surfaces(rows: DataFrame) -> list[DataFrame]:
    rings, members, is_object = get("v", "$.rings"), get("v", "$.members"), _is(F.col("v"), "OBJECT")
    ring = _each(rows, _list(rings), ".rings", "k", "v")
    member = _each(ring.where(is_object), _list(members), ".members", "m", "v")
    of_object = lambda fault: (is_object & fault[0], *fault[1:])
    return [
        _found(rows, _bad("INVALID_RINGS", "rings", _is(rings, "ARRAY"))),
        _found(ring, _not_object("INVALID_RING"), of_object(_bad("INVALID_RING_MEMBERS", "members", _is(members, "ARRAY")))),
        _found(
            member,
            _not_object("INVALID_RING_MEMBER"),
            of_object(_bad("INVALID_RING_MEMBER_REF", "ref", _is(get("v", "$.ref"), "STRING"))),
            of_object(_bad("INVALID_ORIENTATION", "orientation", _one_of(get("v", "$.orientation"), ORIENTATIONS))),
        ),
    ]


def solids(rows: DataFrame) -> list[DataFrame]:
    volume, levels, shells = get("v", "$.volume"), get("v", "$.levels"), get("v", "$.shells")
    texts = lambda v: _is(v, "ARRAY") & F.forall(_list(v), lambda x: _is(x, "STRING"))
    related = [_bad("INVALID_RELATIONSHIP_ID", field, _null(v) | _is(v, "STRING")) for field in RELATED for v in [get("v", f"$.{field}")]]
    shell = _each(rows, _list(shells), ".shells", "k", "v")
    is_object = _is(F.col("v"), "OBJECT")
    inside = shell.where(is_object)
    sort, faces, turned = get("v", "$.type"), get("v", "$.faces"), get("v", "$.face_orientations")
    entries = F.map_entries(F.try_variant_get(turned, "$", "map<string,variant>"))
    wrong = F.filter(F.coalesce(entries, F.array().cast("array<struct<key:string,value:variant>>")), lambda e: ~_one_of(e["value"], ORIENTATIONS))
    entry = inside.where(_is(turned, "OBJECT")).select(D, "id", "path", F.explode(wrong).alias("e")).select(D, "id", "path", F.col("e.key").alias("face"))
    return [
        _found(
            rows,
            _bad("INVALID_FACES", "faces", _is(faces, "ARRAY")),
            _bad("INVALID_VOLUME", "volume", volume.isNull() | _is(volume, "NUMBER")),
            _bad("INVALID_LEVELS", "levels", levels.isNull() | texts(levels)),
            *related,
            _bad("INVALID_SHELLS", "shells", _null(shells) | _is(shells, "ARRAY")),
        ),
        _ids(rows, "faces", "INVALID_FACE_ID"),
        _found(shell.where(~is_object), _not_object("INVALID_SHELL")),
        _found(
            inside,
            _bad("INVALID_SHELL_TYPE", "type", sort.isNull() | _one_of(sort, SHELLS)),
            _bad("INVALID_SHELL_FACES", "faces", texts(faces)),
            _bad("INVALID_FACE_ORIENTATIONS", "face_orientations", turned.isNull() | _is(turned, "OBJECT")),
        ),
        _found(entry, (F.lit(True), "INVALID_FACE_ORIENTATION", F.concat("path", F.lit(".face_orientations")), "face")),
    ]


def observations(rows: DataFrame) -> list[DataFrame]:
    is_object = _is(F.col("v"), "OBJECT")
    fields = [(is_object & bad, *rest) for bad, *rest in (_bad("INVALID_OBSERVATION_CURVE_REF", "ref", _is(get("v", "$.ref"), "STRING")), _bad("INVALID_OBSERVATION_CURVE_SOURCE", "source", _is(get("v", "$.source"), "STRING")))]
    return [_found(rows, _not_object("INVALID_OBSERVATION_CURVE"), *fields)]


def structure_issues(docs: DataFrame) -> DataFrame:
    """All structural issues of documents (dataset_id, doc); datasets with issues of identity get no others.

    The documents are taken apart once: their elements are stored, and the checks of a level of nesting share one pass over it.
    """
    rows = stored(elements(docs))
    first = stored(identities(docs, rows))
    unsafe = first.select(D).distinct()
    safe = rows.join(unsafe, D, "left_anti")
    of = lambda name: safe.where(F.col("collection") == name)
    observed = collections(docs).where(F.col("collection") == OBSERVED).join(unsafe, D, "left_anti").select(D, F.lit(None).cast("string").alias("id"), "c")
    listed = _found(observed, (F.col("c").isNotNull() & ~_is(F.col("c"), "ARRAY"), "INVALID_OBSERVATION_CURVES", F.lit(OBSERVED)))
    checks = [*points(of("points")), *curves(of("curves")), *surfaces(of("surfaces")), *solids(of("solids")), *observations(of(OBSERVED))]
    return reduce(DataFrame.unionByName, [first, listed, *checks])


#: One small model and its faults: what replaces what in it, and the issues that follow (code, object, detail; {0} and {1}: these places and as many more
#: as sound elements stand in front).
MODEL = '{"points":[{"id":"p","coordinates":[0,0,0]},{"id":"q","coordinates":[1,0,2.5]}],"curves":[{"id":"c","vertices":["p","q"]}],"surfaces":[{"id":"s","rings":[{"members":[{"ref":"c","orientation":"+"}]}]}],"solids":[{"id":"v","faces":["s"],"volume":1,"levels":["L1"],"shells":[{"type":"outer","faces":["s"],"face_orientations":{"s":"-"}}]}],"observation_curves":[{"ref":"c","source":"o"}]}'
FAULTS = [
    ("", "", []),
    ('"curves":[{"id":"c","vertices":["p","q"]}],', "", [("MISSING_COLLECTION", None, "curves")]),
    ('"curves":[{"id":"c","vertices":["p","q"]}]', '"curves":{"id":"c"}', [("INVALID_COLLECTION_TYPE", None, "curves")]),
    ('{"id":"q","coordinates":[1,0,2.5]}', "7", [("INVALID_OBJECT_TYPE", None, "points[{1}]")]),
    ('{"id":"s",', '{"id":null,', [("MISSING_ID", None, "surfaces[{0}]")]),
    ('{"id":"v",', '{"id":5,', [("INVALID_ID_TYPE", None, "solids[{0}].id")]),
    ('"id":"q"', '"id":"p"', [("DUPLICATE_ID", "p", "points[{1}]|{0}|{1}")]),
    ("[1,0,2.5]", "[1,0]", [("INVALID_COORDINATES", "q", "points[{1}].coordinates")]),
    ("[1,0,2.5]", '[1,true,"z"]', [("INVALID_COORDINATE_VALUE", "q", "points[{1}].coordinates[1]"), ("INVALID_COORDINATE_VALUE", "q", "points[{1}].coordinates[2]")]),
    ('[0,0,0]},{"id":"q","coordinates":[1,0,2.5]}', "[0,0]}", [("NO_3D_TOPOLOGY", None, "points")]),
    ('"vertices":["p","q"]', '"vertices":"p"', [("INVALID_VERTICES", "c", "curves[{0}].vertices")]),
    ('"vertices":["p","q"]', '"vertices":["p",3]', [("INVALID_VERTEX_ID", "c", "curves[{0}].vertices[1]")]),
    ('"rings":[{', '"loops":[{', [("INVALID_RINGS", "s", "surfaces[{0}].rings")]),
    ('"rings":[{', '"rings":["r",{', [("INVALID_RING", "s", "surfaces[{0}].rings[0]")]),
    ('"members":[', '"parts":[', [("INVALID_RING_MEMBERS", "s", "surfaces[{0}].rings[0].members")]),
    ('"members":[', '"members":[null,', [("INVALID_RING_MEMBER", "s", "surfaces[{0}].rings[0].members[0]")]),
    ('{"ref":"c","orientation":"+"}', '{"ref":1,"orientation":"x"}', [("INVALID_RING_MEMBER_REF", "s", "surfaces[{0}].rings[0].members[0].ref"), ("INVALID_ORIENTATION", "s", "surfaces[{0}].rings[0].members[0].orientation")]),
    ('"id":"v","faces":["s"]', '"id":"v"', [("INVALID_FACES", "v", "solids[{0}].faces")]),
    ('"id":"v","faces":["s"]', '"id":"v","faces":[{}]', [("INVALID_FACE_ID", "v", "solids[{0}].faces[0]")]),
    ('"volume":1', '"volume":true', [("INVALID_VOLUME", "v", "solids[{0}].volume")]),
    ('["L1"]', '["L1",2]', [("INVALID_LEVELS", "v", "solids[{0}].levels")]),
    ('"volume":1', '"parent_id":4,"host_id":null', [("INVALID_RELATIONSHIP_ID", "v", "solids[{0}].parent_id")]),
    ('"shells":[{', '"shells":3,"more":[{', [("INVALID_SHELLS", "v", "solids[{0}].shells")]),
    ('"shells":[{', '"shells":["x",{', [("INVALID_SHELL", "v", "solids[{0}].shells[0]")]),
    ('"type":"outer"', '"type":"Outer"', [("INVALID_SHELL_TYPE", "v", "solids[{0}].shells[0].type")]),
    ('"type":"outer","faces":["s"]', '"faces":[1]', [("INVALID_SHELL_FACES", "v", "solids[{0}].shells[0].faces")]),
    ('{"s":"-"}', '["s"]', [("INVALID_FACE_ORIENTATIONS", "v", "solids[{0}].shells[0].face_orientations")]),
    ('{"s":"-"}', '{"s":"?"}', [("INVALID_FACE_ORIENTATION", "v", "solids[{0}].shells[0].face_orientations|s")]),
    ('"observation_curves":[{"ref":"c","source":"o"}]', '"observation_curves":{}', [("INVALID_OBSERVATION_CURVES", None, "observation_curves")]),
    ('[{"ref":"c","source":"o"}]', "[[]]", [("INVALID_OBSERVATION_CURVE", None, "observation_curves[{0}]")]),
    ('{"ref":"c","source":"o"}', '{"ref":null}', [("INVALID_OBSERVATION_CURVE_REF", None, "observation_curves[{0}].ref"), ("INVALID_OBSERVATION_CURVE_SOURCE", None, "observation_curves[{0}].source")]),
]


#: Sound elements that stand in front of a collection's own: how the text of one begins and ends around its number.
SOUND = {
    "points": ('{"id":"p', '","coordinates":[1,2,3]}'),
    "curves": ('{"id":"c', '","vertices":["p","q"]}'),
    "surfaces": ('{"id":"s', '","rings":[]}'),
    "solids": ('{"id":"v', '","faces":["s"],"shells":null}'),
    OBSERVED: ('{"ref":"c","source":"o', '"}'),
}


def planted(spark, sf_dir: str) -> DataFrame:
    """The structural issues of one raw model for each part: its key decides the fault, and how many sound elements stand before the faulty one in every collection."""
    texts = spark.createDataFrame([(i, MODEL.replace(old, new) if old else MODEL) for i, (old, new, _) in enumerate(FAULTS)], "fault int, json string")
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey").select("p_partkey", F.concat(F.lit("m:"), "p_partkey").alias(D), (F.col("p_partkey") % len(FAULTS)).cast("int").alias("fault"))
    json, k = F.col("json"), (F.col("p_partkey") % 7).cast("int")
    for name, (begin, end) in SOUND.items():
        numbers = F.slice(F.sequence(F.lit(0), k), F.lit(2), k)
        sound = F.transform(numbers, lambda i: F.concat(F.lit(begin), i.cast("string"), F.lit(end), F.lit(",")))  # noqa: B023 - called at once
        json = F.replace(json, F.lit(f'"{name}":['), F.concat(F.lit(f'"{name}":['), F.array_join(sound, "")))
    docs = part.join(F.broadcast(texts), "fault").select(D, F.parse_json(json).alias("doc"))
    return structure_issues(docs).drop("rule")


def planted_sql() -> str:
    """A lone pair of coordinates is a warning where it is the dataset's only point, else an error of that point."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(code)}, {quote(obj)}, {quote(detail)})" for i, (_, _, found) in enumerate(FAULTS) for code, obj, detail in found)
    return f"""WITH f AS (SELECT concat('m:', p_partkey) AS dataset_id, p_partkey % 7 AS n, f.*, code = 'NO_3D_TOPOLOGY' AND p_partkey % 7 = 0 AS flat, code = 'NO_3D_TOPOLOGY' AND p_partkey % 7 > 0 AS mixed
  FROM part JOIN (VALUES {rows}) AS f(fault, code, obj, place) ON p_partkey % {len(FAULTS)} = fault)
SELECT dataset_id, CASE WHEN mixed THEN 'INVALID_COORDINATES' ELSE code END AS code, CASE WHEN flat THEN 'warning' ELSE 'error' END AS severity, CASE WHEN mixed THEN 'p' ELSE obj END AS object_id,
  CASE WHEN mixed THEN concat('points[', n, '].coordinates') ELSE replace(replace(place, '{{0}}', CAST(n AS VARCHAR)), '{{1}}', CAST(n + 1 AS VARCHAR)) END AS detail FROM f"""

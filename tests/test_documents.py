"""Documents, graphs, splines, raw models, command lines and hosts on small literals."""

import json
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meshwright import cli
from meshwright.operators import convert, curves, graph, namespaces, resolve
from meshwright.plans import host
from meshwright.plans.validate import rule_results, validate_raw
from meshwright.sources import csdm, features, geojson, jsonld, turtle

from .test_topology import SF, tetrahedron, turtle_tetrahedron

QUERIES = ["feature_walk", "document_systems", "coincident_points", "graph_files", "curves_splines"]


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(got)
    rows = lambda df: sorted(tuple(None if v is None or v != v else v for v in r) for r in df[cols].astype(object).values.tolist())
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want)))


PREFIX = "@prefix geojson: <https://purl.org/geojson/vocab#> . @prefix topo: <https://purl.org/geojson/topo#> . @prefix ex: <http://example.com/> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"
TRIANGLE = PREFIX + """
ex:triangle a geojson:Feature ; geojson:topology [ a geojson:Polygon ; topo:relatedFeatures ( ( ex:e1 ex:e2 ex:e3 ) ) ] .
ex:e1 a geojson:Feature ; geojson:topology [ a topo:Edge ; topo:relatedFeatures ( ex:P2 ex:P1 ) ] .
ex:e2 a geojson:Feature ; geojson:topology [ a topo:Edge ; topo:relatedFeatures _:c0 ] .
_:c1 rdf:first ex:P3 ; rdf:rest rdf:nil . _:c0 rdf:first ex:P2 ; rdf:rest _:c1 .
ex:e3 a geojson:Feature ; geojson:topology [ a geojson:LineString ; geojson:relatedFeatures ( ex:P3 ex:P1 ) ] .
ex:P1 a geojson:Feature ; geojson:geometry [ a geojson:Point ; geojson:coordinates ( 10 10 ) ] .
ex:P2 a geojson:Feature ; geojson:geometry [ a geojson:Point ; geojson:coordinates ( 20 20 ) ] .
ex:P3 a geojson:Feature ; geojson:geometry [ a geojson:Point ; geojson:coordinates ( 13 17 ) ] .
ex:loop a geojson:Feature ; geojson:topology [ a topo:Ring ; topo:directedReferences ( [ topo:ref "ex:loop" ] ) ] .
_:x rdf:first ex:P1 ; rdf:rest _:y . _:y rdf:first ex:P1 ; rdf:rest _:x .
"""


def graphs(spark, **texts):
    return graph.with_lists(jsonld.graphs(spark.createDataFrame(list(texts.items()), "dataset_id string, text string"))).persist()


def test_first_edge_backwards_lists_of_cells_and_circles(spark):
    t = graphs(spark, one=TRIANGLE)
    found = {r.key: json.loads(r.coordinates) for r in graph.index(t).collect()}
    ring = found["http://example.com/triangle"][0]
    assert found["ex:triangle"] == [ring] and ring[0] == ring[-1] and len(ring) == 4 and {tuple(p) for p in ring} == {(10, 10), (20, 20), (13, 17)}
    assert found["ex:e2"] == [[20, 20], [13, 17]] and found["ex:e3"] == [[13, 17], [10, 10]] and "ex:loop" not in found
    comps = graph.component_index(t).where("key = 'ex:triangle'").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in comps} == {"edges": 3, "points": 3}


def test_long_lists_of_cells(spark):
    n = 300
    cells = "".join(f"_:c{i} rdf:first ex:p{i} ; rdf:rest {f'_:c{i + 1}' if i + 1 < n else 'rdf:nil'} .\n" for i in reversed(range(n)))
    t = graphs(spark, one=PREFIX + "ex:s ex:has _:c0 .\n" + cells)
    items = {r.pos: r.o for r in t.where(F.col("p") == turtle.RDF + "li").collect()}
    assert items == {i: f"http://example.com/p{i}" for i in range(n)}


def test_jsonld_is_the_model_of_its_turtle(spark):
    from dataclasses import fields

    doc = json.loads(tetrahedron())
    refs = lambda rs: {"@list": [{"topo:ref": f"t:{r['ref']}", **({"topo:orientation": r["orientation"]} if "orientation" in r else {})} for r in rs]}
    nodes = []
    for key in ("points", "edges", "rings", "faces", "shells", "solids"):
        for f in doc[key][0]["features"]:
            t = f.get("topology")
            if key == "points":
                body = {"geojson:geometry": {"@type": "geojson:Point", "geojson:coordinates": {"@list": f["place"]["coordinates"]}}}
            elif key == "edges":
                body = {"geojson:topology": {"@type": "topo:Edge", "related": [f"t:{r}" for r in t["references"]]}}
            else:
                body = {"geojson:topology": {"@type": f"topo:{key[:-1].title()}", ("topo:shells" if key == "solids" else "topo:directedReferences"): refs(t["shells" if key == "solids" else "directed_references"])}}
            nodes.append({"id": f"t:{f['id']}", "kind": "geojson:Feature", "ignored": [1, {"a": None}], **body})
    context = ["http://remote/context", {"t": "http://e/t/", "geojson": "https://purl.org/geojson/vocab#", "topo": "https://purl.org/geojson/topo#"}, {"id": "@id", "kind": "@type", "related": {"@id": "topo:relatedFeatures", "@type": "@id", "@container": "@list"}}]
    text = json.dumps({"@context": context, "@graph": nodes})
    a = turtle.load(graphs(spark, g=turtle_tetrahedron(lambda x: x.replace("@prefix : ", "@prefix t: ").replace('":', '"t:').replace(" :", " t:").replace("\n:", "\nt:"))))
    b = turtle.load(graphs(spark, g=text))
    for f in fields(a):
        one, two = getattr(a, f.name), getattr(b, f.name)
        cols = sorted(c for c in one.columns if not c.endswith("ord"))
        rows = lambda df, cols=cols: sorted(map(str, df.select(cols).collect()))
        assert rows(one) == rows(two) and (rows(one) or f.name == "observation_curve"), f.name
    order = [r.id for r in b.point.orderBy("ord").collect()]
    assert order == ["t:a", "t:b", "t:c", "t:d"]


def test_nested_features_and_odd_types(spark):
    deep = {"features": [[{"type": "FeatureCollection", "features": [[{"type": "Feature", "id": "a"}], 7]}], {"type": "Feature", "id": "b"}]}
    rows = features.walked(features.values(csdm.from_strings(spark, {"d": json.dumps(deep)}))).orderBy("at").collect()
    assert [json.loads(r.f.toJson()).get("id") if not isinstance(json.loads(r.f.toJson()), int) else 7 for r in rows] == ["a", 7, "b"]
    odd = csdm.from_strings(spark, {"d": json.dumps({"features": [{"type": "Thing"}]})})
    with pytest.raises(Exception, match="unexpected type"):
        features.walked(features.values(odd)).collect()
    assert features.walked(features.values(odd), strict=False).count() == 0



def put(**collections):
    return json.dumps({"type": "FeatureCollection", "features": collections.pop("features", []), **{k: [{"type": "FeatureCollection", "features": v}] for k, v in collections.items()}})


def feature(id_, **topology):
    return {"type": "Feature", "id": id_, "geometry": None, "topology": topology}


def point(id_, *c):
    return {"type": "Feature", "id": id_, "geometry": {"type": "Point", "coordinates": list(c)}}


SPLINE = [point(f"p{i}", *c) for i, c in enumerate([(10, 10), (14, 12.5), (12.5, 15), (15.5, 16), (20, 20)])] + [point("t0", 9, 10), point("t1", 20, 21)]


def test_splines_with_tangents_as_features(spark):
    curve = feature("s", type="CubicSpline", references=[f"p{i}" for i in range(5)], startTangentVector={"references": ["t0", "p0"]}, endTangentVector={"references": ["p4", "t1"]})
    docs = csdm.from_strings(spark, {"d": put(points=SPLINE, features=[curve])})
    rows, reasons = convert.converted(docs, mode="edges")
    got = {r.id: json.loads(r.feature) for r in convert.cleaned(rows).collect()}
    line = got["s"]["geometry"]["coordinates"]
    assert reasons.isEmpty() and set(got) == {"s", "s-start-tangent", "s-end-tangent"} and len(line) == 32
    # fixed values: the first vertices of this spline within 0.02
    assert line[1] == pytest.approx([10.370697576441586, 10.055189850769265], abs=1e-12) and line[2] == pytest.approx([10.899453020128838, 10.211543774066051], abs=1e-12) and line[-1] == [20, 20]
    assert got["s-start-tangent"]["properties"]["stroke-dasharray"] == "6 4" and got["s-end-tangent"]["geometry"]["coordinates"] == [[20, 20], [20, 21]]
    rows, _ = convert.converted(docs, mode="points")
    assert rows.count() == 7  # control points are there already
    alone = csdm.from_strings(spark, {"d": put(points=SPLINE, edges=[curve], faces=[feature("f", type="Polygon", references=[["s", "x"]])], features=[])})
    rows, reasons = convert.converted(alone, mode="edges,faces", number=2)
    assert {r.mode for r in rows.collect()} == {"edges"} and rows.count() == 2


def test_plain_spline_known_vertices(spark):
    p = [[10.0, 10.0], [14.0, 12.5], [12.5, 15.0], [15.5, 16.0], [18.0, 15.5], [16.5, 18.5], [20.0, 20.0]]
    none = None
    rows = [("plain", p, none, none), ("deep", [[*q, 1.0] for q in p], none, none), ("one", p[:1], none, none), ("two", p[:2], none, none), ("same", [p[0], p[0], p[1]], none, none), ("odd", [p[0], [1.0, float("nan")]], none, none)]
    got = {r.id: r for r in curves.splined(spark.createDataFrame(rows, "id string, p array<array<double>>, first array<double>, last array<double>")).collect()}
    line = got["plain"].line
    assert len(line) == 36 and line[1] == pytest.approx([11.501002883803709, 10.6125331261278], abs=1e-12) and line[2] == pytest.approx([12.804980078735994, 11.19808726635196], abs=1e-12)
    assert len(got["deep"].line) == 36 and all(v[2] == 1 for v in got["deep"].line) and got["two"].line == p[:2] and got["same"].line == [p[0], p[0], p[1]]
    assert got["one"].fault == "TOO_FEW_POINTS" and got["odd"].fault == "INVALID_COORDINATES" and got["one"].line is None
    assert curves.splined(spark.createDataFrame(rows, "id string, p array<array<double>>, first array<double>, last array<double>"), 0.0).first().fault == "SAGITTA_NOT_POSITIVE"


def test_arcs_radius_of_the_feature_and_native_units(spark):
    arc = feature("c", type="CircleByCenter", references=["m"]) | {"properties": {"radius": 10}}
    docs = csdm.from_strings(spark, {"d": json.dumps({"type": "FeatureCollection", "coordRefSys": "EPSG:7850", "features": [arc, feature("skip", type="SubtendedAngle", references=["m"])], "points": [{"type": "FeatureCollection", "features": [{"type": "Feature", "id": "m", "geometry": None, "place": {"type": "Point", "coordinates": [500000, 6500000]}}]}]})})
    rows, reasons = convert.converted(docs, densify=True, mode="faces")
    ring = rows.first().rings[0]
    assert len(ring) == 51 and ring[0] == ring[-1] and reasons.isEmpty() and all(116.99 < x < 117.01 and -32 < y < -31 for x, y in ring)
    rows, reasons = convert.converted(docs, mode="points,edges,faces")  # not drawn: its one point
    assert [(r.id, r.geom_type) for r in rows.orderBy("ord").collect()] == [("m", "Point"), ("c", "Point")]


def test_no_points_custom_collections_and_reasons(spark):
    docs = csdm.from_strings(spark, {"d": put(features=[feature("f", type="Polygon", references=[["a"]])])})
    with pytest.raises(ValueError, match="no point"):
        convert.converted(docs)
    with pytest.raises(ValueError, match="key:Type"):
        convert.custom("parcels")
    square = [point("a", 0, 0), point("b", 1, 0), point("c", 1, 1)]
    lines = [feature("ab", type="LineString", references=["a", "b"]), feature("bc", type="Edge", references=["b", "c"]), feature("ca", type="Edge", references=["c", "a"])]
    docs = csdm.from_strings(spark, {"d": put(points=square, edges=lines, parcels=[feature("p", directed_references=[{"ref": "ab"}, {"ref": "bc"}])], features=[feature("x", type="Edge", references=["a", "zz"]), feature("y", type="Edge")])})
    rows, reasons = convert.converted(docs, mode="parcels", objects="parcels:MultiLineString")
    assert [(r.id, r.geom_type, r.rings) for r in rows.collect()] == [("p", "MultiLineString", [[[0, 0], [1, 0], [1, 0], [1, 1]]])]
    assert {r.id: r.reason for r in reasons.collect()} == {"x": "REFERENCES_UNKNOWN", "y": "NO_REFERENCES"}


def test_documents_are_written_one_file_each(spark, tmp_path):
    docs = csdm.from_strings(spark, {"in/one.json": json.dumps(point("a", 1, 2) | {"@context": "http://c"}), "in/two.json": put(points=[point("a", 1, 2), point("b", 3, 4)]), "in/none.json": put(points=[point("q", 0, 0)])})
    rows, _ = convert.converted(docs)
    geojson.written(convert.cleaned(rows.where("id <> 'q'")), f"file://{tmp_path}/out", docs)
    files = {p.name.rsplit("-", 1)[0]: p.read_text() for p in (tmp_path / "out").iterdir()}
    one, two = json.loads(files["in_one"]), json.loads(files["in_two"])
    assert one["type"] == "Feature" and one["@context"][1] == "http://c" and [f["id"] for f in two["features"]] == ["a", "b"] and json.loads(files["in_none"]) == {"warning": "no feature geometries generated"}
    # more rows than a batch stay in order, in one file
    many = spark.range(25_000).select(F.lit("d").alias("dataset_id"), F.format_string("%08d", "id").alias("ord"), F.format_string('{"type":"Feature","id":%d}', "id").alias("feature"))
    geojson.written(many.repartition(7), f"{tmp_path}/many")
    (file,) = (tmp_path / "many").iterdir()
    assert [f["id"] for f in json.loads(file.read_text())["features"]] == list(range(25_000))
    with pytest.raises(Exception, match="all executors"):
        geojson.written(many, "s3://bucket/x")


RAW = {
    "points": [{"id": "p", "coordinates": [0, 0, 0]}, {"id": "q", "coordinates": [1, 0, 2.5]}],
    "curves": [{"id": "c", "vertices": ["p", "q"]}, {"id": "d", "vertices": ["p", "gone"]}],
    "surfaces": [{"id": "s", "rings": [{"members": [{"ref": "c", "orientation": "+"}]}]}],
    "solids": [{"id": "v", "faces": ["s"], "volume": 0, "levels": [], "burdened_id": "nobody", "parcel_type": "easement", "shells": [{"type": "outer", "faces": ["s"], "face_orientations": {"s": "-"}}]}],
    "observation_curves": [{"ref": "d", "source": "o"}],
}


def test_raw_models_reach_all_rules(spark, tmp_path, capsys):
    docs = csdm.from_strings(spark, {"good": json.dumps(RAW), "bad": json.dumps(RAW | {"curves": 1}), "flat": json.dumps(RAW | {"points": [{"id": "p", "coordinates": [0, 0]}]})})
    issues = validate_raw(docs).persist()
    found = {(r.dataset_id, r.code) for r in issues.collect()}
    assert {c for d, c in found if d == "good"} == {"SURFACE_RING_NOT_CLOSED", "UNKNOWN_POINT_REFERENCE", "OPEN_SOLID_SHELL", "ZERO_OR_NEGATIVE_VOLUME", "SOLID_BELOW_MINIMUM_THICKNESS", "UNKNOWN_BURDENED_REFERENCE", "CURVE_BELOW_MINIMUM_LENGTH"}
    assert {c for d, c in found if d == "bad"} == {"INVALID_COLLECTION_TYPE"} and {c for d, c in found if d == "flat"} == {"NO_3D_TOPOLOGY"}
    assert rule_results(issues, docs.select("dataset_id")).where("dataset_id = 'good'").count() == 26
    path = tmp_path / "raw.json"
    path.write_text(json.dumps(RAW))
    assert cli.main(["validate", "--raw", str(path), "--format", "json"], spark) == 1
    assert len(json.loads(capsys.readouterr().out)["ruleResults"]) == 26
    assert cli.main(["validate", "--raw", str(path), "--format", "html"], spark) == 1 and (tmp_path / "reports" / "raw-validation-report.html").exists()
    (tmp_path / "broken.json").write_text("{")
    assert cli.main(["validate", str(tmp_path / "broken.json")], spark) == 2 and cli.main(["validate", str(tmp_path / "missing.json")], spark) == 2


def test_graphs_beside_documents(spark, tmp_path, capsys):
    (tmp_path / "g1.ttl").write_text(turtle_tetrahedron())
    doc = json.loads(tetrahedron())
    doc["points"][0]["features"] = [{"id": ":a", "place": {"type": "Point", "coordinates": [9, 9, 9]}}]
    t = host.with_graphs(spark, csdm.load(csdm.from_strings(spark, {"d": json.dumps({"points": doc["points"]})})), [str(tmp_path / "g1.ttl")], ["d"])
    at = {r.id: (r.x, r.y, r.z) for r in t.point.collect()}
    own = next(k for k in at if k.strip(":") == "a")
    assert len(at) in (4, 5) and at[":a"] == (9, 9, 9) and t.curve.count() == 6 and own
    (tmp_path / "doc.json").write_text(json.dumps({"points": []}))
    assert cli.main(["validate", str(tmp_path / "doc.json"), "--ttl", str(tmp_path / "g*.ttl"), "--classes", "CC-01", "--format", "json"], spark) in (0, 1)
    capsys.readouterr()
    (tmp_path / "t.ttl").write_text(TRIANGLE)
    assert cli.main(["geometry", str(tmp_path / "t.ttl"), "--keys-only"], spark) == 0
    keys = capsys.readouterr().out.split()
    assert keys == sorted(set(keys)) and {"ex:e1", "e1", "http://example.com/e1"} <= set(keys)
    assert cli.main(["geometry", str(tmp_path / "t.ttl"), "--key", "ex:e2"], spark) == 0 and json.loads(capsys.readouterr().out) == {"type": "LineString", "coordinates": [[20, 20], [13, 17]]}
    assert cli.main(["geometry", str(tmp_path / "t.ttl"), "--key", "nothing"], spark) == 1
    capsys.readouterr()
    (tmp_path / "lot.json").write_text(json.dumps(feature("lot", type="Polygon", references=[["a:e1", "e2", "http://example.com/e3"]])))
    assert cli.main(["features", str(tmp_path / "lot.json"), "-t", str(tmp_path / "t.ttl"), "-ns", "a=http://example.com/", "-m", "faces"], spark) == 0
    lot = json.loads(capsys.readouterr().out)
    assert lot["type"] == "Feature" and lot["geometry"]["type"] == "Polygon" and len(lot["geometry"]["coordinates"][0]) == 4
    assert host.expanded("g*.ttl", (None, str(tmp_path))) == [str(tmp_path / "g1.ttl")] and host.expanded("no*.ttl") == ["no*.ttl"]


def test_hosts(spark, tmp_path):
    (tmp_path / "t.ttl").write_text(TRIANGLE)
    meta = SimpleNamespace(metadata={"mode": "points,edges", "ttl": "t.ttl"}, context={"working_dir": str(tmp_path), "example": {"prefixes": {"a": "http://example.com/"}}, "snippet": SimpleNamespace(prefixes={"a": "http://other/", "b": "http://b/"})})
    assert host.prefixes(meta) == {"a": "http://example.com/", "b": "http://b/"}
    out = json.loads(host.transform(spark, json.dumps(feature("a:triangle", type="Polygon", references=[["a:e1", "a:e2", "a:e3"]])), meta))
    assert sorted(f["geometry"]["type"] for f in out["features"]) == ["LineString"] * 3 + ["Point"] * 3
    bad = tetrahedron(drop="d")
    assert json.loads(host.report_transform(spark, bad, SimpleNamespace(metadata={"conformance_classes": ["CC-01"]})))["errorCount"] == 3
    with pytest.raises(ValueError, match="3 errors"):
        host.report_transform(spark, bad, SimpleNamespace(metadata={"conformance_classes": ["CC-01"], "fail_on_error": True}))
    (tmp_path / "bad.json").write_text(bad)
    (tmp_path / "other.json").write_text('{"name": 1}')
    plugin = host.Plugin(spark)
    assert plugin.validate(SimpleNamespace(input_path=tmp_path / "other.json")) is None
    assert any(f["is_error"] and f["message"].startswith("UNKNOWN_POINT_REFERENCE") for f in plugin.validate(SimpleNamespace(input_path=tmp_path / "bad.json")))


def test_coincident_points_across_cells(spark):
    rows = [("d", "a", 0, 4.9e-10, 0.0, 0.0), ("d", "b", 1, 5.1e-10, 0.0, 0.0), ("d", "c", 2, 1.45e-9, 0.0, 0.0), ("d", "e", 3, 1.52e-9, 0.0, 0.0), ("d", "f", 4, 4.9e-10, 0.0, 0.0), ("x", "a", 0, 0.0, 0.0, 0.0), ("d", "n", 5, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "dataset_id string, id string, ord long, x double, y double, z double")
    assert {(r.dataset_id, r.id): r.to for r in resolve.representatives(df).collect()} == {("d", "a"): "a", ("d", "b"): "a", ("d", "c"): "a", ("d", "e"): "e", ("d", "f"): "a", ("x", "a"): "a"}


def test_crossing_rules_are_compiled(spark):
    """Methods beyond 8000 bytes are interpreted by the JVM."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        for name in ("tr02_curve_self_intersection", "tr14_curves_meet_at_nodes_only", "tr15_surface_self_intersection", "tr24_solid_self_intersection"):
            parts = debug.codegenStringSeq(entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan())
            assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_prefixes_reach_the_index(spark):
    ids = spark.createDataFrame([("d", "a:x"), ("d", "y"), ("d", "q:z")], "dataset_id string, ref string")
    g = spark.createDataFrame([("http://e/x", "Point", "[1.0,2.0]"), ("http://e/y", "LineString", "[[1.0,2.0],[3.0,4.0]]")], "key string, geom_type string, coordinates string")
    s = convert.Sources(g, namespaces.table(spark, {"a": "http://e/"}))
    assert {r.ref: (r.g.geom_type, r.g.point, r.g.line) for r in s.graphed(ids).collect()} == {"a:x": ("Point", [1, 2], None), "y": ("LineString", None, [[1, 2], [3, 4]])}

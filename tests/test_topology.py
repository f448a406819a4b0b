"""Rules, loader, geometry and curves on small literals."""

import json

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from meshwright.operators import curves
from meshwright.operators.resolve import chained, geometries
from meshwright.operators.spatial import box_pairs
from meshwright.plans import report
from meshwright.plans.mesh import mesh
from meshwright.plans.validate import rule_results, validate
from meshwright.sources import csdm

SF = "/root/testdata/sf0.001"
FEW = ["structure_codes", "reprojection", "rule_statuses", "namespace_lookups", "tr24_solid_self_intersection", "tr11_point_fabric_consistency", "tr06_closed_solids", "tr25_shell_orientation", "geometry_faces", "curves_arcs"]


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("orders", "part", "customer", "supplier", "nation"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(got)
    rows = lambda df: sorted(map(repr, df[cols].values.tolist()))
    assert rows(got) == rows(want)


def feature(id_, **topology):
    return {"type": "Feature", "id": id_, "geometry": None, "topology": topology}


def tetrahedron(edges_extra=(), drop=None):
    points = {"a": [0, 0, 0], "b": [4, 0, 0], "c": [0, 4, 0], "d": [0, 0, 4]}
    edges = {"ab": "ab", "bc": "bc", "ca": "ca", "ad": "ad", "bd": "bd", "cd": "cd"} | dict(edges_extra)
    faces = {"bottom": ["ca-", "bc-", "ab-"], "front": ["ab+", "bd+", "ad-"], "left": ["ad+", "cd-", "ca+"], "slope": ["bc+", "cd+", "bd-"]}
    ref = lambda s: {"ref": s[:-1], "orientation": s[-1]}
    put = lambda fs: [{"type": "FeatureCollection", "features": fs}]
    doc = {
        "points": put([{"id": k, "place": {"type": "Point", "coordinates": v}} for k, v in points.items() if k != drop]),
        "edges": put([feature(k, references=list(v)) for k, v in edges.items()]),
        "rings": put([feature(f"r{k}", directed_references=[ref(x) for x in v]) for k, v in faces.items()]),
        "faces": put([feature(k, directed_references=[{"ref": f"r{k}"}]) for k in faces]),
        "shells": put([feature("shell", directed_references=[{"ref": k, "orientation": "+"} for k in faces])]),
        "solids": put([feature("solid", shells=[{"ref": "shell"}]) | {"properties": {"volume": 10.7, "floors": [1]}}]),
    }
    return json.dumps(doc)


def test_documents(spark):
    docs = csdm.from_strings(spark, {"good": tetrahedron(), "dangling": tetrahedron({"x": "ab"}.items()), "lost": tetrahedron(drop="d"), "flat": json.dumps({"points": [{"features": [{"id": "p", "geometry": {"coordinates": [1, 2]}}]}]})})
    t = csdm.load(docs).mapped(lambda _, df: df.coalesce(1).persist())
    issues = validate(t, classes=["CC-01", "CC-02"]).persist()
    found = {(r.dataset_id, r.code) for r in issues.collect()}
    assert not {c for d, c in found if d == "good"}
    assert {c for d, c in found if d == "dangling"} == {"DANGLING_CURVE", "DUPLICATE_CURVE"}
    assert ("lost", "UNKNOWN_POINT_REFERENCE") in found
    assert {c for d, c in found if d == "flat"} == {"NO_3D_TOPOLOGY"}
    status = {(r.dataset_id, r.rule): r.status for r in rule_results(issues).collect()}
    assert status["dangling", "TR-03"] == "FAIL" and status["flat", "Structure"] == "WARN" and status["dangling", "TR-01"] == "PASS"
    one = issues.where("dataset_id = 'dangling'")
    assert json.loads(report.to_json(one))["errorCount"] == 2
    assert "DANGLING_CURVE" in report.to_text(one) and "<html" in report.to_html(one)
    faces = {r.id: json.loads(r.coordinates) for r in geometries(t, "faces").where("dataset_id = 'good'").collect()}
    assert faces["front"] == [[[0, 0, 0], [4, 0, 0], [0, 0, 4], [0, 0, 0]]]


def test_chain_flips_and_prepends(spark):
    lines = [("d", "r", 0, [[1.0, 0.0], [2.0, 0.0]]), ("d", "r", 1, [[2.0, 2.0], [2.0, 0.0]]), ("d", "r", 2, [[0.0, 0.0], [1.0, 0.0]]), ("d", "r", 3, [[2.0, 2.0], [0.0, 0.0]])]
    ring = chained(spark.createDataFrame(lines, "dataset_id string, ring_id string, pos int, line array<array<double>>")).first().ring
    assert ring == [[0, 0], [1, 0], [2, 0], [2, 2], [0, 0]]


def test_box_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    low = rng.uniform(-50, 50, (300, 3))
    size = np.exp2(rng.uniform(-6, 6, (300, 3)))
    rows = [("k", i, *sum(([float(a), float(a + s)] for a, s in zip(lo, sz, strict=True)), [])) for i, (lo, sz) in enumerate(zip(low, size, strict=True))]
    df = spark.createDataFrame(rows, "key string, ord int, x1 double, x2 double, y1 double, y2 double, z1 double, z2 double")
    box = [f"{c}{i}" for c in "xyz" for i in (1, 2)]
    pairs = box_pairs(df, ["key"], box, box)
    for c in "xyz":
        pairs = pairs.where(f"a_{c}1 <= b_{c}2 and b_{c}1 <= a_{c}2")
    got = [(r.a_ord, r.b_ord) for r in pairs.collect()]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if (low[i] <= low[j] + size[j]).all() and (low[j] <= low[i] + size[i]).all()}
    assert len(got) == len(set(got)) and set(got) == want
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()


def test_curves(spark):
    rows = [("arc", "Arc", [[10.0, 10.0], [10 + 10 * 2**-0.5, 20 - 10 * 2**-0.5], [20.0, 20.0]], None, None), ("circle", "CircleByCenter", [[10.0, 20.0]], 10.0, None), ("chord", "ArcByChord", [[0.0, 0.0], [1.0, 0.0]], 0.1, "cw")]
    got = {r.id: r.line for r in curves.densified(spark.createDataFrame(rows, "id string, type string, p array<array<double>>, radius double, orientation string")).collect()}
    assert len(got["arc"]) == 14 and len(got["circle"]) == 51 and got["chord"] is None
    pts = np.array([[10, 10], [14, 12.5], [12.5, 15], [15.5, 16], [18, 15.5], [16.5, 18.5], [20, 20]], float)
    assert len(curves.spline(pts, 0.02)) == 36
    pts = np.array([[10, 10], [14, 12.5], [12.5, 15], [15.5, 16], [20, 20]], float)
    assert len(curves.spline(pts, 0.02, np.array([1.0, 0]), np.array([0, 1.0]))) == 32
    with pytest.raises(ValueError):
        curves.spline(pts, 0.0)


def test_mesh_has_one_dataset(spark):
    assert mesh(spark, SF).solid.select("dataset_id").distinct().count() == 1


def turtle_tetrahedron(change=lambda text: text):
    doc = json.loads(tetrahedron())
    out = ["@prefix : <http://e/t/> . @prefix geojson: <https://purl.org/geojson/vocab#> . @prefix topo: <https://purl.org/geojson/topo#> ."]
    refs = lambda rs: "( " + " ".join(f'[ topo:ref ":{r["ref"]}"' + (f' ; topo:orientation "{r["orientation"]}"' if "orientation" in r else "") + " ]" for r in rs) + " )"
    for key in ("points", "edges", "rings", "faces", "shells", "solids"):
        for f in doc[key][0]["features"]:
            t = f.get("topology")
            if key == "points":
                body = "geojson:geometry [ a geojson:Point ; geojson:coordinates ( " + " ".join(map(str, f["place"]["coordinates"])) + " ) ]"
            elif key == "edges":
                body = "geojson:topology [ a topo:Edge ; topo:relatedFeatures ( " + " ".join(f":{r}" for r in t["references"]) + " ) ]"
            else:
                body = f"geojson:topology [ a topo:{key[:-1].title()} ; " + (f"topo:shells {refs(t['shells'])}" if key == "solids" else f"topo:directedReferences {refs(t['directed_references'])}") + " ]"
            out.append(f":{f['id']} a geojson:Feature ; {body} .")
    return change("\n".join(out))


def test_turtle_graph_is_the_model_of_its_document(spark):
    from dataclasses import fields

    from meshwright.sources import turtle

    texts = {"good": turtle_tetrahedron(), "dangling": turtle_tetrahedron(lambda x: x + "\n:x a geojson:Feature ; geojson:topology [ a topo:Edge ; topo:relatedFeatures ( :a :b ) ] ."), "few": turtle_tetrahedron(lambda x: x.replace("( :a :b )", "( :a )").replace('":rslope"', '":nowhere"').replace('topo:ref ":shell"', 'topo:no ":shell"'))}
    t = turtle.load(turtle.named(spark.createDataFrame(list(texts.items()), "dataset_id string, text string").coalesce(1)).persist()).mapped(lambda _, df: df.coalesce(1).persist())
    want = csdm.load(csdm.from_strings(spark, {"good": tetrahedron()}))
    for f in fields(want):
        a, b = getattr(want, f.name), getattr(t, f.name)
        cols = sorted(c for c in a.columns if not c.endswith("ord") and c not in ("volume", "level"))
        rows = lambda df, cols=cols: sorted(map(str, df.where("dataset_id = 'good'").select(cols).collect()))
        assert set(a.columns) == set(b.columns) and rows(a) == rows(b), f.name
    few = {n: {r.id for r in getattr(t, n).where("dataset_id = 'few'").collect()} for n in ("point", "curve", "surface", "solid")}
    assert few == {"point": set("abcd"), "curve": {"bc", "ca", "ad", "bd", "cd"}, "surface": {"bottom", "front", "left"}, "solid": set()}
    found = {(r.dataset_id, r.rule) for r in validate(t, classes=["CC-01", "CC-02", "CC-03"]).collect()}
    assert ("dangling", "TR-13") in found and not {r for d, r in found if d == "good"}


def test_group_pairs_with_large_groups(spark, monkeypatch):
    from meshwright.operators import spatial

    rng = np.random.default_rng(6)
    low = rng.uniform(0, 30, (90, 3))
    rows = [("k" if i < 60 else "m", i, *sum(([float(a), float(a) + 4] for a in lo), [])) for i, lo in enumerate(low)]
    df = spark.createDataFrame(rows, "key string, ord int, x1 double, x2 double, y1 double, y2 double, z1 double, z2 double")
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if (i < 60) == (j < 60) and (abs(low[i] - low[j]) <= 4).all()}
    box = [f"{c}{i}" for c in "xyz" for i in (1, 2)]
    for small in (2000, 40):
        monkeypatch.setattr(spatial, "SMALL", small)
        pairs = spatial.group_pairs(df, ["key"], box, box)
        for c in "xyz":
            pairs = pairs.where(f"a_{c}1 <= b_{c}2 and b_{c}1 <= a_{c}2")
        got = [(r.a_ord, r.b_ord) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_merge_keeps_places_and_clean_joins_coincident_geometry(spark):
    from meshwright.operators.resolve import cleaned

    one = csdm.load(csdm.from_strings(spark, {"d": tetrahedron()}))
    two = csdm.load(csdm.from_strings(spark, {"d": json.dumps({"points": [{"features": [{"id": "z", "geometry": {"coordinates": [0, 0, 4]}}, {"id": "b", "geometry": {"coordinates": [9, 0, 0]}}]}], "edges": [{"features": [feature("ab", references=[]), feature("zc", references=["z", "c"])]}]})}))
    t = csdm.merged(one, two)
    assert [r.id for r in t.point.orderBy("ord").collect()] == ["a", "b", "c", "d", "z"] and t.point.where("id = 'b'").first().x == 9
    assert [r.id for r in t.curve.orderBy("ord").collect()][:2] == ["ab", "bc"] and t.curve_vertex.where("curve_id = 'ab'").count() == 0
    c = cleaned(t)
    assert {r.id for r in c.point.collect()} == set("abcd") and "zc" not in {r.id for r in c.curve.collect()}


def test_reports_of_valid_models_and_command_lines(spark, tmp_path, capsys):
    from meshwright import cli
    from meshwright.plans.validate import datasets, findings, has_error

    path = tmp_path / "good.json"
    path.write_text(tetrahedron())
    assert cli.main(["validate", str(path), "--format", "json", "--classes", "CC-01", "CC-05"], spark) == 0
    body = json.loads(capsys.readouterr().out)
    assert body["valid"] and len(body["ruleResults"]) == 26 and {r["status"] for r in body["ruleResults"]} == {"PASS"}
    assert cli.main(["convert", str(path), "--mode", "points,faces", "--number", "2"], spark) == 0
    features = json.loads(capsys.readouterr().out)["features"]
    assert [f["geometry"]["type"] for f in features].count("Polygon") == 2 and len(features) == 6
    raw = tmp_path / "raw.json"
    raw.write_text('{"points": [], "curves": [], "surfaces": []}')
    assert cli.main(["validate", "--raw", str(raw)], spark) == 1 and "MISSING_COLLECTION" in capsys.readouterr().out
    t = csdm.load(csdm.from_strings(spark, {"bad": tetrahedron(drop="d"), "good": tetrahedron()}))
    issues = validate(t, classes=["CC-01"])
    assert {r[0] for r in datasets(t).collect()} == {"bad", "good"} and has_error(issues, "UNKNOWN_POINT_REFERENCE").first().found
    assert findings(issues).first().is_error
    assert {r.found for r in cli.looks_like_topology(csdm.from_strings(spark, {"d": tetrahedron()})).collect()} == {True}


def test_reprojection_known_position_and_arc_faults(spark):
    from pyspark.sql import functions as F

    from meshwright.functions import crs

    rows = spark.createDataFrame([([500000.0, 10000000.0, 3.0],), ([1.0],)], "c array<double>")
    got = [r[0] for r in rows.select(crs.reprojected(F.col("c"), "EPSG:7850")).collect()]
    assert got[0] == pytest.approx([117.0, 0.0, 3.0]) and got[1] == [1.0]
    assert crs.is_geographic(" [EPSG:4326] ") and crs.zone("EPSG:32733").meridian == 15 and crs.zone("EPSG:3857") is None
    arcs = [("a", "Arc", [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], None, None), ("b", "ArcWithCenter", [[1.0, 0.0], [0.0, 0.0], [0.0, 2.0]], None, "ccw"), ("c", "ArcByChord", [[0.0, 0.0], [4.0, 0.0]], 1.0, "cw"), ("d", "Bow", [[0.0, 0.0]], None, None), ("e", "CircleByCenter", [[0.0, 0.0]], 2.0, None)]
    got = {r.id: r.fault for r in curves.faults(spark.createDataFrame(arcs, "id string, type string, p array<array<double>>, radius double, orientation string")).collect()}
    assert got == {"a": "POINTS_ON_A_LINE", "b": "RADII_DIFFER", "c": "RADIUS_TOO_SMALL", "d": "UNKNOWN_TYPE", "e": None}
    stats = curves.chord_statistics(spark.createDataFrame([(10.0, 1.5)], "radius double, sweep double")).first()
    assert stats.arc_length == 15 and stats.reached <= 0.02 and stats.chords * stats.chord_length < 15
    assert spark.createDataFrame([([[1.0, 2.0], [4.0, 6.0]],)], "l array<array<double>>").select(curves.tangent(F.col("l"))).first()[0] == [3, 4]

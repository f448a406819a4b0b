"""Documents with holes, voids, levels and observations, one dataset for each part, and the issues that their faults have.

They reach what the mesh over orders does not: second rings, inner shells, levels, observed curves and many datasets at once.
A part's key decides the size and place of its boxes, how far the second of a pair stands off, and where a hole's ring begins.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Tolerances
from ..operators.rules import RULES
from ..sources import csdm
from ..storage import in_place, placed, stored

#: The corners of a box's faces, counter-clockwise from outside; a corner is a bit for each axis.
LOOPS = {"x0": (0, 4, 6, 2), "x1": (1, 3, 7, 5), "y0": (0, 1, 5, 4), "y1": (2, 6, 7, 3), "z0": (0, 2, 3, 1), "z1": (4, 5, 7, 6)}
APPLIED = ("TR-03", "TR-04", "TR-08", "TR-25")


def box(name: str, low: int | str, high: int | str) -> dict:
    """The features of one box; its coordinates are marks that the part's numbers replace."""
    corner = lambda c: f"{name}{c}"
    edge = lambda a, b: f"{name}{min(a, b)}-{max(a, b)}"
    sides = {f: list(zip(loop, loop[1:] + loop[:1], strict=True)) for f, loop in LOOPS.items()}
    edges = sorted({(min(s), max(s)) for loop in sides.values() for s in loop})
    return {
        "points": [{"id": corner(c), "place": {"coordinates": [f"@{high if c >> k & 1 else low}@" for k in range(3)]}} for c in range(8)],
        "edges": [{"id": edge(*e), "topology": {"references": [corner(e[0]), corner(e[1])]}} for e in edges],
        "rings": [{"id": f"r{name}{f}", "topology": {"directed_references": [{"ref": edge(*s), "orientation": "+" if s[0] < s[1] else "-"} for s in loop]}} for f, loop in sides.items()],
        "faces": [{"id": f"{name}{f}", "topology": {"directed_references": [{"ref": f"r{name}{f}"}]}} for f in LOOPS],
    }


def document(*parts: dict) -> str:
    out: dict[str, list] = {}
    for p in parts:
        for key, found in p.items():
            out.setdefault(key, []).extend(found)
    return json.dumps({k: [{"features": v}] for k, v in out.items()})


def shell(id_: str, name: str, sign: str) -> dict:
    return {"shells": [{"id": id_, "topology": {"directed_references": [{"ref": f"{name}{f}", "orientation": sign} for f in LOOPS]}}]}


def solid(id_: str, *shells: str, **properties) -> dict:
    return {"solids": [{"id": id_, "topology": {"shells": [{"ref": s} for s in shells]}, "properties": {"volume": 1, **properties}}]}


def hollow(outer: str = "+", inner: str = "-", *more: dict) -> str:
    """A box of 10 with a void of 2."""
    return document(box("a", 0, 10), box("b", 4, 6), shell("sa", "a", outer), shell("sb", "b", inner), solid("v", "sa", "sb"), *more)


def pair(first: dict, second: dict) -> str:
    """Two boxes, each with a solid of its own."""
    return document(box("a", 0, 10), box("b", "near", "far"), shell("sa", "a", "+"), shell("sb", "b", "+"), solid("v", "sa", **first), solid("w", "sb", **second))


def with_hole(*hole: str) -> str:
    """A box whose first face has a second ring of the sides of another one's; hole: its directed edges."""
    text = json.loads(hollow())
    text["rings"][0]["features"].append({"id": "hole", "topology": {"directed_references": [{"ref": h[:-1], "orientation": h[-1]} for h in hole]}})
    next(f for f in text["faces"][0]["features"] if f["id"] == "ax0")["topology"]["directed_references"].append({"ref": "hole"})
    return json.dumps(text)


LOOSE = {"edges": [{"id": "loose", "topology": {"references": ["a0", "a7"]}}]}
#: Document, and what is wrong with it: rule, code, object, detail, and the signed volume of boxes of size 1 that ends the detail.
CASES = [
    (hollow(), None),
    (hollow("+", "+"), ("TR-25", "INNER_SHELL_ORIENTATION_REVERSED", "v", "1|", 8)),
    (hollow("-", "-"), ("TR-25", "SHELL_ORIENTATION_REVERSED", "v", "0|", -1000)),
    (hollow("+", "-", LOOSE), ("TR-03", "DANGLING_CURVE", "loose", "", None)),
    (hollow("+", "-", LOOSE, {"observedVectors": [{"topology": {"ref": "loose"}}]}), None),
    (hollow("+", "-", LOOSE, {"vectorObservations": [{"topology": {"directed_references": [{"ref": "loose"}]}}]}), None),
    (pair({}, {}), ("TR-08", "SOLID_OVERLAP", "v", "w|default", None)),
    (pair({"levels": ["L1"]}, {"levels": ["L2"]}), None),
    (pair({"levels": ["L1", "L2"]}, {"floors": ["L2"]}), ("TR-08", "SOLID_OVERLAP", "v", "w|default", None)),
    (pair({"theme": "air"}, {}), None),
    (pair({}, {"parent_id": "v"}), None),
    (with_hole("b0-4+", "b4-6+", "b2-6-", "b0-2-"), None),
]
#: The last case's ring: it breaks after its second and after its third edge, wherever it begins.
BROKEN = ("b0-4+", "b4-6+", "b2-6+", "b0-2-")
N = len(CASES) + 1
#: Numbers of a part with the key k.
SIZE, ORIGIN, OFF, TURN = "1 + k % 5", "k % 3 * 100", "k % 7 * 2", f"k // {N} % 4"


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of four rules in one document for each part, with the case that its key decides."""
    texts = [(i, turn, text) for turn in range(4) for i, text in enumerate([text for text, _ in CASES] + [with_hole(*BROKEN[turn:], *BROKEN[:turn])])]
    spark = placed(spark, spark.read.parquet(f"{sf_dir}/part.parquet").count())
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    number = lambda e: F.expr(f"cast({e.replace('//', 'div')} as int)")
    part = part.select(F.concat(F.lit("d:"), "k").alias("dataset_id"), number(f"k % {N}").alias("case"), number(TURN).alias("turn"), number(SIZE).alias("size"), number(ORIGIN).alias("origin"), number(OFF).alias("off"))
    docs = in_place(part).join(F.broadcast(spark.createDataFrame(texts, "case int, turn int, json string")), ["case", "turn"])
    json = F.col("json")
    for mark, at in {"0": F.lit(0), "4": F.lit(4), "6": F.lit(6), "10": F.lit(10), "near": F.col("off"), "far": F.col("off") + 10}.items():
        json = F.replace(json, F.lit(f'"@{mark}@"'), (F.col("origin") + F.col("size") * at).cast("string"))
    t = csdm.load(docs.select("dataset_id", F.parse_json(json).alias("doc"))).mapped(lambda _, df: stored(df))
    out = None
    for name in APPLIED:
        found = RULES[name][2](t, Tolerances())
        out = found if out is None else out.unionByName(found)
    return out.drop("severity")


def issues_sql() -> str:
    """Volumes grow with the cube of the size; boxes that stand off by ten or more don't overlap; the first break of a ring is where its beginning leaves it."""
    value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    rows = ", ".join(f"({', '.join(map(value, (i, *found)))})" for i, (_, found) in enumerate(CASES) if found)
    return f"""WITH p AS (SELECT k, {SIZE} AS size, {OFF} AS off, {TURN} AS turn FROM (SELECT p_partkey AS k FROM part) q),
broken AS (SELECT k, unnest([1, 2]) AS edge, (unnest([1, 2]) - turn + 4) % 4 AS place FROM p WHERE k % {N} = {N - 1})
SELECT concat('d:', k) AS dataset_id, rule, code, object_id, concat(detail, CAST(volume * size ** 3 AS DOUBLE)) AS detail
FROM p JOIN (VALUES {rows}) AS f(c, rule, code, object_id, detail, volume) ON k % {N} = c WHERE rule <> 'TR-08' OR off < 10
UNION ALL SELECT concat('d:', k), 'TR-04', 'SURFACE_RING_NOT_CLOSED', 'ax0', concat('1|', min(place), '|', CASE arg_min(edge, place) WHEN 1 THEN 'b4-6' ELSE 'b2-6' END) FROM broken GROUP BY k"""

"""Arcs, circles and cubic splines within a sagitta of the true curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import arc_points, chord_centre, circle_points, circumcentre, let, turns_clockwise

DEPTH = 20


def densified(arcs: DataFrame, sagitta: float = 0.02) -> DataFrame:
    """arcs with line, the vertices of each.

    arcs: id, type and control points p (array of [x, y]), radius and orientation (cw or ccw, may be null).
    Arc: start, middle, end.  ArcWithCenter: start, centre, end, counter-clockwise unless told.  ArcByChord: start, end, radius.
    CircleByCenter: centre and radius.  Null where the points don't define the curve.
    """
    xy = lambda i: (F.get(F.get("p", F.lit(i)), F.lit(0)), F.get(F.get("p", F.lit(i)), F.lit(1)))
    a, b, c = xy(0), xy(1), xy(2)
    cw = F.coalesce(F.col("orientation") == "cw", F.lit(False))
    hyp = lambda u, v: F.sqrt((u[0] - v[0]) * (u[0] - v[0]) + (u[1] - v[1]) * (u[1] - v[1]))
    pair = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    real = lambda value: value.cast("double")

    def arc(start, end, centre, radius, clockwise):  # what every arc comes down to; a circle has no end
        return F.struct(*[real(v).alias(n) for n, v in zip(("sx", "sy", "ex", "ey", "cx", "cy", "r"), (*start, *end, *centre, radius), strict=True)], clockwise.alias("cw"))

    none = (F.lit(None), F.lit(None))
    through = let(pair(circumcentre(a, b, c)), lambda m: arc(a, c, (m["x"], m["y"]), hyp(a, (m["x"], m["y"])), turns_clockwise(a, b, c)))
    apart = F.abs(hyp(a, b) - hyp(c, b)) <= F.greatest(F.lit(0.005), F.lit(0.001) * hyp(a, b))
    centred = F.when(apart, arc(a, c, b, (hyp(a, b) + hyp(c, b)) / 2, cw))
    chord = let(pair(chord_centre(a, b, F.col("radius"), cw)), lambda m: arc(a, b, (m["x"], m["y"]), F.col("radius"), cw))
    circle = arc(none, none, a, F.col("radius"), F.lit(False))
    kind = F.col("type")
    shape = F.when(kind == "Arc", through).when(kind == "ArcWithCenter", centred).when(kind == "ArcByChord", chord).when(kind == "CircleByCenter", circle)

    def drawn(g):
        s = F.lit(sagitta)
        open_ = arc_points(*[g[n] for n in ("sx", "sy", "ex", "ey", "cx", "cy", "r", "cw")], s)
        return F.when(kind == "CircleByCenter", circle_points(g["cx"], g["cy"], g["r"], s)).otherwise(open_)

    return arcs.withColumn("line", let(shape, drawn))


def _v(*parts: tuple[Column | float, Column]) -> Column:
    """The sum of multiples of vectors of three."""
    return F.array(*[sum((k * F.get(v, F.lit(i)) for k, v in parts[1:]), parts[0][0] * F.get(parts[0][1], F.lit(i))) for i in range(3)])


def _dot(u: Column, v: Column) -> Column:
    return sum((F.get(u, F.lit(i)) * F.get(v, F.lit(i)) for i in (1, 2)), F.get(u, F.lit(0)) * F.get(v, F.lit(0)))


def slopes(points: Column, h: Column, first: Column, last: Column) -> Column:
    """Derivatives at the knots of the C2 cubic through points (of three ordinates) with spans h; clamped by both end tangents, else with relaxed ends.

    The system has three diagonals: one pass forward eliminates the lower, one backward solves it.
    """
    n = F.size(points)
    at, span = (lambda i: F.get(points, i)), (lambda i: F.get(h, i))
    clamped = first.isNotNull() & last.isNotNull()
    row = lambda a, b, c, r: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), r.alias("r"))
    zero, one = F.lit(0.0), F.lit(1.0)

    def inner(i: Column) -> Column:
        lo, hi = 1 / span(i - 1), 1 / span(i)
        return row(lo, 2 * (lo + hi), hi, _v((3 * hi * hi, at(i + 1)), (3 * (lo * lo - hi * hi), at(i)), (-3 * lo * lo, at(i - 1))))

    head = F.when(clamped, row(zero, one, zero, first)).otherwise(row(zero, 2 * span(F.lit(0)), span(F.lit(1)), _v((F.lit(3.0), at(F.lit(1))), (F.lit(-3.0), at(F.lit(0))))))
    tail = F.when(clamped, row(zero, one, zero, last)).otherwise(row(span(n - 2), 2 * span(n - 2), zero, _v((F.lit(3.0), at(n - 1)), (F.lit(-3.0), at(n - 2)))))
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, head).when(i == n - 1, tail).otherwise(inner(i)))

    def forward(acc: Column, x: Column) -> Column:
        def made(q: Column) -> Column:
            return F.array_append(acc, F.struct((x["c"] / q["m"]).alias("c"), _v((1 / q["m"], x["r"]), (-x["a"] / q["m"], q["d"])).alias("d")))

        before = F.get(acc, F.size(acc) - 1)
        return let(F.struct((x["b"] - x["a"] * F.coalesce(before["c"], zero)).alias("m"), F.coalesce(before["d"], F.array(zero, zero, zero)).alias("d")), made)

    def backward(acc: Column, x: Column) -> Column:
        return F.array_append(acc, F.when(F.size(acc) == 0, x["d"]).otherwise(_v((one, x["d"]), (-x["c"], F.get(acc, F.size(acc) - 1)))))

    solved = F.aggregate(rows, F.array().cast("array<struct<c:double,d:array<double>>>"), forward)
    return F.reverse(F.aggregate(F.reverse(solved), F.array().cast("array<array<double>>"), backward))


def flattened(points: Column, h: Column, d: Column, sagitta: float) -> Column:
    """Vertices of the cubics between points: every span is halved until its middle lies within sagitta of the chord, at most DEPTH times.

    A level halves all spans that still need it, so the levels are a bounded fold over arrays.
    """
    start = F.transform(
        F.sequence(F.lit(0), F.size(points) - 2),
        lambda i: F.struct(
            F.get(points, i).alias("a"), F.get(points, i + 1).alias("b"), _v((F.get(h, i), F.get(d, i))).alias("da"), _v((F.get(h, i), F.get(d, i + 1))).alias("db"),
            F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.get(points, i).alias("p"), F.get(points, i + 1).alias("q"), F.lit(False).alias("done"),
        ),
    )

    def middle(s: Column) -> Column:
        u = (s["lo"] + s["hi"]) / 2
        return let(u, lambda u: F.struct(u.alias("u"), _v((2 * u * u * u - 3 * u * u + 1, s["a"]), (u * u * u - 2 * u * u + u, s["da"]), (3 * u * u - 2 * u * u * u, s["b"]), (u * u * u - u * u, s["db"])).alias("m")))

    def halved(s: Column) -> Column:
        same = lambda lo, hi, p, q, done: F.struct(*[s[c].alias(c) for c in ("a", "b", "da", "db")], lo.alias("lo"), hi.alias("hi"), p.alias("p"), q.alias("q"), F.lit(done).alias("done"))

        def judged(x: Column) -> Column:
            one = F.lit(1.0)
            along, to = _v((one, s["q"]), (F.lit(-1.0), s["p"])), _v((one, x["m"]), (F.lit(-1.0), s["p"]))

            def off(q: Column) -> Column:
                t = F.coalesce(F.least(F.greatest(F.try_divide(_dot(q["to"], q["along"]), _dot(q["along"], q["along"])), F.lit(0.0)), one), F.lit(0.0))
                return let(t, lambda t: let(_v((one, q["to"]), (-t, q["along"])), lambda w: F.sqrt(_dot(w, w)) <= sagitta))

            close = let(F.struct(along.alias("along"), to.alias("to")), off)
            return F.when(close, F.array(same(s["lo"], s["hi"], s["p"], s["q"], True))).otherwise(F.array(same(s["lo"], x["u"], s["p"], x["m"], False), same(x["u"], s["hi"], x["m"], s["q"], False)))

        return F.when(s["done"], F.array(s)).otherwise(let(middle(s), judged))

    level = lambda acc, _: F.when(F.forall(acc, lambda s: s["done"]), acc).otherwise(F.flatten(F.transform(acc, halved)))
    spans = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, level)
    return F.concat(F.array(F.get(points, F.lit(0))), F.transform(spans, lambda s: s["q"]))


def splined(rows: DataFrame, sagitta: float = 0.02, alpha: float = 0.5) -> DataFrame:
    """rows (p: control points; first and last: tangent vectors or null) with line and fault.

    The spline is clamped to its tangents where both are given.  Knots lie apart by the distance to the power of alpha (0 uniform, 0.5 centripetal, 1 chordal).  Lines have a
    third ordinate where a control point has one (those without count as 0).  Points that coincide with the next, and two points without
    tangents, give the straight line through all.  A spline that can't be drawn has no line, and a fault that says why.
    """
    padded = lambda c: F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.coalesce(F.get(c, i), F.lit(0.0)).cast("double"))
    finite = F.forall("p", lambda q: q.isNotNull() & (F.size(q) >= 2) & F.forall(q, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    fault = F.when(F.lit(sagitta <= 0), "SAGITTA_NOT_POSITIVE").when(F.coalesce(F.size("p"), F.lit(0)) < 2, "TOO_FEW_POINTS").when(~finite, "INVALID_COORDINATES")
    tangents_given = F.col("first").isNotNull() & F.col("last").isNotNull()
    rows = rows.withColumn("fault", fault).withColumn("_deep", F.exists("p", lambda q: F.size(q) > 2)).withColumn("_p", F.when(F.col("fault").isNull(), F.transform("p", padded)))
    rows = rows.withColumn("_first", F.when(tangents_given, padded(F.col("first")))).withColumn("_last", F.when(tangents_given, padded(F.col("last"))))
    gap = F.zip_with(F.slice("_p", F.lit(1), F.size("_p") - 1), F.slice("_p", F.lit(2), F.size("_p") - 1), lambda a, b: let(_v((F.lit(1.0), b), (F.lit(-1.0), a)), lambda w: F.pow(F.sqrt(_dot(w, w)), F.lit(alpha))))
    rows = rows.withColumn("_h", gap)
    straight = F.exists("_h", lambda x: x == 0) | ((F.size("_p") == 2) & ~tangents_given)
    rows = rows.withColumn("_d", F.when(~straight, slopes(F.col("_p"), F.col("_h"), F.col("_first"), F.col("_last"))))
    drawn = F.when(F.col("_d").isNull(), F.col("_p")).otherwise(flattened(F.col("_p"), F.col("_h"), F.col("_d"), sagitta))
    rows = rows.withColumn("_line", drawn)
    line = F.when(F.col("_deep"), F.col("_line")).otherwise(F.transform("_line", lambda q: F.slice(q, 1, 2)))
    return rows.withColumn("line", line).drop("_deep", "_p", "_first", "_last", "_h", "_d", "_line")


def spline(points, sagitta: float, first=None, last=None, alpha: float = 0.5) -> list[list[float]]:
    """The vertices of one spline (a list of positions), by the active session; raises where it can't be drawn."""
    real = lambda v: None if v is None else [float(x) for x in v]
    rows = SparkSession.active().createDataFrame([([real(p) for p in points], real(first), real(last))], "p array<array<double>>, first array<double>, last array<double>")
    found = splined(rows, sagitta, alpha).first()
    if found.fault:
        raise ValueError(found.fault)
    return found.line


def chord_statistics(arcs: DataFrame, sagitta: float = 0.02) -> DataFrame:
    """arcs (radius, sweep in radians) with their length, chords, chord_angle, chord_length and the sagitta that these chords reach."""
    from ..functions.geometry import chord_count

    n = chord_count(F.col("radius"), F.col("sweep"), F.lit(sagitta))
    out = arcs.withColumn("chords", n).withColumn("arc_length", F.col("radius") * F.abs("sweep")).withColumn("chord_angle", F.abs("sweep") / F.col("chords"))
    return out.withColumn("chord_length", 2 * F.col("radius") * F.sin(F.col("chord_angle") / 2)).withColumn("reached", F.col("radius") * (1 - F.cos(F.col("chord_angle") / 2)))


def faults(arcs: DataFrame, sagitta: float = 0.02, absolute: float = 0.005, relative: float = 0.001) -> DataFrame:
    """arcs (like densified's) with fault: why an arc can't be drawn, else null; the first reason that holds counts."""
    xy = lambda i: (F.get(F.get("p", F.lit(i)), F.lit(0)), F.get(F.get("p", F.lit(i)), F.lit(1)))
    a, b, c = xy(0), xy(1), xy(2)
    hyp = lambda u, v: F.sqrt((u[0] - v[0]) * (u[0] - v[0]) + (u[1] - v[1]) * (u[1] - v[1]))
    kind = F.col("type")
    need = F.when(kind.isin("Arc", "ArcWithCenter"), 3).when(kind == "ArcByChord", 2).when(kind == "CircleByCenter", 1)
    finite = F.forall(F.flatten("p"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    tolerance = F.greatest(F.lit(absolute), F.lit(relative) * hyp(a, b))
    reason = (
        F.when(need.isNull(), "UNKNOWN_TYPE")
        .when(F.lit(sagitta <= 0), "SAGITTA_NOT_POSITIVE")
        .when(F.coalesce(F.size("p"), F.lit(0)) < need, "TOO_FEW_POINTS")
        .when(~finite | F.exists("p", lambda q: F.size(q) < 2), "INVALID_COORDINATES")
        .when(F.col("orientation").isNotNull() & ~F.col("orientation").isin("cw", "ccw"), "INVALID_DIRECTION")
        .when((kind == "Arc") & circumcentre(a, b, c)[0].isNull(), "POINTS_ON_A_LINE")
        .when((kind == "ArcWithCenter") & ((hyp(a, b) == 0) | (hyp(c, b) == 0)), "ZERO_RADIUS")
        .when((kind == "ArcWithCenter") & (F.abs(hyp(a, b) - hyp(c, b)) > tolerance), "RADII_DIFFER")
        .when((kind == "ArcWithCenter") & (F.abs(hyp(a, b) - F.col("radius")) > tolerance), "RADIUS_NOT_AS_STATED")
        .when(kind.isin("ArcByChord", "CircleByCenter") & ~F.coalesce(F.col("radius") > 0, F.lit(False)), "RADIUS_NOT_POSITIVE")
        .when((kind == "ArcByChord") & chord_centre(a, b, F.col("radius"), F.lit(False))[0].isNull(), "RADIUS_TOO_SMALL")
    )
    return arcs.withColumn("fault", reason)


def tangent(line: str):
    """The vector from the first to the second position of a line; null for fewer positions or where they coincide."""
    first, second = F.get(line, F.lit(0)), F.get(line, F.lit(1))
    return F.when((F.size(line) >= 2) & (first != second), F.zip_with(second, first, lambda x, y: x - y))

"""Geometry as column expressions: everything here stays in generated code."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
CROSSING_TOLERANCE = 1e-9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def distance(a: Vector, b: Vector) -> Column:
    d = minus(a, b)
    return F.sqrt(dot(d, d))


def properly_cross(p1: Vector, p2: Vector, p3: Vector, p4: Vector, tolerance: float = CROSSING_TOLERANCE) -> Column:
    """Whether the open segments p1-p2 and p3-p4 meet in one point: not parallel, coplanar within the tolerance, both parameters strictly inside."""
    d1, d2, r = minus(p2, p1), minus(p4, p3), minus(p3, p1)
    n = cross(d1, d2)
    return inside_both(dot(n, n), dot(r, n), dot(cross(r, d2), n), dot(cross(r, d1), n), tolerance)


def inside_both(q: Column, rn: Column, t: Column, s: Column, tolerance: float = CROSSING_TOLERANCE) -> Column:
    """properly_cross by q = n·n, rn = r·n, t = (r x d2)·n and s = (r x d1)·n, where n = d1 x d2."""
    square = tolerance * tolerance
    # t/q and s/q lie in (0, 1); q is never 0 here, and try_divide keeps the discarded branch from raising
    inside = lambda x: (F.try_divide(x, q) > 0.0) & (F.try_divide(x, q) < 1.0)
    return F.coalesce((q >= square) & (F.try_divide(rn * rn, q) <= square) & inside(t) & inside(s), F.lit(False))


def fan_volume(ring: Column) -> Column:
    """Six times the signed volume under a ring (array of structs x, y, z): fans from its first vertex."""

    def part(acc: Column, i: Column) -> Column:
        a, b, c = F.get(ring, F.lit(0)), F.get(ring, i), F.get(ring, i + 1)
        v = lambda p: (p["x"], p["y"], p["z"])
        return acc + dot(v(a), cross(v(b), v(c)))

    return F.when(F.size(ring) >= 3, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring) - 2, F.lit(1))), F.lit(0.0), part)).otherwise(F.lit(0.0))


def chain(segments: Column) -> Column:
    """Segments (array of arrays of points) joined greedily in the given order, and closed.

    Each segment goes to the tail if it starts or (reversed) ends there, to the head if it ends or (reversed) starts there, else
    to the tail without its first point.
    """

    def step(acc: Column, seg: Column) -> Column:
        head, tail = F.get(acc, F.lit(0)), F.get(acc, F.size(acc) - 1)
        first, last = F.get(seg, F.lit(0)), F.get(seg, F.size(seg) - 1)
        rest = F.slice(seg, F.lit(2), F.greatest(F.size(seg) - 1, F.lit(0)))
        back = F.reverse(seg)
        back_rest = F.slice(back, F.lit(2), F.greatest(F.size(seg) - 1, F.lit(0)))
        short = F.slice(seg, F.lit(1), F.greatest(F.size(seg) - 1, F.lit(0)))
        back_short = F.slice(back, F.lit(1), F.greatest(F.size(seg) - 1, F.lit(0)))
        return (
            F.when(F.size(seg) == 0, acc)
            .when(F.size(acc) == 0, seg)
            .when(first == tail, F.concat(acc, rest))
            .when(last == tail, F.concat(acc, back_rest))
            .when(last == head, F.concat(short, acc))
            .when(first == head, F.concat(back_short, acc))
            .otherwise(F.concat(acc, rest))
        )

    def close(acc: Column) -> Column:
        return F.when((F.size(acc) > 0) & (F.get(acc, F.lit(0)) != F.get(acc, F.size(acc) - 1)), F.array_append(acc, F.get(acc, F.lit(0)))).otherwise(acc)

    return F.aggregate(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), F.get(segments, F.lit(0)), step, close)


# --- arcs -----------------------------------------------------------------


def point_angle(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    return F.pmod(F.atan2(y - cy, x - cx), F.lit(2 * math.pi))


def sweep(start: Column, end: Column, clockwise: Column) -> Column:
    """From start to end: [0, 2 pi) counter-clockwise, less 2 pi clockwise (a full circle if they coincide)."""
    ccw = F.pmod(end - start, F.lit(2 * math.pi))
    return F.when(clockwise, ccw - 2 * math.pi).otherwise(ccw)


def max_chord_angle(radius: Column, sagitta: Column) -> Column:
    """The widest angle whose chord stays within sagitta of the arc; null for radii or sagittas that aren't positive."""
    return F.when((radius > 0) & (sagitta > 0), F.when(sagitta >= radius, F.lit(math.pi)).otherwise(2 * F.acos(1 - sagitta / radius)))


MOST_CHORDS = 100_000


def chord_count(radius: Column, angle: Column, sagitta: Column) -> Column:
    """Chords of an arc; null beyond MOST_CHORDS."""
    n = F.ceil(F.abs(angle) / max_chord_angle(radius, sagitta)).cast("long")
    return F.when(n <= MOST_CHORDS, F.greatest(F.lit(1).cast("long"), n))


def arc_points(sx: Column, sy: Column, ex: Column, ey: Column, cx: Column, cy: Column, radius: Column, clockwise: Column, sagitta: Column) -> Column:
    """Vertices [x, y] of the arc, with exact ends; null where no arc is defined."""

    def turned(q: Column) -> Column:
        return let(F.struct(q["a0"].alias("a0"), sweep(q["a0"], q["a1"], clockwise).alias("turn")), counted)

    def counted(q: Column) -> Column:
        return let(F.struct(q["a0"].alias("a0"), q["turn"].alias("turn"), chord_count(radius, q["turn"], sagitta).alias("n")), drawn)

    def drawn(q: Column) -> Column:
        at = lambda i: q["a0"] + q["turn"] * i / q["n"]
        inner = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(q["n"] - 1, F.lit(1).cast("long"))), lambda i: F.array(cx + radius * F.cos(at(i)), cy + radius * F.sin(at(i))))
        ends = F.array(F.array(sx, sy)), F.array(F.array(ex, ey))
        return F.when(q["n"] == 1, F.concat(*ends)).when(q["n"] > 1, F.concat(ends[0], inner, ends[1]))

    return let(F.struct(point_angle(sx, sy, cx, cy).alias("a0"), point_angle(ex, ey, cx, cy).alias("a1")), turned)


def circle_points(cx: Column, cy: Column, radius: Column, sagitta: Column) -> Column:
    """Vertices of a full circle, closed; at least three different ones."""

    def drawn(n: Column) -> Column:
        ring = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.array(cx + radius * F.cos(2 * math.pi * i / n), cy + radius * F.sin(2 * math.pi * i / n)))
        return F.when(n <= MOST_CHORDS, let(ring, lambda r: F.array_append(r, F.get(r, F.lit(0)))))

    # greatest alone would ignore a null
    return let(F.ceil(2 * math.pi / max_chord_angle(radius, sagitta)).cast("long"), lambda n: let(F.when(n.isNotNull(), F.greatest(F.lit(3).cast("long"), n)), drawn))


def circumcentre(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> tuple[Column, Column]:
    """Centre of the circle through three points; null for points on a line (within 1e-12)."""
    d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
    sq = [p[0] * p[0] + p[1] * p[1] for p in (a, b, c)]
    x = sq[0] * (b[1] - c[1]) + sq[1] * (c[1] - a[1]) + sq[2] * (a[1] - b[1])
    y = sq[0] * (c[0] - b[0]) + sq[1] * (a[0] - c[0]) + sq[2] * (b[0] - a[0])
    ok = F.abs(d) > 1e-12
    return F.when(ok, F.try_divide(x, d)), F.when(ok, F.try_divide(y, d))


def turns_clockwise(s: tuple[Column, Column], m: tuple[Column, Column], e: tuple[Column, Column]) -> Column:
    return (m[0] - s[0]) * (e[1] - s[1]) - (m[1] - s[1]) * (e[0] - s[0]) <= 0


def chord_centre(s: tuple[Column, Column], e: tuple[Column, Column], radius: Column, clockwise: Column) -> tuple[Column, Column]:
    """Centre of the minor arc over a chord on the side that its direction asks for; null if the radius is too small."""
    dx, dy = e[0] - s[0], e[1] - s[1]
    half = F.sqrt(dx * dx + dy * dy) / 2
    height = F.sqrt(F.greatest(radius * radius - half * half, F.lit(0.0)))
    side = F.when(clockwise, -1.0).otherwise(1.0)
    ok = (radius >= half - 1e-9) & (half > 0)
    put = lambda mid, along: F.when(ok, mid + side * height * F.try_divide(along, 2 * half))
    return put((s[0] + e[0]) / 2, -dy), put((s[1] + e[1]) / 2, dx)


def local_name(s: Column) -> Column:
    """Of http(s) ids what follows ``#``, else the last ``/``; of others what follows the first ``:``; else all."""
    after = F.when(s.contains("#"), F.regexp_extract(s, "#(.*)$", 1)).otherwise(F.substring_index(s, "/", -1))
    return F.when(s.rlike("^https?://"), after).when(s.contains(":"), F.regexp_extract(s, "^[^:]*:(.*)$", 1)).otherwise(s)

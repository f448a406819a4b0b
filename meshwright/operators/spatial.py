"""Pairs of boxes that overlap, as an equi-join over a hierarchical grid: no cross join, whatever the boxes' sizes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

AXES = ("x", "y", "z")


def _cells(low: str, high: str, size: Column) -> Column:
    """Cells of one axis from low to high; the grid is shifted by half a cell, as coordinates like to lie on its multiples."""
    at = lambda c: F.floor(F.col(c) / size + 0.5).cast("long")
    return F.sequence(at(low), at(high))


def sizes(boxes: DataFrame) -> tuple[int, list[int]]:
    """The exponent of a cell near the median extent of the boxes, and the exponents that occur: a row of a few numbers."""
    extent = F.greatest(*[F.col(f"{a}2") - F.col(f"{a}1") for a in AXES], F.lit(2.0**-40))
    power = F.ceil(F.log2(extent)).cast("int")
    middle, found = boxes.agg(F.percentile_approx(power, 0.5, 1000), F.collect_set(power)).first()
    return middle or 0, found


def box_pairs(boxes: DataFrame, keys: list[str], left: list[str], right: list[str], size: float | None = None, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs of boxes of equal keys that share a cell, each once, the smaller ``ord`` as a_…, the other as b_….

    boxes (a stored table, as their sizes are looked at first, unless all have the same given size): keys, ord, x1 y1 z1 x2 y2 z2 (padded by the caller) and the columns left and right to carry.  A box lives on
    the level whose cells (the base cell times a power of two) are as wide as it is, so it covers at most two cells an axis there; it is met
    by smaller boxes that look it up on its level.  Of the cells that a pair shares only that of the greatest low corner counts.
    deal: how the boxes are dealt out before they are joined.
    """
    base, found = sizes(boxes) if size is None else (math.ceil(math.log2(max(size, 2.0**-40))), [])
    cell, levels = 2.0**base, sorted({max(0, e - base) for e in found}) or [0]
    extent = F.greatest(*[F.col(f"{a}2") - F.col(f"{a}1") for a in AXES], F.lit(2.0**-40))
    placed = (deal(boxes) if deal else boxes).withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(extent)).cast("int") - base))
    names = [f"c{a}" for a in AXES]

    def spread(df: DataFrame, at: Column) -> DataFrame:
        df = df.withColumn("at", at).withColumn("_size", F.lit(cell) * F.pow(F.lit(2.0), F.col("at")))
        for a, name in zip(AXES, names, strict=True):
            df = df.withColumn(f"m{name}", F.floor(F.col(f"{a}1") / F.col("_size") + 0.5).cast("long")).withColumn(name, F.explode(_cells(f"{a}1", f"{a}2", F.col("_size"))))
        return df

    carried = list(dict.fromkeys([*left, *right]))
    own = spread(placed, F.col("_level")).select(*keys, "at", *names, *[F.col(f"m{n}").alias(f"a_m{n}") for n in names], F.col("ord").alias("a_ord"), *[F.col(c).alias(f"a_{c}") for c in carried])
    up = placed.withColumn("to", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("_level"))))
    up = spread(up, F.col("to")).select(*keys, "at", *names, *[F.col(f"m{n}").alias(f"b_m{n}") for n in names], F.col("ord").alias("b_ord"), F.col("_level").alias("_b_level"), *[F.col(c).alias(f"b_{c}") for c in carried])
    met = own.join(up, [*keys, "at", *names]).where((F.col("_b_level") < F.col("at")) | (F.col("a_ord") < F.col("b_ord")))
    for n in names:
        met = met.where(F.col(n) == F.greatest(f"a_m{n}", f"b_m{n}"))
    swap = F.col("a_ord") > F.col("b_ord")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.select(*keys, *[pick(f"a_{c}", f"b_{c}").alias(f"a_{c}") for c in ["ord", *left]], *[pick(f"b_{c}", f"a_{c}").alias(f"b_{c}") for c in ["ord", *right]])


#: Boxes of one group that are compared with each other without a grid.
SMALL = 2000


def group_pairs(boxes: DataFrame, keys: list[str], left: list[str], right: list[str], where: Column | None = None, large: DataFrame | None = None) -> DataFrame:
    """Like box_pairs, for boxes in many small groups (keys), with ``where`` on the pairs.

    Groups of up to SMALL boxes are rows of their boxes, dealt out once and paired in place; larger ones go through the grid.  large: the keys of all groups that
    may have more boxes, if they can be told from less than the boxes; else the boxes are stored and counted.
    """
    if large is None:
        boxes = stored(boxes)
        large = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL).select(*keys)
    large = stored(large)
    some = not large.isEmpty()
    carried = list(dict.fromkeys(["ord", *left, *right, *(f"{a}{i}" for a in AXES for i in (1, 2))]))
    small = boxes.join(large, keys, "left_anti") if some else boxes
    group = small.groupBy(*keys).agg(F.collect_list(F.struct(*carried)).alias("_all"))
    pairs = group.select(*keys, "_all", F.explode("_all").alias("_a")).select(*keys, "_a", F.explode("_all").alias("_b"))
    overlap = F.col("_a.ord") < F.col("_b.ord")
    for a in AXES:
        overlap = overlap & (F.col(f"_a.{a}1") <= F.col(f"_b.{a}2")) & (F.col(f"_b.{a}1") <= F.col(f"_a.{a}2"))
    pairs = pairs.where(overlap).select(*keys, *[F.col(f"_a.{c}").alias(f"a_{c}") for c in ["ord", *left]], *[F.col(f"_b.{c}").alias(f"b_{c}") for c in ["ord", *right]])
    if some:
        pairs = pairs.unionByName(box_pairs(stored(boxes.join(large, keys, "left_semi")), keys, left, right))
    return pairs if where is None else pairs.where(where)

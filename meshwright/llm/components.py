"""Connected components by random contraction, as joins and aggregates over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, release, stored

#: So many edges of a graph, contracted as far as need be, are joined up in one task.
SMALL = 100_000


def joined(batches: Iterator) -> Iterator:
    """node and to (the smallest node of its component) of edges a, b."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    yield pd.DataFrame([(x, find(x)) for x in list(root)], columns=["node", "to"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node and component (its smallest node) of every node of edges (a long, b long; wa and wb, if there, are their weights).

    In each round every node moves to the neighbour (or itself) that comes first in an order of that round: in the first that
    of the weights, so that stars around heavy nodes collapse at once, then a random one,
    which removes a constant share of the nodes on average, whatever the graph's shape; hubs are joined as hot keys.  The last ``small``
    edges need no rounds, each of which is a dozen jobs whose plans and tasks the driver remembers.
    """
    weights = [c for c in ("wa", "wb") if c in edges.columns]
    first = F.col("a") < F.col("b")
    sides = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    if weights:
        sides += [F.when(first, F.col("wa")).otherwise(F.col("wb")).alias("wa"), F.when(first, F.col("wb")).otherwise(F.col("wa")).alias("wb")]
    edges = edges.where("a <> b").select(*sides)
    edges = stored(edges.groupBy("a", "b").agg(*[F.max(w).alias(w) for w in weights]) if weights else edges.distinct())
    moves: list[DataFrame] = []
    k = 0
    while (total := edges.count()) > small:
        k += 1
        rank = lambda c, w, k=k: F.struct((-F.col(w) if w in weights and k == 1 else F.lit(0)).cast("long").alias("w"), F.xxhash64(F.lit(k), c).alias("r"), F.col(c).alias("v"))
        both = edges.select(F.col("a").alias("node"), rank("b", "wb").alias("m"), rank("a", "wa").alias("own")).unionByName(edges.select(F.col("b").alias("node"), rank("a", "wa").alias("m"), rank("b", "wb").alias("own")))
        best = both.groupBy("node").agg(F.least(F.min("m"), F.min("own")).alias("m"), F.count(F.lit(1)).alias("n"))
        move = stored(best.select("node", F.col("m.v").alias("to"), "n"))
        moves.append(move)
        e = hot_join(edges.select(F.col("a").alias("node"), "b"), move, "node", "n", total, "b").select(F.col("to").alias("a"), "b")
        e = hot_join(e.withColumnRenamed("b", "node"), move, "node", "n", total, "a").select("a", F.col("to").alias("b"))
        edges, before = stored(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), edges
        release(before)
    if total:
        moves.append(stored(edges.select("a", "b").coalesce(1).mapInPandas(joined, "node long, to long")))
    if len(moves) == 1 and total:
        return moves[0].withColumnRenamed("to", "component")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = moves[-1].select("node", "to")
    for move in moves[-2::-1]:  # from the last round back: where a node of that round ended
        size = move.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        ends = stored(size.join(at.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("to", "n", F.coalesce("end", "to").alias("end")))
        total = move.count()
        at = stored(hot_join(move.select("node", "to"), ends, "to", "n", total, "node").select("node", F.col("end").alias("to")))
    least = stored(at.groupBy("to").agg(F.least(F.min("node"), F.col("to")).alias("component"), F.count(F.lit(1)).alias("n")))
    return hot_join(at, least, "to", "n", at.count(), "node").select("node", "component")

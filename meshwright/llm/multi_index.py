"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each half is quantised by k-means centroids of its own, and a pair of centroids is a cell.  A query walks the cells from the
nearest pair on with a heap (a pair's distance is the sum of its halves', the negative inner product of query and centroid), until the cells
seen hold a share of all vectors; entries of these cells are ranked by their exact inner products in double precision.

Centroids are fitted on one half of a bounded sample.  The other half, which they have not seen, sets the share: the least of SHARES at which its
vectors find ``recall`` of their true neighbours among each other, so clustered vectors visit little, and vectors without structure much.

The work is dealt out in blocks of cells (large cells in parts) by blocks of queries, so no task holds more than ROWS vectors of each, and blocks are multiplied
as matrices.  Equal vectors are one entry with its smallest ids, as no more than those can be among the nearest; equal queries are asked once.

Defined results: vectors that are null, empty or zero or hold null or non-finite components, and those without a vec_id, take no part; nor do those whose
length is not the most common one (of equally common lengths the smallest).  Rows that share a query's vec_id are not its candidates; of rows with the same id and different vectors
the one with the least vector counts.  Ties go to the smaller vec_id.  Without vectors there are no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, release, stored

#: Vectors (distinct ones) that centroids and share are fitted on, centroids of a half, and vectors of a block.
SAMPLE, CENTROIDS, ROWS = 16_384, 64, 8192
#: Shares of all vectors that a query may visit.
SHARES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)
#: Queries that are multiplied at a time.
STEP = 256


@dataclass(frozen=True)
class Index:
    """Centroids of both halves, the number of vectors in each cell, the share to visit; first block and number of parts of each cell."""

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    share: float
    first: np.ndarray
    parts: np.ndarray

    def parted(self) -> tuple:
        return self.halves, self.counts, self.share, self.first, self.parts


def centroids(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of x by k-means, started from every len(x)/k-th vector in the order of the sample."""
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def cells(x: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cell of each vector: centroid of the first half times their number, plus that of the second half."""
    cut = halves[0].shape[1]
    return nearest(x[:, :cut], halves[0]) * len(halves[1]) + nearest(x[:, cut:], halves[1])


def walk(q: np.ndarray, halves: tuple[np.ndarray, np.ndarray], counts: np.ndarray, enough: int) -> list[int]:
    """Cells with entries from the nearest pair of centroids on, until they hold enough entries."""
    cut = halves[0].shape[1]
    d = [-(halves[0] @ q[:cut]), -(halves[1] @ q[cut:])]
    order = [np.argsort(x, kind="stable") for x in d]
    d = [x[o].tolist() for x, o in zip(d, order, strict=True)]
    first, second, width = order[0].tolist(), order[1].tolist(), len(order[1])
    heap, out, seen = [(d[0][0] + d[1][0], 0, 0)], [], 0
    while heap and seen < enough:
        _, i, j = heapq.heappop(heap)
        cell = first[i] * width + second[j]
        if counts[cell]:
            out.append(cell)
            seen += counts[cell]
        # the pair below is pushed by the one on its left, the first of a row by the one above, so each is pushed once
        if j + 1 < width:
            heapq.heappush(heap, (d[0][i] + d[1][j + 1], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (d[0][i + 1] + d[1][0], i + 1, 0))
    return out


def least_share(halves: tuple[np.ndarray, np.ndarray], x: np.ndarray, k: int, recall: float, queries: int = 256) -> float:
    """The least share at which vectors of x find so much of their k nearest among x."""
    if len(x) <= k + 1:
        return 1.0
    at, some = cells(x, halves), min(queries, len(x))
    scores = x[:some] @ x.T
    scores[np.arange(some), np.arange(some)] = -np.inf
    true = at[np.argpartition(-scores, k, axis=1)[:, :k]]
    counts = np.bincount(at, minlength=len(halves[0]) * len(halves[1])).tolist()
    # how many entries a query has seen when it comes to each cell
    before = []
    for q in x[:some]:
        seen, at_cell = 0, {}
        for c in walk(q, halves, counts, len(x)):
            at_cell[c] = seen
            seen += counts[c]
        before.append(at_cell)
    need = np.array([[before[i][c] for c in row] for i, row in enumerate(true)])
    return next((s for s in SHARES if (need < s * len(x)).mean() >= recall), 1.0)


def usable(vectors: DataFrame, id_: str, column: str) -> DataFrame:
    """id, v (the vector as it is) and its identity a, b: rows that take part, one an id; stored."""
    v = vectors.select(F.col(id_).cast("long").alias("id"), F.col(column).alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(finite & F.exists("v", lambda x: x != 0.0))
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    v = v.where(F.size("v") == (common["n"] if common else 0))
    v = v.groupBy("id").agg(F.min("v").alias("v"))
    return stored(v.select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit("vector"), "v").alias("b")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def fitted(entries: DataFrame, k: int, recall: float, sample: int, width: int) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """Centroids of both halves and the share to visit, from the entries with the least hashes."""
    rows = entries.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").select("v").limit(sample).toArrow()
    x = matrix(rows.column("v"))
    seen, other = x[::2], x[1::2]
    cut, many = max(1, x.shape[1] // 2), max(1, min(width, len(seen) // 8))
    halves = centroids(seen[:, :cut], many), centroids(seen[:, cut:], many) if x.shape[1] > 1 else np.zeros((1, 0))
    return halves, least_share(halves, other, k, recall)


def blocks(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of parts of each cell: small cells share a block, large ones have several."""
    first, parts, block, held = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // rows)), 0, 0
    for c, n in enumerate(counts.tolist()):
        if held and held + n > rows:
            block, held = block + 1, 0
        first[c] = block
        if n > rows:
            block, held = block + int(parts[c]), 0
        else:
            held += n
    return first, parts


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_: str = "vec_id", column: str = "embedding", recall: float = 0.95, sample: int = SAMPLE, width: int = CENTROIDS, rows: int = ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest of every vector whose id is divisible by every, among all other ids."""
    v = usable(vectors, id_, column)
    spark, total = v.sparkSession, v.count()
    names = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], names)
    same = Window.partitionBy("a", "b").orderBy("id")
    ids = stored(v.select("id", "a", "b").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1))  # ranks are limited before the shuffle
    entries = stored(v.join(ids.where("_n = 1").select("id"), "id", "left_semi"))
    asked = v.where(F.col("id") % every == 0).select("id", "a", "b")
    twice = asked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_q"))
    q = stored(entries.join(twice, ["a", "b"]).select("id", "v", F.struct("a", "b").alias("of"), "_q"))
    halves, share = fitted(entries, k, recall, sample, width)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = cells(matrix(b.column(1)), halves) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32))], names=["id", "v", "cell"])

    kind = dict(v.dtypes)["v"]
    indexed = stored(entries.select("id", "v").mapInArrow(placed, f"id long, v {kind}, cell int"))
    held = {r.cell: r["count"] for r in indexed.groupBy("cell").count().collect()}  # at most width * width rows
    counts = np.array([held.get(c, 0) for c in range(len(halves[0]) * len(halves[1]))], np.int64)
    index = Index(halves, counts, share, *blocks(counts, rows))
    release(entries)
    found = searched(indexed, q, index, k + 1, rows)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = stored(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1))

    # an entry stands for its ids, an asked vector for its queries
    known = ids.select("a", "b", "id", "_n")
    first = known.where("_n = 1").select(F.col("id").alias("e"), "a", "b")
    full = found.withColumnRenamed("id", "e").join(first, "e").join(known.select("a", "b", "id"), ["a", "b"])
    full = full.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    lists = full.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), "id", "score"))).alias("list"))
    lists = stored(q.select(F.col("id").alias("q"), "of", "_q").join(lists, "q").select("of", "_q", "list"))
    queries = asked.select(F.col("id").alias("query_id"), F.struct("a", "b").alias("of"))
    out = hot_join(queries, lists, "of", "_q", max(1, queries.count()), "query_id").where("list is not null")
    near = F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(near).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def searched(indexed: DataFrame, q: DataFrame, index: Index, k: int, rows: int) -> DataFrame:
    """q, id and score: the k nearest entries of each query in every block of cells that it visits.

    indexed: id, v, cell.  q: id, v.  Both sides meet by block and part of the queries, in groups of about ``rows`` vectors each.
    """
    halves, counts, share, first, parts = index.parted()
    enough, every = int(np.ceil(share * counts.sum())), counts.tolist()
    slices = max(1, -(-q.count() // rows))
    last = first + parts - 1  # the last block of each cell, which rises with the cell, so a block's first cell is found in it
    kind = dict(indexed.dtypes)["v"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("q", pa.int64()), ("v", pa.list_(pa.float64())), ("block", pa.int64()), ("part", pa.int32()), ("cells", pa.binary())])
        for b in batches:
            x = matrix(b.column(1))
            for i, (qid, v) in enumerate(zip(b.column(0).to_pylist(), x, strict=True)):
                visited: dict[int, list[int]] = {}
                for c in walk(v, halves, every, enough):
                    for p in range(int(parts[c])):
                        visited.setdefault(int(first[c]) + p, []).append(c)
                out = []
                for block, its in visited.items():
                    base = int(np.searchsorted(last, block))
                    bits = np.zeros(max(its) - base + 1, np.uint8)
                    bits[np.array(its) - base] = 1
                    out.append((qid, v, block, qid % slices if slices > 1 else 0, np.packbits(bits).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t.type) for n, t in enumerate(schema)], schema=schema)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        entry, x, cell = left.column("id").to_numpy(), matrix(left.column("v")), left.column("cell").to_numpy()
        out_q, out_id, out_score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            base = int(np.searchsorted(last, left.column("block")[0].as_py()))
            names, y, bits = right.column("q").to_numpy(), matrix(right.column("v")), right.column("cells").to_pylist()
            span = int(cell.max()) - base + 1
            for at in range(0, len(names), STEP):
                some = y[at : at + STEP]
                seen = np.zeros((len(some), span), bool)
                for i, b in enumerate(bits[at : at + STEP]):
                    u = np.unpackbits(np.frombuffer(b, np.uint8))[:span]
                    seen[i, : len(u)] = u
                scores = np.where(seen[:, cell - base], some @ x.T, -np.inf)
                n = min(k, len(entry))
                # one more than needed by each side of a tie at the end: ties go to the smaller id
                top = np.lexsort((np.broadcast_to(entry, scores.shape), -scores), axis=1)[:, :n] if len(entry) <= 4 * k else best(scores, entry, n)
                i, j = np.repeat(np.arange(len(some)), n), top.ravel()
                good = np.isfinite(scores[i, j])
                i, j = i[good], j[good]
                out_q.append(names[at : at + STEP][i])
                out_id.append(entry[j])
                out_score.append(np.einsum("ij,ij->i", some[i], x[j]))
        return pa.table({"q": np.concatenate(out_q), "id": np.concatenate(out_id), "score": np.concatenate(out_score)})

    # xxhash64 of the id deals a large cell's entries to its parts
    cell = F.col("cell") + 1
    first_of, parts_of = F.lit(first.tolist()), F.lit(parts.tolist())
    deal = F.element_at(first_of, cell) + F.pmod(F.xxhash64(F.lit("part"), "id"), F.element_at(parts_of, cell))
    left = indexed.select("id", F.col("v").cast("array<double>").alias("v") if kind != "array<float>" else "v", "cell", deal.cast("long").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"))
    right = q.select("id", "v").mapInArrow(asked, "q long, v array<double>, block long, part int, cells binary")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(met, "q long, id long, score double")


def best(scores: np.ndarray, entry: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n greatest scores of each row, ties at the end by the smaller entry."""
    far = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    out = np.empty((len(scores), n), np.int64)
    for i, (row, limit) in enumerate(zip(scores, far, strict=True)):
        near = np.flatnonzero(row >= limit)
        out[i] = near[np.lexsort((entry[near], -row[near]))][:n]
    return out

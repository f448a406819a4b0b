"""Operator 10: near-duplicates by BagMinHash signatures of word-shingle multisets.

A text is the multiset of its runs of five words (lower case; shorter texts: one run of all their words).  Weights are
discretised into unit steps, grouped in octaves [0, 1), [1, 2), [2, 4), ...; each shingle and octave has its own Poisson
process whose points hit random registers, and points above the shingle's weight are thinned out.  Each register keeps
its earliest point, so two registers agree with the probability of the weighted Jaccard similarity.  Points are only made
up to the time by which all registers are filled.

Texts with the same words form a class, and one member stands for it.  Signatures are cut into bands; classes that agree in
a band share a bucket.  The centre of a bucket is the member that shares the most buckets' places with others (in a group of
copies that is the original or the copy nearest to it).  Every class is verified against the centres of its buckets (at most as many as bands,
mostly one).  Where members of a centre are in other components than it, they are then compared with all its members of different components, in blocks of
bounded size: sketches first, multisets where sketches allow.  Every pair that shares a bucket shares its centre, so no candidate pair stays
unchecked; no pair is written but those that link two components.  Verification counts the overlap of the multisets exactly, next to the centre, whose text goes once to each of
its tasks.  Pairs whose sketches (four bits a register) are ``margin`` standard deviations or more below the similarity skip it;
with ``margin=None`` none does.  A pair of that similarity is lost with a probability of 6e-5 to the bands, and 3e-7 to a margin of five.

Defined results: null, empty and wordless texts form one class; repeated rows are one class; a text of fewer than five
words is near only to texts with the same words; rows that share a doc_id share a group; of equally central members the greatest
hash of doc_id decides, and the smallest doc_id names a group; very long texts take memory in proportion to their own length; empty tables give
an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, hot_join, release, stored, texts
from .components import components

WORD = re.compile(r"\w+")
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: 64-bit integers of a sketch of four bits a register.
SKETCH = REGISTERS // 16
#: Pairs of one centre in a task, up to SALTS tasks a centre; beyond, tasks grow.
GROUP, SALTS = 256, 1024
#: Words in a block of a centre's members.
BLOCK_WORDS = 1_000_000


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of width words; of fewer words one run."""
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j]
    return np.sort(mixed(out + np.uint64(k)))


def octaves(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Processes of weighted keys: seed, rate, share of the octave that the weight covers, owner."""
    parts = []
    low, k = 0, 0
    while len(keys):
        high = 1 << k
        width = high - low
        parts.append((mixed(keys + np.uint64(k * 0xA24BAED4963EE407 % 2**64)), np.full(len(keys), float(width)), np.minimum((weights - low) / width, 1.0), owner))
        more = weights > high
        keys, weights, owner, low, k = keys[more], weights[more], owner[more], high, k + 1
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signatures(bags: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers (64-bit fingerprints of the earliest points) of sorted multisets; of an empty one zeros."""
    out = np.zeros((len(bags), m), np.uint64)
    todo = [i for i, b in enumerate(bags) if len(b)]
    extra = 6.0
    while todo:
        sizes = np.array([len(bags[i]) for i in todo])
        flat, owner = np.concatenate([bags[i] for i in todo]), np.repeat(np.arange(len(todo)), sizes)
        start = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]))
        weights = np.diff(np.append(start, len(flat))).astype(float)
        seed, rate, share, own = octaves(flat[start], weights, owner[start])
        until = m * (np.log(m) + extra) / sizes
        first = np.full(len(todo) * m, np.inf)
        t, step = np.zeros(len(seed)), 0
        while len(seed):
            step += 1
            h = mixed(seed + np.uint64(step * 0x9FB21C651E98DF25 % 2**64))
            t = t - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
            live = t < until[own]
            if not live.all():
                seed, rate, share, own, t, h = seed[live], rate[live], share[live], own[live], t[live], h[live]
            g = mixed(h + np.uint64(0x632BE59BD9B4E019))
            cell = own * m + ((g >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            part = share < 1.0
            if part.any():
                ok = ~part | ((g & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 < share)
                np.minimum.at(first, cell[ok], t[ok])
            else:
                np.minimum.at(first, cell, t)
        first = first.reshape(len(todo), m)
        full = np.isfinite(first).all(axis=1)
        rows = np.array(todo)
        out[rows[full]] = mixed(first[full].view(np.uint64))
        todo, extra = rows[~full].tolist(), extra * 2
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, n = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], k[j]).sum())
    return both / (len(a) + len(b) - both)


def packed(sig: np.ndarray) -> np.ndarray:
    """Four bits of each register, in 64-bit integers."""
    low = ((sig >> np.uint64(9)) & np.uint64(15)).astype(np.uint8)
    return (low[:, ::2] | (low[:, 1::2] << 4)).view(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, cls (digest of the words), size (number of words), bands and sketch of each document."""

    def sign(batches: Iterator) -> Iterator:
        known = Hashes()
        for pdf in batches:
            ids, rows = pdf["doc_id"].tolist(), pdf["text"].tolist()
            at = 0
            while at < len(rows):
                bags, cls, sizes, size, begin = [], [], [], 0, at
                while at < len(rows) and size < 100_000:
                    found = WORD.findall(rows[at].lower())
                    words = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
                    cls.append(xxhash.xxh3_128_digest(words.tobytes()))
                    bags.append(shingles(words, width))
                    sizes.append(len(found))
                    size += len(found) + 100
                    at += 1
                sig = signatures(bags)
                keys = np.zeros((len(bags), BANDS), np.uint64)
                for j in range(ROWS):
                    keys = mixed(keys * np.uint64(3) + sig[:, j::ROWS])
                keys += np.arange(BANDS, dtype=np.uint64)
                yield pd.DataFrame({"doc_id": ids[begin:at], "cls": cls, "size": sizes, "bands": list(keys.view(np.int64)), "sketch": list(packed(sig))})

    return texts(docs).mapInPandas(sign, "doc_id long, cls binary, size int, bands array<long>, sketch array<long>")


def most_differing(similarity: float, margin: float) -> float:
    """So many differing registers of a sketch are margin standard deviations below the similarity (two registers agree in four bits by chance in one of 16)."""
    agree = similarity + (1 - similarity) / 16
    return float(REGISTERS * (1 - agree + margin * np.sqrt(agree * (1 - agree) / REGISTERS)))


def unlike(a: str, b: str, similarity: float, margin: float) -> Column:
    """Whether sketches (columns a and b) are margin standard deviations or more below the similarity."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return sum((differing(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(SKETCH)), F.lit(0)) >= most_differing(similarity, margin)


def counted(pairs: DataFrame, key: str, table: DataFrame) -> tuple[DataFrame, int]:
    """table's rows (one a key) with n, the pairs of each key, and the number of pairs."""
    sizes = stored(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return sizes.join(table, key, "left"), total


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, similarity: float, margin: float | None) -> DataFrame:
    """The pairs (c: a centre, m: a member; each once, with their weights wa and wb; a stored table) whose multisets are at least so similar."""
    sketches = reps.select(F.col("doc_id").alias("c"), F.col("sketch").alias("sc"))
    centres, key, size, total = _by(pairs, "c", sketches)
    centres = centres.withColumn("salts", F.least(F.ceil(F.col("n") / GROUP), F.lit(SALTS)).cast("int"))
    drawn = hot_join(pairs, centres, key, size, total, "m").withColumn("g", F.pmod(F.xxhash64("m"), F.col("salts")).cast("int"))
    if margin is not None:
        drawn = drawn.join(sketches.toDF("m", "sm"), "m").where(~unlike("sc", "sm", similarity, margin))
    likely = stored(drawn.select("c", "m", "wa", "wb", "g", "salts"))
    sizes = likely.groupBy("c").agg(F.max("salts").alias("salts"))
    ends = likely.select(F.col("c").alias("id")).unionByName(likely.select(F.col("m").alias("id")))
    bodies = few(texts(docs), ends, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    # a centre comes before its members; its text goes to each of its tasks
    asked = likely.select(F.col("m").alias("doc_id"), "c", F.lit(True).alias("member"), F.array("g").alias("gs"), "wa", "wb")
    asked = asked.unionByName(sizes.select(F.col("c").alias("doc_id"), "c", F.lit(False).alias("member"), F.sequence(F.lit(0), F.col("salts") - 1).alias("gs"), F.lit(0).cast("long").alias("wa"), F.lit(0).cast("long").alias("wb")))
    sides = asked.join(bodies, "doc_id").select("c", F.explode("gs").alias("g"), "member", F.col("doc_id").alias("m"), "wa", "wb", "text")

    def tested(batches: Iterator) -> Iterator:
        known, at, bag = Hashes(), None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                found = WORD.findall(row.text.lower())
                mine = shingles(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)), width)
                if not row.member:
                    at, bag = row.c, mine
                elif at == row.c and overlap(bag, mine) >= similarity - 1e-12:
                    out.append((row.c, row.m, row.wa, row.wb))
            yield pd.DataFrame(out, columns=["c", "m", "wa", "wb"])

    out = stored(sides.repartition("c", "g").sortWithinPartitions("c", "g", "member").mapInPandas(tested, "c long, m long, wa long, wb long"))
    release(likely)
    return out


def _by(pairs: DataFrame, key: str, table: DataFrame) -> tuple[DataFrame, str, str, int]:
    """The arguments of hot_join that bring table's rows to pairs by key."""
    found, total = counted(pairs, key, table)
    return found, key, "n", total


def component_of(rows: DataFrame, found: DataFrame, node: str, name: str, salt: str) -> DataFrame:
    """rows with the component of the column node (itself, if it has no link)."""
    where = found.select(F.col("node").alias(node), F.col("component").alias(name))
    return hot_join(rows, *_by(rows, node, where), salt).drop("n").withColumn(name, F.coalesce(name, node))


class Members:
    """Members of a centre in one task: links between their components."""

    def __init__(self, similarity: float, width: int, margin: float | None):
        self.similarity, self.width, self.known = similarity, width, Hashes()
        self.most = REGISTERS + 1.0 if margin is None else most_differing(similarity, margin)

    def links(self, rows: list) -> list[tuple]:
        """(c, m, wa, wb) of pairs that link components.  rows: side, doc_id, component, weight, sketch, text; the two sides are compared, or one side with itself."""
        sketch = np.array([r.sketch for r in rows], np.int64).view(np.uint64).reshape(len(rows), SKETCH)
        part, root = np.array([r.component for r in rows], np.int64), {r.component: r.component for r in rows}
        bags: dict[int, np.ndarray] = {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def bag(i: int) -> np.ndarray:
            if i not in bags:
                found = WORD.findall(rows[i].text.lower())
                bags[i] = shingles(np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found)), self.width)
            return bags[i]

        one = np.flatnonzero([r.side == 0 for r in rows])
        two = np.flatnonzero([r.side == 1 for r in rows])
        out = []
        for k, i in enumerate(one.tolist()):
            rest = two if len(two) else one[k + 1 :]
            d = sketch[rest] ^ sketch[i]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            near = (np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1) < self.most) & (part[rest] != part[i])
            for j in rest[near].tolist():
                x, y = find(int(part[i])), find(int(part[j]))
                if x != y and overlap(bag(i), bag(j)) >= self.similarity - 1e-12:
                    root[x] = y
                    out.append((rows[i].doc_id, rows[j].doc_id, rows[i].weight, rows[j].weight))
        return out


def crossing(docs: DataFrame, reps: DataFrame, stars: DataFrame, found: DataFrame, width: int, similarity: float, margin: float | None) -> DataFrame:
    """Links (c, m, wa, wb) between members of one centre in different components, at least one of them not in the centre's own."""
    at = component_of(component_of(stars, found, "c", "own", "m"), found, "m", "component", "c")
    at = at.join(reps.select(F.col("doc_id").alias("m"), "size", "sketch"), "m")
    at = stored(at.select("c", F.col("m").alias("doc_id"), F.col("wb").alias("weight"), "component", (F.col("component") != F.col("own")).alias("apart"), "size", "sketch"))
    words = lambda mine: F.coalesce(F.sum(F.when(mine, F.col("size") + 100)), F.lit(0))
    blocks = lambda mine: F.ceil(words(mine) / BLOCK_WORDS).cast("int")
    split = at.groupBy("c").agg(blocks(F.col("apart")).alias("nr"), blocks(~F.col("apart")).alias("nm"), F.count(F.lit(1)).alias("n"))
    split = stored(split.where("nr > 0 and n > 1"))
    rows = hot_join(at, split, "c", "n", at.count(), "doc_id").where("n is not null")
    b = F.pmod(F.xxhash64("doc_id"), F.when(F.col("apart"), F.col("nr")).otherwise(F.col("nm"))).cast("int")
    rows = rows.withColumn("b", b)
    place = lambda own, i, j, side: F.struct(F.lit(own).alias("own"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<own:boolean,i:int,j:int,side:int>>")
    each = lambda n, put: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), put)).otherwise(none)
    apart = F.concat(
        F.transform(F.sequence("b", F.col("nr") - 1), lambda j: place(False, F.col("b"), j, 0)),
        each(F.col("b"), lambda i: place(False, i, F.col("b"), 1)),
        each(F.col("nm"), lambda j: place(True, F.col("b"), j, 0)),
    )
    rows = rows.withColumn("places", F.when(F.col("apart"), apart).otherwise(each(F.col("nr"), lambda i: place(True, i, F.col("b"), 1))))
    held = rows = stored(rows.select("c", "doc_id", "component", "weight", "sketch", "places"))
    release(at, split)
    bodies = few(texts(docs), rows.select(F.col("doc_id").alias("id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = rows.join(bodies, "doc_id").select("c", F.explode("places").alias("p"), "doc_id", "component", "weight", "sketch", "text")
    rows = rows.select("c", "p.own", "p.i", "p.j", "p.side", "doc_id", "component", "weight", "sketch", "text")

    def compared(batches: Iterator) -> Iterator:
        members, group, key, out = Members(similarity, width, margin), [], None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if (row.c, row.own, row.i, row.j) != key:
                    out += members.links(group) if len(group) > 1 else []
                    group, key = [], (row.c, row.own, row.i, row.j)
                group.append(row)
            yield pd.DataFrame(out, columns=["c", "m", "wa", "wb"])
            out = []
        yield pd.DataFrame(members.links(group) if len(group) > 1 else [], columns=["c", "m", "wa", "wb"])

    keys = ["c", "own", "i", "j"]
    out = stored(rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compared, "c long, m long, wa long, wb long"))
    release(held)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, margin: float | None = 5.0) -> DataFrame:
    """Per document: doc_id, class_id (its class's smallest doc_id), near_id (its group's), near_size (documents of the group), kept."""
    rows = stored(signed(docs, width))
    total = rows.count()
    classes = stored(rows.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    members = stored(hot_join(rows.select("doc_id", "cls"), classes, "cls", "n", total, "doc_id").select("doc_id", "rep"))
    reps = stored(rows.join(classes.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"], "left_semi").select("doc_id", "size", "bands", "sketch"))
    each = reps.select("doc_id", F.explode("bands").alias("k"))
    buckets = stored(each.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = stored(hot_join(each, buckets, "k", "n", total * BANDS, "doc_id").where("n > 1"))
    places = shared.count()
    placed = stored(shared.withColumn("weight", F.sum("n").over(Window.partitionBy("doc_id"))))  # at most one row a band
    release(rows, classes, buckets, shared)
    top = F.max(F.struct("weight", F.xxhash64("doc_id").alias("r"), F.col("doc_id").alias("v")))
    centres = stored(placed.groupBy("k").agg(top.alias("top"), F.count(F.lit(1)).alias("n")))
    centred = hot_join(placed.drop("n"), centres, "k", "n", places, "doc_id")
    stars = centred.where("doc_id <> top.v").select(F.col("top.v").alias("c"), F.col("doc_id").alias("m"), F.col("top.weight").alias("wa"), F.col("weight").alias("wb"))
    stars = stored(stars.distinct())
    release(placed, centres)
    links = verified(docs, reps, stars, width, similarity, margin)
    found = stored(components(links.withColumnsRenamed({"c": "a", "m": "b"})))
    more = crossing(docs, reps, stars, found, width, similarity, margin)
    release(stars, reps)
    if not more.isEmpty():
        release(found)
        found = stored(components(links.unionByName(more).withColumnsRenamed({"c": "a", "m": "b"})))
    release(links, more)
    groups = members.withColumnRenamed("rep", "node").groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(found, "node", "left").withColumn("near_id", F.coalesce("component", "node"))
    groups = stored(groups)
    sizes = stored(groups.groupBy("near_id").agg(F.sum("n").alias("near_size"), F.count(F.lit(1)).alias("classes")))
    release(found)
    parts, groups = groups, stored(hot_join(groups, sizes, "near_id", "classes", total, "node").select(F.col("node").alias("rep"), "n", "near_id", "near_size"))
    release(parts, sizes)
    out = hot_join(members, groups, "rep", "n", total, "doc_id")
    return out.select("doc_id", F.col("rep").alias("class_id"), "near_id", "near_size", (F.col("doc_id") == F.col("near_id")).alias("kept"))

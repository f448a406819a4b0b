"""Operator 9: repeated byte strings by bucket refinement of sampled suffixes.

Every string of ``length`` bytes holds an anchor: the leftmost position whose q-gram hash is least.  Equal strings have their
anchor at the same place, so only suffixes at anchors are put into buckets (about one in eighty).  Initial buckets are the anchors'
q-grams; buckets of one suffix are done.  In the next step an anchor's bucket is that of all bytes of the strings around it: where a whole bucket,
or a class of it, agrees, all its strings repeat.  Buckets with several classes are refined in rounds, with one representative of each class.  A round
looks at stretches of starts at the same offsets from the anchor, first of 64 starts, then of a quarter each time.  All strings of a stretch share its core; suffixes are
put into the buckets of their cores, and those that are alone there have no repeat in that stretch and leave.  Suffixes that agree on all bytes
of the stretch (by a digest of 256 bits) repeat with all its strings.  The others go on to the next round, whose cores are longer, so its buckets refine those before.  No string is
written for each start, and a round's tables are deleted when the next one has its own.

Identifiers are digests, so they name the same bucket everywhere and nothing has to be ranked by a sort over all suffixes.  Every join back goes by
counts: hot identifiers are joined by broadcast, no group meets in one task, and no pairs are formed.

Defined results: null text is empty; texts shorter than ``length`` bytes lose nothing; repeated rows are occurrences of
their strings like any others, so long ones lose all; so are rows without a doc_id, which stay without one; overlapping occurrences in one document count; a very long text is
hashed whole by one task, in memory of some 60 times its bytes; empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, hot_join, keyed, release, stored, texts

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Sampler:
    """Anchors of byte strings."""

    def __init__(self, length: int, q: int):
        self.length, self.q, self.size = length, q, 0

    def grams(self, raw: np.ndarray) -> np.ndarray:
        """64-bit hashes of all q-grams."""
        n = len(raw)
        if n > self.size:
            self.size = max(1 << 16, 2 * n)
            self.up, self.down = powers(BASE, self.size + 1), powers(INVERSE, self.size + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        h = (sums[self.q :] - sums[: n + 1 - self.q]) * self.up[: n + 1 - self.q]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def anchors(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last start of the strings of each anchor, the anchor's place after the last start, and its q-gram hash."""
        g = self.grams(np.frombuffer(data, np.uint8))
        low = (g >> np.uint64(32)).astype(np.uint32)
        w = self.length - self.q + 1
        at = least_places(low, w)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        return first, last, at[first] - last, g[at[first]]


def least_places(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least of each w neighbours: least prefixes and suffixes of blocks of w, as value and place in one integer."""
    n = len(x)
    key = (x.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def name_of(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def sampled(docs: DataFrame, length: int, q: int) -> DataFrame:
    """doc_id, v (its text's name) and arrays lo, hi, ahead, g, c of each document that has strings of that length."""

    def made(batches: Iterator) -> Iterator:
        sampler, top = Sampler(length, q), 1 << 63
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = bytes_of(text)
                if len(data) >= length:
                    lo, hi, ahead, g = sampler.anchors(data)
                    view = memoryview(data)
                    c = [xxhash.xxh3_64_intdigest(view[a:b]) - top for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
                    out.append((doc, name_of(data), lo.astype(np.int32), hi.astype(np.int32), ahead.astype(np.int16), g.view(np.int64), c))
            yield pd.DataFrame(out, columns=["doc_id", "v", "lo", "hi", "ahead", "g", "c"])

    return texts(docs).mapInPandas(made, "doc_id long, v long, lo array<int>, hi array<int>, ahead array<short>, g array<long>, c array<long>")


def repeated(docs: DataFrame, length: int = 200, q: int = 48) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, v, lo, hi: ranges of starts whose strings of that length also start elsewhere; and the stored tables that this reads."""
    rows = stored(sampled(docs, length, q))
    each = rows.select("doc_id", "v", F.inline(F.arrays_zip("lo", "hi", "ahead", "g", "c")))
    total = rows.agg(F.coalesce(F.sum(F.size("g")), F.lit(0))).first()[0]
    buckets = stored(each.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("mixed")).where("n > 1"))
    near = stored(hot_join(each, buckets, "g", "n", total, "doc_id").where("n > 1").drop("n"))
    del each
    release(rows, buckets)
    mixed = near.where("mixed").withColumn("k", F.struct(F.col("g").alias("a"), F.col("c").alias("b")))
    classes = stored(mixed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "v", "lo", "hi", "ahead")).alias("rep")))
    known = hot_join(mixed.select("doc_id", "v", "lo", "hi", "k"), classes.where("n > 1").select("k", "n"), "k", "n", mixed.count(), "doc_id").where("n > 1")
    whole = stored(near.where("not mixed").select("doc_id", "v", "lo", "hi").unionByName(known.select("doc_id", "v", "lo", "hi")))
    reps = bodies(docs, classes, length)
    del mixed, known
    release(near, classes)
    parts = refined(reps, length, q)
    release(reps)
    return reduce(DataFrame.unionByName, [whole, *parts]), [whole, *parts]


def bodies(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """doc_id, v, lo, hi, ahead, done (others have the same strings) and bytes (of all strings) of each class's representative."""
    asked = classes.groupBy("rep.doc_id", "rep.v").agg(F.collect_list(F.struct("rep.lo", "rep.hi", "rep.ahead", (F.col("n") > 1).alias("done"))).alias("ranges"))
    asked = stored(asked)
    found = few(texts(docs), asked.select(F.col("doc_id").alias("id")), "doc_id").join(asked, "doc_id")
    names = ["doc_id", "v", "lo", "hi", "ahead", "done", "bytes"]

    def cut_out(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for doc, v, text, ranges in zip(pdf["doc_id"], pdf["v"], pdf["text"], pdf["ranges"], strict=True):
                data = bytes_of(text)
                if name_of(data) == v:
                    out += [(doc, v, r["lo"], r["hi"], r["ahead"], r["done"], data[r["lo"] : r["hi"] + length]) for r in ranges]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    # rows that repeat a representative's doc_id and text give the same bytes again: once is enough; other texts of that doc_id fail by name
    rows = found.mapInPandas(cut_out, "doc_id long, v long, lo int, hi int, ahead short, done boolean, bytes binary")
    return stored(rows.dropDuplicates(["doc_id", "v", "lo"]))


def refined(reps: DataFrame, length: int, q: int) -> list[DataFrame]:
    """doc_id, v, lo, hi: stored tables of ranges of the representatives' starts (of classes that are not done) whose strings another representative has too."""
    last = length - q
    size = 1
    while size * 8 <= length:
        size *= 4
    # offsets of starts count from last bytes before the anchor, which is hi + ahead
    first = F.col("lo") - F.col("hi") - F.col("ahead") + last
    cur = reps.select("doc_id", "v", "lo", "done", "bytes", first.alias("i"), (F.lit(last) - F.col("ahead")).alias("j"))
    cur = cur.withColumn("s", F.explode(F.array(*[F.lit(x) for x in range(0, last + 1, size)])))
    out, before = [], None
    while True:
        cur = cur.withColumn("e", F.least(F.col("s") + size - 1, F.lit(last))).where("e >= i and s <= j")
        core = F.substring(F.col("bytes"), F.col("e") - F.col("i") + 1, F.col("s") + length - F.col("e"))
        cur = cur.withColumn("k", F.xxhash64("s", core))
        found = stored(cur.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("done")).alias("open")).where("n > 1"))
        total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        left = stored(hot_join(cur, found.where("open > 0"), "k", "n", total, "lo").where("n > 1").drop("k", "n", "open"))
        release(found, *([before] if before is not None else []))
        full = (F.col("i") <= F.col("s")) & (F.col("e") <= F.col("j"))
        hull = F.substring(F.col("bytes"), F.col("s") - F.col("i") + 1, F.col("e") - F.col("s") + length)
        # digests of 256 bits stand for the bytes
        whole = left.where(full).withColumn("hull", F.unhex(F.sha2(hull, 256)))
        twice = stored(whole.groupBy("hull").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        whole = hot_join(whole, twice, "hull", "n", left.count(), "lo").withColumn("hit", F.col("n").isNotNull()).drop("hull", "n")
        before = stored(whole.unionByName(left.where(~full).withColumn("hit", F.lit(False))))
        release(left, twice)
        at = F.col("lo") - F.col("i")
        out.append(stored(before.where("hit and not done").select("doc_id", "v", (at + F.col("s")).alias("lo"), (at + F.col("e")).alias("hi"))))
        if size == 1:
            release(before)
            return out
        size //= 4
        cur = before.select("doc_id", "v", "lo", (F.col("done") | F.col("hit")).alias("done"), "bytes", "i", "j", F.explode(F.sequence(F.col("s"), F.col("e"), F.lit(size))).alias("s"))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, _given boolean"


def cut(data: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What stays of data, bytes removed and maximal removed runs."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    a, b = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    keep = np.concatenate([[0], b]), np.append(a, len(data))
    return b"".join(data[i:j] for i, j in zip(keep[0].tolist(), keep[1].tolist(), strict=True)), int((b - a).sum()), len(a)


def deduplicated(docs: DataFrame, length: int = 200, q: int = 48) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    docs = keyed(docs)
    found, read = repeated(docs, length, q)
    ranges = stored(found.groupBy("doc_id", "v").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")))
    del found
    release(*read)
    ids = ranges.select(F.col("doc_id").alias("id"))
    rows = texts(docs, "_given")

    def plain(batches: Iterator) -> Iterator:
        for pdf in batches:
            raw = [bytes_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(x) for x in raw], "n_removed": 0, "n_spans": 0, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in raw], "kept": raw, "_given": pdf["_given"]})

    def less(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for doc, text, spans, given in zip(pdf["doc_id"], pdf["text"], pdf["spans"], pdf["_given"], strict=True):
                data = bytes_of(text)
                mine = next((s for s in spans if s["v"] == name_of(data)), None)
                kept, n, k = cut(data, np.asarray(mine["lo"], np.int64), np.asarray(mine["hi"], np.int64), length) if mine else (data, 0, 0)
                out.append((doc, len(data), n, k, hashlib.sha256(kept).hexdigest(), kept, given))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPORT.split(", ")])

    spans = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("v", "lo", "hi")).alias("spans"))
    hit = few(rows, ids, "doc_id").join(spans, "doc_id")
    out = few(rows, ids, "doc_id", keep=False).mapInPandas(plain, REPORT).unionByName(hit.mapInPandas(less, REPORT))
    return out.withColumn("doc_id", F.when(F.col("_given"), F.col("doc_id"))).drop("_given")

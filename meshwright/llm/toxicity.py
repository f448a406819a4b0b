"""Operator 2: toxicity by the nearest labelled examples.

Texts become TF-IDF vectors over all words of the labelled examples, (1 + ln tf) (1 + ln(N / df)), with df over all documents.  A
word's idf is multiplied by its relevance, 1 + G (1 - q)**6, with G the likelihood ratio of its counts between the two labels and q the share of
false discoveries among the words with such a ratio: words that tell nothing keep their plain weight, and none is left out.  The examples form an inverted index
whose blocks of examples keep each word's largest weight; a block is read only if the sum of its largest weights can
reach the k-th best cosine found, so the k nearest examples are exact.  Their votes, weighted by distance, are calibrated by
isotonic regression on votes that leave each example out.  The nearest examples come with the score as evidence.

Bounds: the examples are at most ``per_class`` labelled rows of each label (those with the least
hash of their doc_id); the vocabulary is all their words.
Document frequencies are those of all documents, and every whole text is scored.

Defined results: texts without any known word, null and empty ones too, get the share of toxic rows among examples
without words; where there are none, the share of toxic rows but below the threshold.  The less the votes tell the labels apart (their rank sum against what chance reaches
once in a thousand), the more scores lean to the share of toxic rows, or half the threshold if that is less, so that little is predicted from labels that tell little; without labelled rows every score is 0; of repeated labels of a document the largest counts; rows of
documents that repeat are scored one by one and alike; labels without a document, or without a value, are ignored; equally near examples come in the index's order (most
frequent word, leading word, doc_id); an empty table gives an empty result; very long texts cost time in proportion to their length and memory in
proportion to their different words; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, opened, stored, texts

WORD = re.compile(r"[^\W\d_]{2,}")
BLOCK = 32
#: Calibrated levels are shrunk to the mean by so many examples.
SHRINK = 5.0
#: How sharply doubt about a word's discovery lowers its relevance.
POWER = 6


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def examples_of(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, toxic and weight (labelled rows that it stands for) of the bounded sample of labelled rows."""
    seen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    seen = seen.where(~held_out(F.col("doc_id")))
    parts = [seen.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    share = seen.groupBy("toxic").agg((F.greatest(F.count(F.lit(1)), F.lit(per_class)) / F.lit(float(per_class))).alias("weight"))
    ids = parts[0].unionByName(parts[1]).join(F.broadcast(share), "toxic")
    return texts(docs).join(F.broadcast(ids), "doc_id")  # at most 2 * per_class ids


def vocabulary(examples: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of the examples, those of the most examples first, and in how many other and toxic ones each is."""

    def counted(batches: Iterator) -> Iterator:
        for pdf in batches:
            n = [Counter(), Counter()]
            for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
                n[int(y)].update(set(WORD.findall(text.lower())))
            yield pd.DataFrame([(w, n[0][w], n[1][w]) for w in n[0].keys() | n[1].keys()], columns=["term", "n0", "n1"])

    t = examples.select("text", "toxic").mapInPandas(counted, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("a0"), F.sum("n1").alias("a1"))
    rows = t.orderBy(F.desc(F.col("a0") + F.col("a1")), "term").collect()  # the words of a bounded sample
    return [r.term for r in rows], np.array([r.a0 for r in rows], float), np.array([r.a1 for r in rows], float)


def relevance(a0: np.ndarray, a1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """1 + G (1 - q)**6 of words in a0 of n0 other and a1 of n1 toxic examples."""
    n, d = max(n0 + n1, 1), a0 + a1

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)

    ratio = np.maximum(0.0, 2 * (part(a1, d * n1 / n) + part(a0, d * n0 / n) + part(n1 - a1, (n - d) * n1 / n) + part(n0 - a0, (n - d) * n0 / n)))
    order = np.argsort(-ratio, kind="stable")
    tail = np.array([math.erfc(math.sqrt(g / 2)) for g in ratio[order].tolist()])
    false = np.minimum(1.0, len(d) * tail / np.searchsorted(-ratio[order], -ratio[order], "right"))
    out = np.empty(len(d))
    out[order] = 1.0 + ratio[order] * (1.0 - np.minimum.accumulate(false[::-1])[::-1]) ** POWER
    return out


def confidence(votes: np.ndarray, labels: np.ndarray) -> float:
    """How far the votes are to be believed, from 0 to 1: it rises with the rank sum by which toxic examples' votes exceed the others', up to what chance reaches once in a thousand."""
    a, b = np.sort(votes[labels == 0]), votes[labels == 1]
    if not len(a) or not len(b):
        return 0.0
    wins = (np.searchsorted(a, b, "left") + np.searchsorted(a, b, "right")).sum() / 2
    z = (wins - len(a) * len(b) / 2) / np.sqrt(len(a) * len(b) * (len(a) + len(b) + 1) / 12)
    return float(min(1.0, max(0.0, z / 3.1)) ** 4)


def vectors(rows: DataFrame, terms: list[str], keep: str) -> DataFrame:
    """rows' columns keep with the ids and counts of the known words in each text."""
    held = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})  # the words of a bounded sample

    def made(batches: Iterator) -> Iterator:
        known = held.value.get
        for pdf in batches:
            ids, counts = [], []
            for text in pdf["text"]:
                found = Counter(map(known, WORD.findall(text.lower())))
                found.pop(None, None)
                ids.append(np.fromiter(found.keys(), np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int32, len(found)))
            yield pdf.drop(columns="text").assign(ids=ids, counts=counts)

    return rows.mapInPandas(made, f"{keep}, ids array<int>, counts array<int>")


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class BlockMax:
    """Unit vectors of examples in an inverted index with the largest weight of each word and block."""

    def __init__(self, rows: list[tuple[int, int, int, np.ndarray, np.ndarray]], n_terms: int):
        """rows: doc_id, label, most frequent word, word ids, weights (of length 1)."""
        # texts of one language, then of one leading word, side by side
        rows = sorted(rows, key=lambda r: (r[2], int(r[3][np.argmax(r[4])]), r[0]))
        self.docs = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.float64)
        sizes = [len(r[3]) for r in rows]
        term = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0)
        doc = np.repeat(np.arange(len(rows)), sizes)
        order = np.lexsort((doc, term))
        term, self.doc, self.weight = term[order].astype(np.int64), doc[order], weight[order]
        self.blocks = max(1, -(-len(rows) // BLOCK))
        cell = term * self.blocks + self.doc // BLOCK
        cells, self.starts = np.unique(cell, return_index=True)
        self.lengths = np.diff(np.append(self.starts, len(cell)))
        self.tops = np.maximum.reduceat(self.weight, self.starts) if len(cell) else np.zeros(0)
        self.block = cells % self.blocks
        self.first = np.searchsorted(cells, np.arange(n_terms + 1) * self.blocks)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (ties: the earlier place), best first."""
        each = self.first[ids + 1] - self.first[ids]
        cells = runs(self.first[ids], each)
        q, block = np.repeat(weights, each), self.block[cells]
        bound = np.bincount(block, q * self.tops[cells], self.blocks)
        at, best, todo = np.zeros(0, np.int64), np.zeros(0), bound > 0
        while todo.any():
            # the most promising blocks first; then all that can still reach the k-th best
            these = todo if len(best) >= k else todo & (bound >= np.partition(bound[todo], -min(4, todo.sum()))[-min(4, todo.sum())])
            mine = these[block]
            c, lengths = cells[mine], self.lengths[cells[mine]]
            post = runs(self.starts[c], lengths)
            score = np.bincount(self.doc[post], self.weight[post] * np.repeat(q[mine], lengths), len(self.docs))
            docs = np.flatnonzero(score)
            if but is not None:
                docs = docs[docs != but]
            at, best = np.concatenate([at, docs]), np.concatenate([best, np.minimum(score[docs], 1.0)])
            if len(best) > k:
                top = np.lexsort((at, -best.round(9)))[:k]
                at, best = at[top], best[top]
            todo &= ~these
            if len(best) >= k:
                todo &= bound >= best[-1] - 1e-9
        top = np.lexsort((at, -best.round(9)))
        return at[top], best[top]

    def vote(self, ids: np.ndarray, weights: np.ndarray, k: int, prior: float, but: int | None = None) -> tuple[float, list[int]]:
        at, sim = self.nearest(ids, weights, k, but)
        w = 1.0 / (1.05 - sim)
        return float((w @ self.labels[at] + prior) / (w.sum() + 1.0)), self.docs[at[:3]].tolist()


def weighted(ids: list, counts: list, importance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(ids, np.int64)
    w = (1.0 + np.log(np.asarray(counts, float))) * importance[ids]
    return ids, w / max(float(np.sqrt(w @ w)), 1e-12)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted least-squares non-decreasing fit, each level shrunk to the mean as by SHRINK further examples."""
    mean, unit = float(w @ y / w.sum()), float(w.mean())
    blocks: list[list[float]] = []
    for a, b, c in sorted(zip(x.tolist(), y.tolist(), w.tolist(), strict=True)):
        if blocks and blocks[-1][3] == a:
            blocks[-1][1] += b * c
            blocks[-1][2] += c
        else:
            blocks.append([a, b * c, c, a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], blocks[-1][1] + last[1], blocks[-1][2] + last[2], last[3]]
    knots = [(p, (s + SHRINK * unit * mean) / (n + SHRINK * unit)) for lo, s, n, hi in blocks for p in ((lo,) if lo == hi else (lo, hi))]
    return np.array([p for p, _ in knots]), np.maximum.accumulate([v for _, v in knots])


def score(docs: DataFrame, labels: DataFrame, per_class: int = 1000, k: int = 16, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (the score reaches the threshold), evidence (doc_ids of its nearest examples)."""
    examples = stored(examples_of(docs, labels, per_class))
    terms, a0, a1 = vocabulary(examples)
    found = stored(vectors(texts(docs), terms, "doc_id long"))
    n = found.count()
    df = np.ones(max(len(terms), 1))
    for i, c in found.select(F.explode("ids").alias("i")).groupBy("i").count().collect():  # a row for each word of a bounded sample
        df[i] = c
    rows = vectors(examples.select("doc_id", "toxic", "weight", "text"), terms, "doc_id long, toxic int, weight double").collect()  # at most 2 * per_class rows
    importance = np.log((n + 1.0) / df) + 1.0
    if terms:
        importance = importance * relevance(a0, a1, sum(not r.toxic for r in rows), sum(r.toxic for r in rows))
    bare = [r for r in rows if not r.ids]
    share = sum(r.toxic * r.weight for r in rows) / sum(r.weight for r in rows) if rows else 0.0
    untold = min(share, 0.99 * threshold)
    base = sum(r.toxic * r.weight for r in bare) / sum(r.weight for r in bare) if bare else untold
    often = lambda r: min(zip(r.counts, r.ids, strict=True), key=lambda x: (-x[0], x[1]))[1]
    index = BlockMax([(r.doc_id, r.toxic, often(r), *weighted(r.ids, r.counts, importance)) for r in rows if r.ids], len(terms))
    prior = float(index.labels.mean()) if len(index.labels) else base
    place = {d: i for i, d in enumerate(index.docs.tolist())}
    left_out = [(index.vote(*weighted(r.ids, r.counts, importance), k, prior, place[r.doc_id])[0], r.toxic, r.weight) for r in rows if r.ids]
    votes = [np.array(x, float) for x in zip(*left_out, strict=True)]
    knots = isotonic(*votes) if votes else (np.zeros(1), np.full(1, untold))
    lean, told = min(share, threshold / 2), confidence(*votes[:2]) if votes else 0.0
    knots = knots[0], lean + told * (np.asarray(knots[1]) - lean)
    held = carried(docs.sparkSession, (index, importance, knots, base, prior))  # bounded by per_class

    def scored(batches: Iterator) -> Iterator:
        index, importance, (x, y), base, prior = opened(held)
        for pdf in batches:
            scores, evidence = [], []
            for ids, counts in zip(pdf["ids"], pdf["counts"], strict=True):
                vote, near = index.vote(*weighted(ids, counts, importance), k, prior) if len(ids) else (None, [])
                scores.append(base if vote is None else float(np.interp(vote, x, y)))
                evidence.append(near)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.clip(scores, 0.0, 1.0), "evidence": evidence})

    out = found.mapInPandas(scored, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")

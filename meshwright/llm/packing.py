"""Operator 1: packing documents into sequences by non-negative least squares over length patterns.

Tokens of a document are cut into pieces of at most ``capacity`` tokens.  The histogram of piece lengths (at most
``capacity`` bins, so its size does not depend on the input) goes to the driver; there, patterns of at most
three documents over coarse length bins are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left is packed by best fit over counts.  The resulting plan
(rank ranges of each length -> sequences) is joined back to the pieces.

Defined results: null text is an empty text (one token, the end id); empty tables give an empty result; equal rows
are packed one by one; ties are settled by doc_id and piece; a text of any length is tokenized whole by
one task, in memory in proportion to it; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker remembers; when full, it starts again.
WORDS_KEPT = 400_000


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers, remembered per white-space-free chunk.

    The tokenizer drops white space and lower-cases, and its pre-tokens never cross white space, so a text's ids are
    those of its chunks in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > WORDS_KEPT:
            self.known.clear()
        enc = self.tok.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        at = np.searchsorted(ends, np.array([o[0] for o in enc.offsets], np.int64), side="right")
        cuts = np.searchsorted(at, np.arange(len(words) + 1)) * 4
        raw = np.array(enc.ids, "<u4").tobytes()
        self.known.update((w, raw[a:b]) for w, a, b in zip(words, cuts.tolist(), cuts[1:].tolist(), strict=False))

    def ids(self, text: str) -> bytes:
        # whole: special tokens, controls that are space in Python only, letters whose lower case depends on neighbours
        if "<|" in text or (not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f")) or (not text.isascii() and ("Σ" in text or "İ" in text)):
            return self.whole(text)
        text = text.lower() if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text).lower()
        chunks = self.chunks(text)
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            new = [w for w in set(chunks) if w not in self.known]
            if len(self.known) + len(new) > WORDS_KEPT:
                new = list(set(chunks))
            self.learn(new)
            return b"".join(map(self.known.__getitem__, chunks))

    def chunks(self, text: str) -> list[str]:
        """The pre-tokens of a plain lower-case text; the white-space-free chunks of any other."""
        if plain(text):
            return PRE.findall(text)
        out = []
        for x in text.split():
            if ODD.search(x):
                y = x.rstrip(".,;:!?")
                out += [y, x[len(y) :]] if y != x and y[-1:].isalpha() else [x]
            else:
                out += PRE.findall(x)
        return out


def plain(text: str) -> bool:
    """Whether PRE finds the pre-tokens; quick for ASCII and Latin-1 texts."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not ODD.search(text)
    return b"'" not in raw and (raw.isascii() or not any(c in raw for c in (b"\xb2", b"\xb3", b"\xb9", b"\xbc", b"\xbd", b"\xbe")))


#: In the Latin and punctuation blocks, without the numbers that aren't digits and without apostrophes (contractions), PRE finds the pre-tokens.
ODD = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]|['\xb2\xb3\xb9\xbc-\xbe]")
PRE = re.compile(r"[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of each document: place, length and CRC of its ids."""

    def cut(batches: Iterator) -> Iterator:
        import os

        import pandas as pd

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import builtins

        held = builtins.__dict__.setdefault("_word_tokenizers", {})  # lives as long as the worker does
        if tokenizer not in held:
            held[tokenizer] = WordTokenizer(tokenizer)
        tok, end = held[tokenizer], np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            out = []
            rows, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for doc, text in zip(ids, rows, strict=True):
                raw = tok.ids(text) + end
                n = len(raw) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = raw[4 * at : 4 * (at + capacity)]
                    out.append((doc, k, at, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInPandas(cut, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares by an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[on] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * max(1.0, float(b.max(initial=0))):
            break
        on[j] = True
        while True:
            idx = np.flatnonzero(on)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[idx] = s
                break
            bad = s <= 0
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - s[bad], 1e-12))
            x[idx] += step * (s - x[idx])
            off = idx[x[idx] <= 1e-9]
            x[off] = 0
            on[off] = False
            if not len(off) or not on.any():
                break
    return x


def plan(hist: dict[int, int], capacity: int, bins: int = 64) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, sequence of the first, offset): the piece of that length with rank r lies in sequence ``sequence + r - first``.

    hist: pieces of each length from 1 to capacity.  The plan's size depends on capacity and bins alone.
    """
    width = -(-capacity // bins)
    left = dict(sorted(hist.items()))
    taken = dict.fromkeys(left, 0)
    groups: list[list] = []  # [count, [(length, first rank)], space]

    def take(length: int, n: int) -> tuple[int, int]:
        at = taken[length]
        taken[length] += n
        left[length] -= n
        return length, at

    if left.get(capacity):
        n = left[capacity]
        groups.append([n, [take(capacity, n)], 0])
    top = capacity // width
    patterns = [(a, top - a) for a in range(1, top // 2 + 1)] + [(a, b, top - a - b) for a in range(1, top // 3 + 1) for b in range(a, (top - a) // 2 + 1)]
    by_bin: dict[int, list[int]] = {}
    for length in left:
        by_bin.setdefault(-(-length // width), []).append(length)
    b = np.array([sum(left[x] for x in by_bin.get(k, ())) for k in range(1, top + 1)], float)
    a = np.zeros((top, len(patterns)))
    for j, p in enumerate(patterns):
        for k in p:
            a[k - 1, j] += 1
    fit = np.floor(nnls(a, b, 3 * top) + 1e-9).astype(int)
    lengths = sorted(left)
    for j in sorted(range(len(patterns)), key=lambda j: -max(patterns[j])):  # the longest pieces choose first
        p = patterns[j]
        n = int(fit[j])
        while n > 0:
            slots: list[int] = []
            for k in p[:0:-1]:  # the longest left of each longer bin; the last place takes the longest that fits
                x = max((x for x in by_bin.get(k, ()) if left[x] > slots.count(x)), default=None)
                if x is None:
                    break
                slots.append(x)
            if len(slots) < len(p) - 1:
                break
            space = capacity - sum(slots)
            i = bisect.bisect_right(lengths, space) - 1
            while i >= 0 and left[lengths[i]] <= slots.count(lengths[i]):
                if not left[lengths[i]]:
                    del lengths[i]
                i -= 1
            if i < 0:
                break
            slots.append(lengths[i])
            m = min(n, *(left[x] // slots.count(x) for x in set(slots)))
            groups.append([m, [take(x, m) for x in slots], capacity - sum(slots)])
            n -= m
    spaces: dict[int, list[list]] = {}
    for g in groups:
        if g[2]:
            spaces.setdefault(g[2], []).append(g)
    order = sorted(spaces)
    for length in sorted(left, reverse=True):  # what is left: best fit, longest first, over counts
        while left[length]:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                per = 1 if 2 * length > capacity else min(capacity // length, left[length])
                m = left[length] // per
                g = [m, [take(length, m) for _ in range(per)], capacity - per * length]
                groups.append(g)
            else:
                space = order[i]
                old = spaces[space].pop()
                if not spaces[space]:
                    del spaces[space], order[i]
                m = min(old[0], left[length])
                if m < old[0]:  # the rest of that group keeps its space
                    rest = [old[0] - m, [(x, at + m) for x, at in old[1]], space]
                    groups.append(rest)
                    old[0] = m
                    if space not in spaces:
                        bisect.insort(order, space)
                    spaces.setdefault(space, []).append(rest)
                old[1].append(take(length, m))
                old[2] = space - length
                g = old
            if g[2]:
                if g[2] not in spaces:
                    bisect.insort(order, g[2])
                spaces.setdefault(g[2], []).append(g)
    rows, at = [], 0
    for n, slots, _ in groups:
        offset = 0
        for length, first in slots:
            rows.append((length, first, first + n, at, offset))
            offset += length
        at += n
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of docs with their sequence_id and offset; see the module."""
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, tokenizer, capacity, end_id))
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    n = sum(hist.values())
    salts = max(1, min(n // 50_000 + 1, 100_000))
    rows = plan(hist, capacity)
    where = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, first long, stop long, sequence long, offset long")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    hit = ranked.join(F.broadcast(where), "length").where("_rank >= first and _rank < stop")  # the plan is bounded by capacity
    return hit.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset")

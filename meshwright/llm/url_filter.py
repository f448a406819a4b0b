"""Operator 6: URL rules in a sorted, memory-mapped array of 64-bit digests.

A rule is a host with a path prefix (``example.com/en/``); it fits its host and all subdomains when the path of the
URL starts with its path; the longest rule that fits wins (of equally long ones that with the longer host).  The
index file holds the sorted xxhash keys of the rules, their texts and verdicts.  Executors get the file once, map it into
memory and probe whole batches by binary search; a hit counts only if the stored text equals the probed one.

The index may be as large as ``max_index_bytes``; a longer list is joined by its text as a table, with the same results.

Defined results: null urls and urls without ``://`` have empty host and path and get the method's verdict (``allow``, since no rule
fits); of rules that repeat a host and path the first (block before allow in a table) counts; empty tables
give empty results; repeated rows are judged one by one and alike; of rules that fit the longest wins, so there are no other ties; urls of any length are
judged whole; other columns of pages are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def build(rules: Iterable[tuple[str, str]], digest=xxhash.xxh64_intdigest) -> bytes:
    """The index: counts, label counts and path lengths that occur, sorted keys, verdicts, text ends, texts."""
    first: dict[str, str] = {}
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        first.setdefault(host.translate(str.maketrans(UPPER, LOWER)) + slash + path, action)
    rows = sorted((digest(r.encode()), r.encode(), a == "block") for r, a in first.items())
    hosts = [r.decode().partition("/") for _, r, _ in rows]
    labels = sorted({h.count(".") + 1 for h, _, _ in hosts})
    lengths = sorted({len(s + p) for _, s, p in hosts}, reverse=True)
    head = struct.pack("<3q", len(rows), len(labels), len(lengths)) + np.array(labels + lengths, "<i8").tobytes()
    body = np.array([k for k, _, _ in rows], "<u8").tobytes() + np.array([b for _, _, b in rows], "<i8").tobytes()
    return head + body + np.cumsum([0] + [len(r) for _, r, _ in rows]).astype("<i8").tobytes() + b"".join(r for _, r, _ in rows)


class Index:
    """A mapped index file."""

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest):
        raw = np.memmap(path, np.uint8, "r")
        n, a, b = (int(x) for x in raw[:24].view("<i8"))
        nums = raw[24 : 24 + 8 * (a + b + 3 * n + 1)].view("<i8")
        self.labels, self.lengths = nums[:a].tolist(), nums[a : a + b].tolist()
        self.keys, self.blocks, self.ends = nums[a + b : a + b + n].view("<u8"), nums[a + b + n : a + b + 2 * n], nums[a + b + 2 * n :]
        self.texts, self.digest = raw[24 + 8 * (a + b + 3 * n + 1) :], digest

    def probe(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The rule that wins for each host and path, and the verdict."""
        rows, cands = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            names = host.split(".")
            ends = [".".join(names[-k:]) for k in self.labels if k <= len(names)] if host else []
            for tail in ends:
                for k in self.lengths:
                    if k <= len(path):
                        rows.append(i)
                        cands.append(tail + path[:k])
        keys = np.fromiter((self.digest(c.encode("utf-8", "surrogatepass")) for c in cands), np.uint64, len(cands))
        at = np.searchsorted(self.keys, keys)
        best: list[tuple | None] = [None] * len(hosts)
        near = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == keys)) if len(self.keys) else []
        for j in near:
            k, cand = int(at[j]), cands[j].encode("utf-8", "surrogatepass")
            while k < len(self.keys) and self.keys[k] == keys[j]:
                if self.texts[self.ends[k] : self.ends[k + 1]].tobytes() == cand:
                    size = (len(cands[j]), len(cands[j].partition("/")[0]))
                    if best[rows[j]] is None or best[rows[j]][0] < size:
                        best[rows[j]] = (size, cands[j], "block" if self.blocks[k] else "allow")
                    break
                k += 1
        return [b and b[1] for b in best], [b[2] if b else "allow" for b in best]


def _by_index(urls: DataFrame, index: bytes) -> DataFrame:
    spark = urls.sparkSession
    name = f"url-rules-{hashlib.sha256(index).hexdigest()[:24]}"
    path = os.path.join(tempfile.gettempdir(), name)  # the same content always has the same name and place
    with tempfile.NamedTemporaryFile(delete=False) as f:
        f.write(index)
    os.replace(f.name, path)
    spark.sparkContext.addFile(path)  # the driver hands it to every executor, also to later ones

    def judge(batches: Iterator) -> Iterator:
        from pyspark import SparkFiles

        held = Index(SparkFiles.get(name))
        for pdf in batches:
            rule, verdict = held.probe(pdf["host"].tolist(), pdf["path"].tolist())
            yield pdf.assign(rule=rule, verdict=verdict)

    return urls.mapInPandas(judge, "page_id long, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For lists beyond the index: candidates of each different host and path meet the rules by text."""
    at = F.locate("/", "rule")
    host = F.translate(F.when(at > 0, F.substring("rule", F.lit(1), at - 1)).otherwise(F.col("rule")), UPPER, LOWER)
    parts = rules.select("action", F.concat(host, F.when(at > 0, F.substring(F.col("rule"), at, F.length("rule"))).otherwise(F.lit(""))).alias("rule"), host.alias("h"))
    one = parts.groupBy("rule", "h").agg(F.max("action").alias("action"))
    spans = one.agg(F.collect_set(F.size(F.split("h", "[.]"))).alias("labels"), F.collect_set(F.length("rule") - F.length("h")).alias("lengths"))  # as many as differ
    seen = urls.select("host", "path").distinct().where("host <> ''").join(F.broadcast(spans))
    names = F.split("host", "[.]")
    tails = F.transform(F.filter("labels", lambda k: k <= F.size(names)), lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."))
    seen = seen.select("host", "path", F.explode(tails).alias("tail"), "lengths").select("host", "path", "tail", F.explode(F.filter("lengths", lambda k: k <= F.length("path"))).alias("k"))
    hit = seen.withColumn("rule", F.concat("tail", F.substring("path", F.lit(1), F.col("k")))).join(one, "rule")
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("h").alias("m"), "rule", "action")).alias("b"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.action", F.lit("allow")).alias("verdict"))


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame, max_index_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; rules: (allow or block, host and path)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 24), F.lit(0))).first()[0]
        if size > max_index_bytes:
            return _by_join(urls, rules)
        rules = [tuple(r) for r in rules.select("action", "rule").orderBy(F.desc("action")).collect()]  # size checked
    return _by_index(urls, build(rules))

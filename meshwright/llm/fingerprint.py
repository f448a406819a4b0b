"""Operator 5: canonical exact fingerprints.

The canonical form of a text is its compatibility composition (NFKC), case-folded, with every run of white space as
one space and none at the ends.  Its fingerprint is the 128-bit xxhash of that form in UTF-8.  Where one digest belongs
to different forms, the forms' bytes are compared: the digest is followed by ``-`` and the form's own SHA-256,
so fingerprints are equal exactly when the canonical forms are.  The comparison pre-aggregates the least and the greatest form of each
digest that occurs more than once, so no group meets in one task.

Defined results: null text is empty; rows without a doc_id come before all others, in an order that their texts decide (doc_ids are above -2**62); likeness is 1 for equal fingerprints and else 0, as an exact fingerprint knows no
degrees; the next document of the last one is the first, of an only document itself; rows that repeat a doc_id follow one
another in order of their text's digest, and rows that repeat id and text in any order, as they are equal; a very long text is folded whole by one task; empty tables give an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, keyed, stored, texts


#: Runs of documents at most.
RUNS = 20_000


def canonical(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).casefold()
    if not text.isascii():  # folding may leave what composes again
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def place(bounds: list[tuple[int, str]], key: Column) -> Column:
    """How many of the sorted bounds are at most key, less one: first among every so many, then among those between."""
    made = lambda rows: F.array(*[F.struct(F.lit(d).cast("long").alias("doc_id"), F.lit(h).alias("sha")) for d, h in rows])
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.size(F.filter(made(bounds[::step]), lambda b: b <= key)) - 1
    return coarse * step + F.size(F.filter(F.slice(made(bounds), coarse * step + 1, F.lit(step)), lambda b: b <= key)) - 1


def in_order(docs: DataFrame, part_chars: int) -> DataFrame:
    """part, doc_id, sha, trailing and text: runs of consecutive documents, each run sorted in one partition.

    A run ends with a trailing copy of the document that comes after it, so every document sits next to its successor.  The runs'
    bounds (one per run, at most RUNS, whatever the input: runs grow with it, and are sorted on disk and read as streams) are taken from the ids alone; the texts travel once.
    """
    rows = texts(docs).withColumn("sha", F.sha2("text", 256))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, min(chars // part_chars, RUNS))
    ids = rows.select("doc_id", "sha").repartitionByRange(parts, "doc_id", "sha")
    heads = sorted(tuple(r[0]) for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "sha"))).drop("p").collect())
    heads, n = heads or [(0, "")], max(len(heads), 1)
    rows = rows.withColumn("part", place(heads, F.struct("doc_id", "sha")))
    starts = F.array(*[F.struct(F.lit(d).cast("long").alias("doc_id"), F.lit(h).alias("sha")) for d, h in heads])
    first = F.get(starts, F.col("part")) == F.struct("doc_id", "sha")
    places = F.when(first, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("trailing")), F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("trailing")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("trailing"))))
    rows = rows.select("doc_id", "sha", "text", F.explode(places).alias("p")).select("p.part", "p.trailing", "doc_id", "sha", "text")
    return rows.repartition(n, "part").sortWithinPartitions("part", "trailing", "doc_id", "sha")


ROW = "doc_id long, n_chars long, edited_sha256 string, fp string, fp_sha string, efp string, efp_sha string, next_fp string, next_sha string"


def walked(batches: Iterator) -> Iterator:
    """The rows of ROW for documents that come with their successors."""
    before = None
    for pdf in batches:
        out = []
        for part, trailing, doc, text in zip(pdf["part"], pdf["trailing"], pdf["doc_id"], pdf["text"], strict=True):
            form = canonical(text).encode("utf-8", "surrogatepass")
            here = (part, trailing, doc, text, xxhash.xxh3_128_hexdigest(form), hashlib.sha256(form).hexdigest())
            if before is not None and before[0] == part and not before[1]:
                old = before[3]
                half = len(old) // 2
                new = old[: len(old) - half] + text[:half]
                edit = canonical(new).encode("utf-8", "surrogatepass")
                out.append((before[2], len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), *before[4:], xxhash.xxh3_128_hexdigest(edit), hashlib.sha256(edit).hexdigest(), *here[4:]))
            before = here
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])


def clashes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The digests (column fp) of more than one canonical form."""
    every = found.select("fp", F.col("fp_sha").alias("sha")).unionByName(found.select(F.col("efp").alias("fp"), F.col("efp_sha").alias("sha")))
    told = every.groupBy("fp").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).where("lo <> hi").select("fp")
    twice = stored(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("one")).where("n > 1"))
    ids = found.join(twice.select("fp"), "fp", "left_semi").select(F.col("doc_id").alias("id"))

    def formed(batches: Iterator) -> Iterator:
        for pdf in batches:
            forms = [canonical(t) for t in pdf["text"]]
            yield pd.DataFrame({"fp": [digest(f) for f in forms], "form": [f.encode("utf-8", "surrogatepass") for f in forms]})

    forms = few(texts(docs), ids, "doc_id").mapInPandas(formed, "fp string, form binary")
    apart = forms.groupBy("fp").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo <> hi").select("fp")
    return told.unionByName(apart).distinct()


def fingerprints(docs: DataFrame, part_chars: int = 8_000_000) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = keyed(docs).select("doc_id", "text")
    found = stored(in_order(docs, part_chars).drop("sha").mapInPandas(walked, ROW))
    odd = stored(clashes(docs, found))
    if odd.isEmpty():
        full = lambda fp, sha: F.col(fp)  # noqa: E731, ARG005
    else:
        for name in ("fp", "efp", "next_fp"):
            found = found.join(odd.select(F.col("fp").alias(name), F.lit(True).alias(f"{name}_odd")), name, "left")
        full = lambda fp, sha: F.when(F.col(f"{fp}_odd"), F.concat_ws("-", fp, sha)).otherwise(F.col(fp))
    out = found.select("doc_id", "n_chars", "edited_sha256", full("fp", "fp_sha").alias("fingerprint"), full("efp", "efp_sha").alias("edited_fingerprint"), full("next_fp", "next_sha").alias("_next"))
    alike = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return out.select(F.when(F.col("doc_id") > -(1 << 62), F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("fingerprint", "edited_fingerprint").alias("near_edited"), alike("fingerprint", "_next").alias("near_next"))

"""Operator 4: exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of ``block`` code points.  Equal blocks get one integer name: the distinct blocks of each
partition are sorted and numbered.  Then adjacent names of a document are paired, equal pairs get one name, and so
on until each document has a single name.  Its identity is that name with its level, so texts have the same
identity exactly when they are equal.

A block's content travels once, pre-aggregated, to be named.  Its occurrences are joined to the names by a 64-bit hash,
which decides where only one distinct block has that hash; blocks that share a hash are joined by content.  Hot
names are joined by broadcast, so no task gets all occurrences of a hot block, pair or text.

Defined results: null text equals empty text; of equal texts the largest doc_id stays; repeated rows are all
reported, and one of them is kept; a very long text is cut into as many blocks as it needs, by one task; empty tables give an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, hot_join, stored, texts


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """distinct (one row per key) with its rows sorted within each partition and numbered by ``name``."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _occurrences(docs: DataFrame, block: int, hashed: Callable[[Column], Column]) -> DataFrame:
    rows = texts(docs).withColumn("sha", F.sha2("text", 256)).withColumn("v", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(block)).cast("int")))
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring(F.col("text"), i * block + 1, F.lit(block)))
    rows = rows.select("doc_id", "v", "sha", "blocks", F.posexplode(cut).alias("pos", "block"))
    return rows.select("doc_id", "v", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "blocks", "pos", hashed(F.col("block")).alias("h"), "block", F.lit(1).cast("long").alias("m"))


def identities(docs: DataFrame, block: int = 1024, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, sha (of the text), m (how many such rows) and identity, one row per different (doc_id, text)."""
    occ = _occurrences(docs, block, hashed)
    named = _numbered(occ.groupBy("block").agg(F.first("h").alias("h"), F.count(F.lit(1)).alias("n")), "block")
    named = named.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("h")))
    named = stored(named.select("h", "name", "n", F.when(F.col("alike") > 1, F.col("block")).alias("block")))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sole, alike = named.where("block is null").select("h", "name", "n"), named.where("block is not null").select("block", "name", "n")
    keep = ["doc_id", "v", "sha", "blocks", "pos", "name", "m"]
    if alike.isEmpty():
        rows = hot_join(occ.drop("block"), sole, "h", "n", total, "doc_id").select(keep)
    else:
        met = hot_join(occ, sole, "h", "n", total, "doc_id")
        rest = hot_join(met.where("name is null").drop("name", "n"), alike, "block", "n", total, "doc_id")
        rows = met.where("name is not null").select(keep).unionByName(rest.select(keep))
    rows = stored(rows)
    level, longest, parts = 0, rows.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0], []
    while True:
        done = rows.where("blocks = 1").groupBy("doc_id", "v").agg(F.max("sha").alias("sha"), F.sum("m").alias("m"), F.max("name").alias("name"))
        parts.append(done.select("doc_id", "sha", "m", F.col("name").bitwiseOR(F.shiftleft(F.lit(level).cast("long"), 56)).alias("identity")))
        if longest <= 1:
            break
        first = F.col("pos") % 2 == 0
        pairs = rows.where("blocks > 1").groupBy("doc_id", "v", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("blocks") / 2).cast("int").alias("blocks"))
        pairs = stored(pairs.agg(F.struct(F.max(F.when(first, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~first, F.col("name"))), F.lit(-1).cast("long")).alias("b")).alias("pair"), F.max("sha").alias("sha"), F.sum(F.when(first, F.col("m"))).alias("m")))
        named = stored(_numbered(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair"))
        total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = stored(hot_join(pairs, named, "pair", "n", total, "doc_id").select(keep))
        level, longest = level + 1, -(-longest // 2)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_dedup(docs: DataFrame, block: int = 1024, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = stored(identities(docs, block, hashed))
    groups = stored(found.groupBy("identity").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size")))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    out = hot_join(found, groups, "identity", "group_size", total, "doc_id")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return out.select("doc_id", "keep_id", "group_size", ((F.col("doc_id") == F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each text; rows that repeat a doc_id are told apart by their text."""
    found = stored(exact_dedup(docs))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    odd = stored(ids.where("n > 1").select(F.col("doc_id").alias("id")))
    gone = ids.where("not kept or n > 1").select(F.col("doc_id").alias("id"))
    out = few(docs, gone, "doc_id", keep=False)
    if odd.isEmpty():
        return out
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    again = few(docs, odd, "doc_id").withColumn("_sha", key)
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept"))
    again = again.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_sha") == F.col("_kept")), "left_semi")
    return out.unionByName(again.dropDuplicates(["doc_id", "_sha"]).drop("_sha"))

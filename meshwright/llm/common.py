"""Shared pieces: hot-key joins and input normalisation."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, release, shared_dir, stored

__all__ = ["HOT", "HOT_ROWS", "carried", "delete", "few", "hot_join", "keyed", "opened", "release", "shared_dir", "stored", "texts", "unkeyed"]

#: A key is hot when it holds at least 1/HOT of all rows, or HOT_ROWS: at most HOT keys and one for each HOT_ROWS rows.
HOT, HOT_ROWS = 256, 1_000_000


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of docs, and the columns named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a doc_id in every row, and _given: a null one becomes a number below -2**62 that the text decides, so rows without an id and with equal texts share it."""
    stand_in = F.lit(-(1 << 62)) - F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    return docs.withColumn("_given", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), stand_in))


def unkeyed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows of keyed(docs) with docs' columns and null ids."""
    return rows.withColumn("doc_id", F.when(F.col("_given"), F.col("doc_id").cast(docs.schema["doc_id"].dataType))).select(*docs.columns)


def hot_join(left: DataFrame, groups: DataFrame, key: str, size: str, total: int, salt: str) -> DataFrame:
    """left with the columns of its key's row in groups (one row per key, ``size`` its row count in left).

    Keys of size >= total / HOT or >= HOT_ROWS are joined by broadcast (at most HOT + total / HOT_ROWS rows), and their rows go to
    tasks by salt instead of by key, so no task gets a hot group.  ``total`` is the row count of left.  Keys without a row in groups get nulls.
    """
    cols = [c for c in groups.columns if c != key]
    is_hot = F.col(size) >= F.lit(min(total / HOT, float(HOT_ROWS)))
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    kind = dict(groups.dtypes)[key]
    salted = F.xxhash64(salt) if kind == "bigint" else F.struct(F.xxhash64(salt).alias("a"), F.lit(0).cast("long").alias("b")) if kind.startswith("struct") else F.col(salt).cast("string").cast(kind)
    tagged = left.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"_h_{c}") for c in cols], F.lit(True).alias("_hit"))), key, "left")
    tagged = tagged.withColumn("_hot", F.coalesce("_hit", F.lit(False))).withColumn("_k", F.when(F.col("_hot"), salted).otherwise(F.col(key)))
    cold = cold.select(F.lit(False).alias("_hot"), F.col(key).alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in cols])
    out = tagged.join(cold, ["_hot", "_k"], "left")
    return out.select(*[F.col(c) for c in left.columns], *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in cols])


#: So many ids may be broadcast; more are joined.
IDS_BROADCAST = 1_000_000


def few(rows: DataFrame, ids: DataFrame, column: str, keep: bool = True) -> DataFrame:
    """rows whose column is (or, without keep, isn't) in ids, a table of one column id: by broadcast if the ids are few enough, else by a join."""
    ids = stored(ids.distinct())
    held = F.broadcast(ids) if ids.count() <= IDS_BROADCAST else ids
    return rows.join(held, rows[column] == ids["id"], "left_semi" if keep else "left_anti")


def carried(spark: SparkSession, value: object) -> Broadcast:
    """value for all executors (``opened`` there).  It is pickled with the classes of this package in it, as executors need no copy of the package; plain broadcasts only name them."""
    return spark.sparkContext.broadcast({"raw": cloudpickle.dumps(value)})


def opened(held: Broadcast) -> object:
    """What a broadcast carries, unpickled once by each worker: the worker keeps it in the broadcast's own value from task to task."""
    found = held.value
    if "value" not in found:
        found["value"] = pickle.loads(found.pop("raw"))
    return found["value"]

"""A training corpus from ``documents``: toxic texts go, then exact copies, then near copies; personal data is masked; what is left is packed.

doc_id is the key of documents.  Rows without one are told apart by their texts and count as having the least ids, so of
equal texts a row with an id stays and of near ones the row without.  Columns beyond those of documents are carried along, whatever their names.  Null and
empty texts count as empty: one of them stays; rows that repeat an id and a text are copies, of which one stays.  Texts of any length are worked on
whole.  An empty table leaves every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import exact_dedup, minhash, packing, pii, toxicity
from meshwright.llm.common import few, keyed, release, stored, unkeyed

#: Rows that a Python worker is handed at a time: whole texts, of which two batches and the engine's buffers for them lie in an executor's memory at once.
BATCH = 1000


def batched(spark: SparkSession) -> None:
    """Batches of at most BATCH rows from now on, as stages are run after they return."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH:
        spark.conf.set(name, str(BATCH))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted to be toxic."""
    batched(spark)
    rows = keyed(docs)
    scores = toxicity.score(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unkeyed(few(rows, scores.where("predicted = 1").select(F.col("doc_id").alias("id")), "doc_id", keep=False), docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return unkeyed(exact_dedup.keep_one(keyed(docs)), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    batched(spark)
    rows = keyed(docs)
    gone = minhash.near_duplicates(rows).where("not kept").select(F.col("doc_id").alias("id"))
    return unkeyed(few(rows, gone, "doc_id", keep=False), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.masked(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 4096 tokens."""
    import public_tokenizers

    batched(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # toxicity, near-duplicates and tokens are beyond SQL; tests hold the rows against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir)), docs
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)

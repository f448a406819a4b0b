"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset on one machine (master local[...], as in tests) a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", d)
        atexit.register(delete, spark, d)
    return d.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may already be gone at exit
        pass


#: Settings of a session made by ``placed``: the column by which its stored tables lie in buckets, and their number.
COLUMN, BUCKETS = "spark.meshwright.column", "spark.meshwright.buckets"
#: Rows of the table that much is made of, which ``placed`` puts into a bucket at most, and at least if that leaves every core some.
MOST, LEAST = 4096, 512


def placed(spark: SparkSession, rows: int, column: str = "dataset_id") -> SparkSession:
    """A session for datasets of which each is small and which are many: its stored tables lie in buckets by dataset.

    Joins and groups by dataset and id then find their rows where they are, in tasks of some MOST rows (of the table that the datasets are made from) however many there are, so only rows that are new or leave their
    dataset are shuffled.  Nothing is broadcast unless a plan says so: tables of nested or much alike rows are many times smaller in files than in the memory of the driver, which they would pass through.
    """
    shared_dir(spark)
    near = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            near.conf.set(name, value)
    cores = spark.sparkContext.defaultParallelism
    n = max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // LEAST), rows // MOST)
    near.conf.set(COLUMN, column)
    near.conf.set(BUCKETS, str(n))
    near.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    near.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    near.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    near.conf.set("spark.sql.sources.bucketing.enabled", "true")
    near.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    near.conf.set("spark.sql.sources.bucketing.maxBuckets", str(max(n, 100_000)))
    # rows of a task are those of a bucket: no sort by bucket before they are written
    near.conf.set("spark.sql.maxConcurrentOutputFileWriters", "8")
    return near


def in_place(df: DataFrame) -> DataFrame:
    """df dealt out as the stored tables of its session are, where it is one of ``placed``."""
    spark = df.sparkSession
    column = spark.conf.get(COLUMN, None)
    return df.repartition(int(spark.conf.get(BUCKETS)), column) if column in df.columns else df


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: computed once, and safe from lost executors.

    by: columns that buckets are sorted by, so that of a table that is read again and again for one value each, only the pages that hold it are.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}"
    atexit.register(delete, spark, path)
    column = spark.conf.get(COLUMN, None)
    if column in df.columns:
        writer = in_place(df).write.bucketBy(int(spark.conf.get(BUCKETS)), column).option("path", path)
        (writer.sortBy(*by) if by else writer).saveAsTable(f"stored_{name}", format="parquet")
        atexit.register(forget, spark, path)
        out = spark.read.table(f"stored_{name}")
    else:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for release
    return out


def forget(spark: SparkSession, path: str) -> None:
    """Takes a stored table in buckets out of the catalog."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS stored_{path.rsplit('/', 1)[-1]}")
    except Exception:  # noqa: BLE001 - as in delete
        pass


def dealt(df: DataFrame) -> DataFrame:
    """Like stored, for tables of nested or much alike rows, whose files are many times smaller than their rows in memory.

    Spark would take them (and what is made of them) for small and pass them through the driver to broadcast them; the hint has their joins deal out both sides.
    """
    kept = stored(df)
    out = kept.hint("merge")
    out._stored_at = kept._stored_at
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys over as many tasks as shuffles have, for small rows of which much is made: read as they are, they would fill a task or two."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no plan reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            if df.sparkSession.conf.get(COLUMN, None):
                forget(df.sparkSession, path)
            delete(df.sparkSession, path)


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that no plan reads any more, and lets Spark drop the shuffle files of plans that are gone."""
    spark = None
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            if spark.conf.get(COLUMN, None):
                forget(spark, path)
            delete(spark, path)
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()

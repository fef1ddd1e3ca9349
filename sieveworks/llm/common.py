"""What the operators share: reading tables, cutting lineage in the shared folder, bounded samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python; with documents of a few KB a batch stays at a few MB.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. Also bounds the Arrow batches of what is planned from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); only where it is unset, in local mode as in tests, an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="sieveworks-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/sieveworks/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """df, written to the shared folder as Parquet and read back: its lineage ends there and survives lost executors.
    The files go when the application ends."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, whatever file system it is on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fold(col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo folds; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(folds)


def hash_sample(df: DataFrame, key, total: int, bound: int, salt: str) -> DataFrame:
    """About bound of df's total rows (all, if there are no more), chosen by a hash of key: the same rows for the same table."""
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1_000_000)) < F.lit(int(1_000_000 * bound / total)))


#: Keys that are looked up by broadcast because many rows have them: at most this many, each with its share of the rows.
HOT_KEYS, LEAST_HOT = 1000, 64


def looked_up(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """left with the other columns of right (one row per key, a string) where the key is equal, else nulls.

    Keys that more than one in HOT_KEYS of left's rows have are broadcast, at most HOT_KEYS rows, and their rows, like
    those without a key, are dealt by themselves, so that no key's rows meet in one task. left is read twice."""
    values = [c for c in right.columns if c != key]
    if hot is None:
        counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        hot = counts.where(F.col("_n") > max(LEAST_HOT, left.count() // HOT_KEYS)).select(key)
    known = cut(right.join(F.broadcast(hot), key, "left_semi").select(F.col(key), F.struct(*values).alias("_hot")), "hot")
    rows = left.join(F.broadcast(known), key, "left")
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    own = F.when(alone, F.concat(F.lit("\0"), F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)).cast("string"))).otherwise(F.col(key))
    rest = right.select(F.col(key).alias("_own"), F.struct(*values).alias("_cold"))
    out = rows.withColumn("_own", own).join(rest, "_own", "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return out.select(*left.columns, *(F.col("_found")[c].alias(c) for c in values))


def broadcastable(ids: DataFrame, col: str, bound: int) -> bool:
    """Whether the values of a column, with what a hash table of them needs, stay within bound bytes."""
    size = ids.agg(F.coalesce(F.sum(F.length(F.col(col).cast("string")) + F.lit(40)), F.lit(0))).first()[0]
    return size <= bound

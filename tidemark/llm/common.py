"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same folding for UTF-8 bytes.
BYTE_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Words of the contracts: runs of bytes other than space, tab, LF, VT, FF, CR.
BYTE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A table is broadcast up to so many rows; beyond it the plans shuffle.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the folder that all executors share and go on from there.

    The folder is spark.checkpoint.dir; a session on one machine that names none gets a temporary one. A
    table read again has its true size, where a checkpoint would keep its plan's estimate, which multiplies
    with every join of a loop.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster has to name a folder that its machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratches:
        _scratches[-1].paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


_scratches: list[scratch] = []


class scratch:  # noqa: N801
    """with scratch(spark) as s: tables that cut writes inside are deleted at its end, but for those that s.keep was given.

    What is kept has to be written before the end, so that nothing that lives on would read a deleted table
    again, whatever is lost. Kept tables belong to the scratch around this one. Shuffles that nothing refers to any more are
    given up as well.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> scratch:
        _scratches.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df._written_at)
        return df

    def __exit__(self, kind, *_) -> None:
        _scratches.remove(self)
        if kind is not None:
            return
        if _scratches:
            _scratches[-1].paths += self.kept
        for path in set(self.paths) - set(self.kept):
            drop(self.spark, path)
        release(self.spark)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of plans that are done with."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its rows, which are counted here, are few enough."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def batch_count(spark: SparkSession, size: int, batch_bytes: int) -> int:
    return max(shuffle_partitions(spark), -(-size // batch_bytes))


def in_batches(docs: DataFrame, keys: Sequence[str], size: int, batch_bytes: int, name: str = "batch") -> DataFrame:
    """docs with a batch number: hashed, of about batch_bytes of text each, so many more at larger inputs.

    keys should tell rows apart: with the text among them, neither rows without an id nor those that repeat one meet in one batch.
    """
    n = batch_count(docs.sparkSession, size, batch_bytes)
    return docs.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int, how: str = "left", small: int = BROADCAST_ROWS) -> DataFrame:
    """left joined with right, which has one row for each key.

    A right side of up to small rows (they are counted here) is broadcast. Of a large one only the keys with a
    thousandth of left's rows or more are broadcast, at most a thousand of them by that definition of
    weight (rows of left with the key); the other rows meet in a shuffled join that has no hot key.
    """
    if right.count() <= small:
        return left.join(F.broadcast(right), keys, how)
    hot = right.filter(F.col(weight) * 1000 >= rows)
    cold = right.filter(F.col(weight) * 1000 < rows)
    flagged = left.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    return (
        flagged.filter(is_hot).drop("_hot").join(F.broadcast(hot), keys, how)
        .unionByName(flagged.filter(~is_hot).drop("_hot").join(cold, keys, how))
    )

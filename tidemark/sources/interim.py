"""Tables that a plan writes on its way, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """Where this application's interim tables lie: under spark.checkpoint.dir.

    A session on one machine that names no such folder gets a temporary one; on a cluster it has to be named.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster has to name a folder that its machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/interim-{sc.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df as a table that was written and is read again: computed once, whatever uses it, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's interim tables, once the results that rest on them are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Reading tables and cutting lineage in storage that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer partitions than there are cores; a large table stays as it is read.

    A file of one row group can't be split, so without this a small table would keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    A machine-local folder is used only where the setting is absent and Spark runs in local mode, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), "lexiweave-shared")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of what was written, without lineage.

    Spark's own checkpoint keeps rows uncompressed, so a compressed Parquet table is written instead. A path is
    never used twice; the folder is removed when the JVM ends, or by whoever clears the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiweave/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the JVM ends."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)


def release(df: DataFrame) -> None:
    """Delete the files behind a ``materialise`` result that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lexiweave/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)

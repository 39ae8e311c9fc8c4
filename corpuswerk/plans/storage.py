"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; only in local mode, as in tests, a temporary one where none is named."""
    where = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="corpuswerk-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared one."""
    return f"{shared_dir(spark)}/corpuswerk-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results still to be read must be written before."""
    drop_path(spark, own_dir(spark))


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once and read it back: its lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def checked_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a reference table whose size is proven to stay within limit rows; fail beyond it."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it can't be sent to every executor")
    return rows

"""Session settings and the one way lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without a setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tablescout-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


SHORT_LIVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Survives lost executors, ends the lineage, and keeps columns prunable. The shuffle files
    behind it go as soon as it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    before = spark.conf.get(SHORT_LIVED)
    spark.conf.set(SHORT_LIVED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHORT_LIVED, before)
    return spark.read.schema(df.schema).parquet(path)

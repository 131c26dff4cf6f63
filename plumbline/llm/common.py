"""Shared folder, materialised tables and null-safe table reading for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver share (spark.checkpoint.dir).

    Only in a local session, which has one machine, a temporary folder is chosen where none is named.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"


#: Spark's setting that shuffle files go as soon as their query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Batches that Python takes where the session doesn't set its own: smaller than Spark's, as an executor and its workers hold
#: a batch of texts several times.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and no recomputation, and the shuffles that made the
    table are deleted when it is written. From the first table on, the session hands Python BATCHES.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    for k, v in BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def free(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release(df: DataFrame) -> None:
    """Delete a table made by materialize() that no later step reads; other frames are left alone."""
    path = getattr(df, "_plumbline_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

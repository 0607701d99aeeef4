"""Cutting long lineages and keeping intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of our own only where a one-process session has none."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not given:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return given


def staging(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own part of the shared folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillspark/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Remove all that this application has staged; frames that read it are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back."""
    path = staging(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Shared folders: where intermediate tables, and files that sinks and sources exchange, can be seen by all executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own stands in only where none is set and everything runs in
    one process; elsewhere executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tributary-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def run_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are; ``clean`` deletes it."""
    return f"{shared_dir(spark)}/tributary/{spark.sparkContext.applicationId}"


def mounted(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, as a path that Python code can open.

    Sources and sinks that read and write single files need the shared folder to
    be mounted on every machine.
    """
    folder = re.sub(r"^file:(//)?(?=/)", "", f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    if re.match(r"\w+:", folder):
        raise RuntimeError(f"files of {tag} need a shared folder that is mounted, not {folder}")
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage so that lost executors cost no more than their tasks."""
    path = f"{run_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of this application made by ``written`` whose rows are no longer needed; others are left alone."""
    for df in tables:
        own = f"/tributary/{df.sparkSession.sparkContext.applicationId}/"
        for f in df.inputFiles()[:1]:
            folder = f.rpartition("/")[0]
            if own in f"{folder}/" and not folder.endswith(own.rstrip("/")):
                delete(df.sparkSession, folder)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them must be written before."""
    delete(spark, run_dir(spark))

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master one is made when unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def _path(spark: SparkSession, where: str):
    """(file system, path) of a place that Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def read_text(spark: SparkSession, where: str) -> str | None:
    """A small file's text, or None if there is no such file."""
    system, path = _path(spark, where)
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, where: str, text: str) -> None:
    system, path = _path(spark, where)
    stream = system.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename_parts(spark: SparkSession, where: str, kind: str) -> None:
    """Name the files that Spark wrote to a folder by their partitions alone."""
    system, path = _path(spark, where)
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("part-"):
            number = int(name.split("-")[1])
            system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path, f"part-{number:06d}.{kind}"))


class Scratch:
    """A folder of intermediate Parquet tables.

    A table written here survives the loss of any executor and cuts the lineage
    of what reads it.  ``drop`` frees a table that no later plan reads; what is
    left goes when the driver's interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str = "work"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gapline-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))
        self.free()

    def free(self) -> None:
        """Let go of the shuffle files of finished jobs, which Spark keeps until their plans are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        system, target = _path(self.spark, path)
        system.delete(target, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended before the interpreter
            pass

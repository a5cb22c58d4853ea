"""A folder that driver and executors share, for files that are written to be read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; it goes when the driver's interpreter ends."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(root or '/tmp/checkpoints').rstrip('/')}/gapline-files-{uuid.uuid4().hex[:12]}/{name}"

    def remove() -> None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        except Exception:  # the session has ended before the interpreter
            pass

    atexit.register(remove)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to such a folder; what is returned reads the written table, and none of the plan behind it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

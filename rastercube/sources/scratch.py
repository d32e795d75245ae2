"""A folder for tables in between that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a folder of its own; a cluster, whose
    executors would not see that folder, gets an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master or "").startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's readers find it."""
    if spark.sparkContext._jsc is None:
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

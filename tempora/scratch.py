"""Cutting lineage in iterative operators, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tempora-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of `df`: the same rows in the same partitions."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{folder(spark)}/tempora-{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session is ending, the folder may be gone
            return

    atexit.register(remove)
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read back, for loops: computed once, its plan (and what the optimizer knows of it) forgotten."""
    path = place(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

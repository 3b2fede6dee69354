"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one where the session names none and runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="sievelake-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete all tables staged so far, when results that read them have been used; how many there were."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for Python work on rows of a few files.

    An input that is read in more parts than that, as any large one is, is not shuffled. ``scan``: the plain scan
    that ``df`` comes from; asking a plan with joins how many partitions it has would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = (df if scan is None else scan).rdd.getNumPartitions()
    return df if parts >= cores else df.repartition(cores)

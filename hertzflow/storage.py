"""Working tables in the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 200_000


def work_root(spark: SparkSession) -> str:
    """The shared work folder. Only a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="hertzflow-"))
    return context.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, which cuts its lineage.

    A written table, unlike a cached one, outlives lost executors and still
    lets later readers prune columns and push filters down.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def group_side(groups: DataFrame, label: str) -> DataFrame:
    """A table with one row per group, to be joined to all rows of the groups.

    It is written and counted. Up to ``SMALL_ROWS`` rows it is broadcast, so the rows
    stay where they are and a hot group is no hot task; a larger one is joined by key,
    where Spark splits hot partitions. The result is the same.
    """
    groups = stage(groups, label)
    return F.broadcast(groups) if groups.count() <= SMALL_ROWS else groups

"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="haulmark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once and read back: later uses prune columns and survive lost executors."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/haulmark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*tasks: Callable[[], object]) -> list:
    """Run Spark jobs that do not depend on each other at the same time; fails if one fails."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [done.result() for done in [pool.submit(task) for task in tasks]]

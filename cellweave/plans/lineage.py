"""Cutting lineage between the rounds of an iterative or multi-pass plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where ``spark.checkpoint.dir`` names none, a local master gets a temporary
    one, which goes with the process; on a cluster executors couldn't share it, so that is an error."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="cellweave-checkpoints-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from those files.

    The files survive the loss of executors, so later rounds never recompute earlier ones.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of a store that Spark writes to; none there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fewer_tasks(df: DataFrame, rows: int, rows_per_task: int = 100_000) -> DataFrame:
    """``df`` in as few tasks as its known number of rows needs: a small table read by many tasks costs
    each following shuffle a set of files for every one of them."""
    return df.coalesce(max(1, -(-rows // rows_per_task)))

"""What every query needs of a session."""

from __future__ import annotations

import gc
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows that are sent to Python at once, where the session has Spark's default of 10,000: texts are long.
BATCH_ROWS = 2000


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and give memory back when a batch is done.

    A cluster without the driver's folder gets the package by --py-files.
    """
    top, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if top not in paths:
        env["PYTHONPATH"] = ":".join([*filter(None, paths), top])
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the one that `spark.checkpoint.dir` names. Only on one machine is a folder made where it is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to the shared folder that `spark.checkpoint.dir` names; its lineage ends there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """`stored`, for a table that a loop joins again and again: without the size that Spark has estimated for it.

    A stored table keeps its estimate; each join multiplies estimates, so that in a loop their digits double every round and
    planning takes ever longer. Sizes at run time still choose the joins.
    """
    spark, kept = df.sparkSession, stored(df)
    rows = spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return DataFrame(rows, spark)


def release(spark: SparkSession) -> None:
    """Delete the shuffle files and stored tables that nothing refers to any more.

    Spark deletes them when the driver's garbage is collected, which on a large driver may be long after a loop has filled the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""The folder that the driver and all executors share, for rows that cut a plan's lineage."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep a checkpoint folder that is set; give one to a local session only, as other machines wouldn't see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="symbolary-")
    sc.setCheckpointDir(named)


#: Bytes of Parquet for a partition of a shuffle at least, and of shuffled rows that adaptive execution leaves in one task.
PARTITION_BYTES, TASK_BYTES = 4_000_000, 16_000_000


def _bytes_of(setting: str) -> int:
    return int(re.match(r"\d+", setting)[0]) * 1024 ** max(0, "bkmgtp".find((re.search(r"[a-z]", setting.lower()) or "b")[0]))


def enough_partitions(*tables: DataFrame) -> None:
    """As many partitions for the caller's session as these tables ask for, so that tasks grow in number and not in memory.

    The number is only raised and the size only lowered; both stay so, as a plan reads them when it runs.
    """
    conf = tables[0].sparkSession.conf
    asked = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables) // PARTITION_BYTES
    if asked > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", str(asked))
        if _bytes_of(conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) > TASK_BYTES:
            conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{TASK_BYTES}b")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept where a lost executor doesn't lose them.

    What earlier cuts were made from is not needed any more (this one's plan is still held by the caller): a collection
    on the driver lets Spark's cleaner delete shuffle files and checkpoints that nothing refers to, which otherwise pile
    up on the disks of iterative jobs.
    """
    ensure_checkpoint_dir(df.sparkSession)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)

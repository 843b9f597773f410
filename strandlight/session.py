"""What a session must offer: the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  A local session without one (tests) gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="strandlight-checkpoint-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


ROWS_A_FILE = 50_000  # of a kept table of narrow rows


def kept(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed now and kept in the shared folder: its lineage is cut, and lost executors cost no recomputation.

    Where the number of narrow ``rows`` is known (or a bound of it), they are put into no more files than they fill.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)

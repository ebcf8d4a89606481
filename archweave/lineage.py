"""Cutting lineage with copies that outlive executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the one that the context has. In one local process, as in tests, a temporary
    one is made where there is neither; elsewhere executors couldn't reach that, so it is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(where)
        return where
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="archweave-ckpt-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder now and read from there later."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""Cutting lineage in loops through the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed, in spark.checkpoint.dir where it is set; else a local master uses a folder of its own, and a cluster
    is an error, as a machine's own folder would lose what other machines write."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="pulsegrid-"))
    return df.checkpoint(eager=True)

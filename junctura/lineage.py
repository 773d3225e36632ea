"""Cutting the lineage of tables that several later steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names; a temporary one only where none is set, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="junctura-"))
    return df.checkpoint(eager=True)

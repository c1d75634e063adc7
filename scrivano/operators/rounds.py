"""Rounds over tables: lineage is cut between them."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The table, computed once and kept in the checkpoint folder that the machines share.

    Only where all of Spark is this process, as in tests, a temporary folder serves.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            root = "file://" + os.path.join(tempfile.gettempdir(), "scrivano-rounds")
        context.setCheckpointDir(root)
    return df.checkpoint()

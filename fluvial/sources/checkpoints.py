"""Where iterative operators cut their lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's shared checkpoint folder and read back.

    Where none is set a local master gets a local folder, and a cluster is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "fluvial-checkpoints"))
    return df.checkpoint(eager=True)

"""Cutting the lineage of plans that grow in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the checkpoint folder, which all executors share; a lost one costs nothing else.

    The session names the folder in ``spark.checkpoint.dir``; only a local session without one gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidewell-"))
    return df.checkpoint()

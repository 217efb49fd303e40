"""Cutting the lineage of frames that a driver loop builds on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the checkpoint folder that driver and executors share (spark.checkpoint.dir).

    A temporary folder stands in only in local mode where none is set (tests).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(root)
    return df.checkpoint()

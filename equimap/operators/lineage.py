"""Cutting lineage in loops."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder that the cluster names in spark.checkpoint.dir. Only a local master may leave it unset and
    gets a folder of its own; a cluster's executors would not see that one, so there it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="equimap-"))
    return df.checkpoint()

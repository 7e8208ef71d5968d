"""Rows that stay as they are: written once, so that a lost executor can't deal them out anew."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """The rows checkpointed in the shared folder that the session names; where it names none, kept in memory."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None and (named := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        sc.setCheckpointDir(named)
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()

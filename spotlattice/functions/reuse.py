"""Intermediate tables that a chain of operators reads more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def reused(df: DataFrame) -> DataFrame:
    """df written once to the cluster's checkpoint folder and read from there: its plan starts anew.

    A chain of operators that each read their input several times would otherwise have a plan that grows with the power
    of the chain's length, and be computed as often. Files of a checkpoint survive lost executors. The folder is that of
    spark.checkpoint.dir; one of our own is set only where there is none and everything runs in one process (tests): on a
    cluster a machine's own folder would lose data, so there it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="spotlattice-"))
    return df.checkpoint()

"""Cutting a plan's lineage so that lost executors cost a re-read, not a re-run."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where none is set, a session on this machine alone gets a temporary one; on a cluster that is an error.
    """
    wanted = spark.conf.get("spark.checkpoint.dir", "")
    if wanted:
        return wanted
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_tessera_folder"):
        sc._tessera_folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    return sc._tessera_folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from those files."""
    jsc = df.sparkSession.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        jsc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

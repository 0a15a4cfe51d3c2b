"""Cutting lineage at files in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df` read back from a checkpoint: a long plan is planned and run in parts, and a lost executor costs no more than a part.

    Only a local master without a named folder gets a temporary one, as in tests; any other raises, as executors don't share it. The driver removes
    the application's own checkpoints when it ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith(("local[", "local-cluster[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    where = spark._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.checkpoint(eager=True)

"""Reliable checkpoints in the folder the cluster shares."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only on one machine a folder below the warehouse serves where it is unset."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return own or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage, in the context's folder or the shared one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

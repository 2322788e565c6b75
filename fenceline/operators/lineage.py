"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local master gets a new local
    folder, and any other master an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, so that neither a loop nor a lost executor repeats the work."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``settled`` for large tables that are looked at several times, each time at some columns: in columns, which are also a fraction of
    the bytes."""
    folder = f"{_shared(df.sparkSession).rstrip('/')}/kept-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

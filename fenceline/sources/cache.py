"""Parses of earlier runs, as a Parquet table keyed by path and content digest: only new contents are parsed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ruby import SCHEMA


def parsed_with_cache(sources: DataFrame, parse: Callable[[DataFrame], DataFrame], table: str) -> DataFrame:
    """``parse(sources)``, contents that the table knows taken from it and others added to it.

    A row (path, digest) with no finding marks a parsed file without any, so that it is not parsed again. Two runs at once
    may both add a content; its rows are alike and are made distinct.
    """
    spark = sources.sparkSession
    try:
        held = spark.read.parquet(table)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = None
    keys = sources.select("path", "digest").distinct()
    misses = sources if held is None else sources.join(held.select("path", "digest").distinct(), ["path", "digest"], "left_anti")
    found = parse(misses)
    new = misses.select("path", "digest").distinct().join(found, "path", "left")
    new.write.mode("append").parquet(table)
    rows = spark.read.parquet(table).join(keys, ["path", "digest"], "left_semi")
    return rows.where(F.col("kind").isNotNull()).drop("digest").distinct()


def table(folder: str, custom_associations: tuple[str, ...] = ()) -> str:
    """The table of ``folder`` for one way of parsing: other associations find other references in the same content, and another
    lexer may find other fields."""
    way = chr(0).join([SCHEMA, *sorted(custom_associations)])
    return f"{folder.rstrip('/')}/parses-{hashlib.sha256(way.encode()).hexdigest()[:16]}"


def drop_cache(spark: SparkSession, folder: str) -> None:
    """Forget everything."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

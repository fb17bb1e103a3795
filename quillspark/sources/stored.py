"""Tables kept in the folder that driver and executors share, for results that are read several times and for streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and all runs on this machine, as in tests, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own.get(spark.sparkContext.applicationId)
        if not found:
            found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table there: computed once, and not again when an executor is lost."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

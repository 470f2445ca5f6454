"""Folders that driver and executors share, for tables that a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; under a temporary one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    if not base:
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidewell-"))
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame) -> DataFrame:
    """df written to a shared folder and read again: what is used several times is computed once."""
    path = f"{scratch_folder(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

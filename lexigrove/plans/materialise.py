"""Small tables that several parts of a plan need, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: list[str] = []


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``, which executors share; a temporary folder only where that is unset (one machine, tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="lexigrove-"))
        base = _OWN[0]
    return base.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again, so that its plan runs once and its size is known."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

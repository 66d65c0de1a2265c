"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where that is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="akuru-"))
    return _local[0]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: what several branches read is worked out once.

    Its shuffle files go as soon as it is written, not only when the driver collects its garbage.
    """
    path = f"{root(df.sparkSession)}/akuru/{tag}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)

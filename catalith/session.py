"""Session defaults."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "catalith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and skew handling; ANSI mode stays on.

    On a cluster pass no master; shuffle partitions are left to adaptive
    coalescing unless given. Settings may also come from the environment as
    CATALITH_CONF="key=value,key=value" (S16).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= dict(pair.split("=", 1) for pair in os.environ.get("CATALITH_CONF", "").split(",") if "=" in pair)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate results: ``spark.checkpoint.dir``, or on one machine a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/catalith-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fixed(df: DataFrame) -> DataFrame:
    """The table computed once, with its lineage cut."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The table written as Parquet and read again: computed once like ``fixed``, but small where columns repeat, and read by column."""
    folder = f"{scratch(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)

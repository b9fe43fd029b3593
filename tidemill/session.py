"""SparkSession factory with the settings every query of the engine assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tidemill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps, ANSI arithmetic and adaptive execution.

    Settings that the cluster has set already (master, shared checkpoint folder,
    memory) are left as they are: the builder only fills in what is missing.
    """
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_REMOTE"):
        builder = builder.master(master or os.environ.get("TIDEMILL_MASTER", "local[*]"))
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()

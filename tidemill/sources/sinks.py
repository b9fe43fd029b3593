"""Sinks: routed, partitioned, rotated and enriched writes, for batch and foreachBatch alike."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; one of this machine only in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.startswith("local"):
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tidemill-sink-"))
        root = _own[0]
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def route(df: DataFrame, topic: Column, path: str) -> None:
    """Each row to the topic that an expression names: a folder for each."""
    df.withColumn("topic", topic).write.partitionBy("topic").parquet(path)


def rotate(df: DataFrame, path: str, rows_per_file: int, fmt: str = "json") -> None:
    """Files of at most so many rows."""
    df.write.option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)


def parquet(df: DataFrame, path: str, codec: str = "zstd", bloom: tuple[str, ...] = (), pages: str = "2") -> None:
    """Parquet with bloom filters on columns, a page version and a codec; the page index is always written."""
    w = df.write.option("compression", codec).option("parquet.writer.version", f"v{pages}")
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def split_dead_letters(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that go on, and rows for the dead-letter sink."""
    ok = F.coalesce(good, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def enrich(df: DataFrame, column: str, call: Callable[[object], object], out: str, kind: str, workers: int = 8, retries: int = 0, on_failure: str = "fail") -> DataFrame:
    """A column from an outside call, several at a time in each task, in the order of the rows.

    ``on_failure``: fail the task, ``drop`` the row, or ``null``.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` {kind}"
    lost = object()

    def attempt(x):
        for k in range(retries + 1):
            try:
                return call(x)
            except Exception:
                if k == retries:
                    if on_failure == "fail":
                        raise
                    return lost

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                got = list(pool.map(attempt, b[column].tolist()))
                b = b.assign(**{out: pd.Series([None if g is lost else g for g in got], index=b.index, dtype=object)})
                yield b[[g is not lost for g in got]] if on_failure == "drop" else b

    return df.mapInPandas(run, schema)

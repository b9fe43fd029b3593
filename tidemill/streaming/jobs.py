"""The engine's operators as streaming queries: watermarks, windows, joins, suppression, sinks.

Stateless transforms and joins of ``tidemill.operators`` take a streaming DataFrame as
they are.  What differs is here.  Times must be TIMESTAMP (zoneless ones are cast, in
UTC) as a watermark asks for it.  A watermark advances per batch and over all keys,
so a batch may accept a record that record-by-record stream time would call late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def with_event_time(df: DataFrame, ts: str, lag: str) -> DataFrame:
    """Event time under a bounded lag: "0 seconds" is monotonic ascending."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lag)


def windowed(df: DataFrame, keys: list[str], ts: str, size: str, slide: str | None, *aggs: Column) -> DataFrame:
    """Tumbling or hopping windows; with output mode append each is emitted once, when it closes."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*keys, w.alias("w")).agg(*aggs).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(F.col(c) for c in _names(df, keys, w, aggs)))


def _names(df, keys, w, aggs) -> list[str]:
    return df.groupBy(*keys, w.alias("w")).agg(*aggs).columns[len(keys) + 1 :]


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str, *aggs: Column) -> DataFrame:
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("session_end"), *aggs)
    return out.withColumn("session_start", F.col("w.start")).drop("w")


def stream_stream(left: DataFrame, right: DataFrame, key: str, ts: str, before: str, after: str, how: str = "inner") -> DataFrame:
    """Both sides watermarked; unmatched rows of outer joins come once their window has closed."""
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    near = F.expr(f"r_{ts} >= l_{ts} - INTERVAL {before} AND r_{ts} <= l_{ts} + INTERVAL {after}")
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & near, how)


def debounce(df: DataFrame, key: str, value: str, ts_ms: str, arrival: str, limit_ms: int) -> DataFrame:
    """Suppress until a time limit: a key's latest value is emitted before the record that
    finds the stream ``limit_ms`` past the key's first one; that record begins anew."""
    kind, value_kind = df.schema[key].dataType.simpleString(), df.schema[value].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(batches)).sort_values(arrival)
        for t, v in zip(rows[ts_ms].tolist(), rows[value].tolist(), strict=True):
            if first is not None and t >= first + limit_ms:
                out.append((k[0], last, t))
                first = None
            first, last = (t if first is None else first), v
        state.update((first, last))
        yield pd.DataFrame(out, columns=[key, value, "at_ms"])

    return df.filter(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {value} {value_kind}, at_ms long", f"first long, last {value_kind}", "append", GroupStateTimeout.NoTimeout)


def overflow(rows: Iterable[tuple], buffer: dict, cap: int, policy: str, dead: Callable[[tuple], None]) -> Iterator[tuple]:
    """What (key, value) updates in order push out of ``buffer``, which holds at most ``cap`` keys and is all the state.

    ``emit_early`` releases the oldest key, ``drop_oldest`` forgets it, ``dead_letter``
    diverts the newcomer, ``shutdown`` raises.  The cap is one for all keys, so it runs
    where one task holds the buffer.
    """
    for k, v in rows:
        if k in buffer or len(buffer) < cap:
            buffer[k] = v
            continue
        if policy == "shutdown":
            raise OverflowError(f"more than {cap} keys are held back")
        if policy == "dead_letter":
            dead((k, v))
            continue
        oldest = next(iter(buffer))
        gone = (oldest, buffer.pop(oldest))
        if policy == "emit_early":
            yield gone
        buffer[k] = v


def bounded_suppress(rows: list[tuple], cap: int, policy: str) -> tuple[list[tuple], list[tuple]]:
    """``overflow`` over a list, and the rest of the buffer at its end: (emitted, dead letters)."""
    buffer: dict = {}
    dead: list[tuple] = []
    emitted = list(overflow(rows, buffer, cap, policy, dead.append))
    return emitted + list(buffer.items()), dead


def two_phase_sink(path: str, register: Callable[[int], bool]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch is written under its id and then registered.

    ``register`` answers whether the id is new.  A batch that is run again overwrites
    its own files, so a crash between the phases leaves nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        register(batch_id)

    return write


def run_once(df: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None):
    """All that is there, in as many batches as the source makes, into files under ``path``: a folder for each batch."""
    w = df.writeStream.foreachBatch(two_phase_sink(path, lambda batch_id: True)).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return q


def drained(spark: SparkSession, df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What ``run_once`` leaves: every batch's rows or, in mode complete, those of the last batch."""
    schema = df.schema
    run_once(df, path, mode)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(f"{path}/batch=*")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")  # one row
    return rows.drop("batch")


class TwoPhaseSink:
    """Batches that are prepared, then committed or aborted, each by one move of a folder; recovery finishes what was begun.

    A batch committed twice is there once; one that was never prepared cannot be committed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _there(self, name: str) -> bool:
        files, path = self._fs(name)
        return files.exists(path)

    def prepare(self, batch_id: int, df: DataFrame) -> None:
        if not self._there(f"committed/batch={batch_id}"):
            df.write.mode("overwrite").parquet(f"{self.path}/pending/batch={batch_id}")

    def commit(self, batch_id: int) -> None:
        if self._there(f"committed/batch={batch_id}"):
            return
        if not self._there(f"pending/batch={batch_id}/_SUCCESS"):
            raise ValueError(f"batch {batch_id} was not prepared")
        files, target = self._fs(f"committed/batch={batch_id}")
        files.mkdirs(target.getParent())
        files.rename(self._fs(f"pending/batch={batch_id}")[1], target)

    def abort(self, batch_id: int) -> None:
        files, path = self._fs(f"pending/batch={batch_id}")
        files.delete(path, True)

    def recover(self, decided: Callable[[int], bool]) -> None:
        """Finish pending batches: committed where the transaction was, aborted otherwise."""
        files, path = self._fs("pending")
        for f in files.listStatus(path) if files.exists(path) else ():
            batch_id = int(f.getPath().getName().split("=")[1])
            if decided(batch_id) and self._there(f"pending/batch={batch_id}/_SUCCESS"):
                self.commit(batch_id)
            else:
                self.abort(batch_id)

    def read(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/committed").parquet(f"{self.path}/committed/batch=*").drop("batch")

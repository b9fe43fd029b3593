"""Windows over event time: bounds are half-open, in microseconds where numbers are used.

Records may come out of order; ``arrival`` says in which order they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str) -> DataFrame:
    """Rows with ``window_start`` and ``window_end``."""
    w = F.window(ts, size)
    return df.withColumn("_w", w).withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end")).drop("_w")


def hopping(df: DataFrame, ts_us: Column, size_us: int, advance_us: int) -> DataFrame:
    """A row for each window that holds the record; with advance > size there may be none.

    Windows start at multiples of the advance from 0 on.
    """
    low = F.greatest(F.ceil((ts_us - size_us + 1) / advance_us), F.lit(0)).cast("long")
    high = F.floor(ts_us / advance_us).cast("long")
    out = df.withColumn("_lo", low).withColumn("_hi", high).filter("_lo <= _hi")
    out = out.withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    return out.withColumn("start_us", F.col("_k") * advance_us).withColumn("end_us", F.col("_k") * advance_us + size_us).drop("_lo", "_hi", "_k")


def sliding_per_record(df: DataFrame, ts_us: Column, size_us: int) -> DataFrame:
    """The window that ends with the record: [t - size + 1, t + 1)."""
    return df.withColumn("start_us", ts_us - size_us + 1).withColumn("end_us", ts_us + 1)


def look_back(df: DataFrame, keys: list[str], ts_us: str, size_us: int, **aggs) -> DataFrame:
    """Aggregates over each record's true look-back window of the same key."""
    w = Window.partitionBy(*keys).orderBy(ts_us).rangeBetween(-(size_us - 1), 0)
    return df.withColumns({n: a.over(w) for n, a in aggs.items()})


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str, *aggs: Column) -> DataFrame:
    """Sessions of records no more than the gap apart; a session ends with its last record."""
    w = F.session_window(ts, gap).alias("_w")
    out = df.groupBy(*keys, w).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), *aggs)
    return out.drop("_w")


def touches(s1: Column, e1: Column, s2: Column, e2: Column, gap: int) -> Column:
    """Whether two sessions merge: they overlap once either is widened by the gap."""
    return (s1 <= e2 + gap) & (s2 <= e1 + gap)


def stream_time(ts: str, arrival: str, *partition: str) -> Column:
    """The greatest time seen so far, in order of arrival; it never goes back."""
    return F.max(ts).over(Window.partitionBy(*partition).orderBy(arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def drop_late(df: DataFrame, ts_us: str, arrival: str, size_us: int, grace_us: int, *partition: str) -> DataFrame:
    """Without the records that came after their time, size and grace had passed."""
    return df.withColumn("_now", stream_time(ts_us, arrival, *partition)).filter(F.col(ts_us) + size_us + grace_us >= F.col("_now")).drop("_now")


def emit_every(df: DataFrame, keys: list[str], arrival: str, n: int) -> DataFrame:
    """Every n-th record of a key, with ``n_seen``."""
    w = Window.partitionBy(*keys).orderBy(arrival)
    return df.withColumn("n_seen", F.row_number().over(w)).filter(F.col("n_seen") % max(1, n) == 0)


def closed(windows: DataFrame, end: str, now: Column, grace) -> DataFrame:
    """Windows that are final: their end and the grace have passed."""
    return windows.filter(F.col(end) + grace <= now)

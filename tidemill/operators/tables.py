"""Changelogs as tables: latest value per key, change data capture, versions, time to live, backfill.

A changelog is a DataFrame with key columns and an arrival column; which row came
last is decided by that column, never by the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(changes: DataFrame, keys: list[str], arrival: str, tombstone: Column | None = None) -> DataFrame:
    """The table that a changelog stands for: each key's last row, unless that deletes it.

    One aggregation with partial maxima; rows without a key are dropped.
    """
    rest = [c for c in changes.columns if c not in keys]
    for k in keys:
        changes = changes.filter(F.col(k).isNotNull())
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("_last"))
    out = last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))
    return out.filter(~F.coalesce(tombstone, F.lit(False))) if tombstone is not None else out


def compact_changes(changes: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """A batch of change events reduced to the last event of each key, deletes included."""
    return latest_per_key(changes, keys, arrival)


def apply_changes(changes: DataFrame, keys: list[str], arrival: str, op: str = "op", after: str = "after") -> DataFrame:
    """Insert and update put the row after the change; a delete, or no row after it, removes the key."""
    gone = (F.col(op) == "delete") | F.col(after).isNull()
    return latest_per_key(changes, keys, arrival, gone).drop(op)


def as_of(versions: DataFrame, probes: DataFrame, key: str, ts: str, at: str, value: str, how: str = "left") -> DataFrame:
    """Each probe with the value of the greatest version at or before its time.

    Both sides meet in one window by key, sorted by time with versions first: a
    shuffle and a sort, no row per pair.  ``how`` is left or inner.
    """
    cols = probes.columns
    side = versions.select(F.col(key), F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"), *(F.lit(None).cast(probes.schema[c].dataType).alias(f"_p_{c}") for c in cols))
    own = probes.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(side.schema["_v"].dataType).alias("_v"), *(F.col(c).alias(f"_p_{c}") for c in cols))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = side.unionByName(own).withColumn("_hit", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    if how == "inner":
        both = both.filter(F.col("_hit").isNotNull())
    return both.select(*(F.col(f"_p_{c}").alias(c) for c in cols), F.col("_hit.v").alias(value))


def version_history(versions: DataFrame, ts: str, low, high) -> DataFrame:
    """All versions with a time in the closed range."""
    return versions.filter(F.col(ts).between(low, high))


def visible(rows: DataFrame, ts: str, ttl: Column, now: Column) -> DataFrame:
    """Rows that have not expired at ``now``: written at ``ts``, they live for ``ttl``."""
    return rows.filter(F.col(ts) + ttl > now)


def backfill(snapshot: DataFrame, changes: DataFrame, keys: list[str], arrival: str, from_offset, tombstone: Column | None = None) -> DataFrame:
    """A snapshot overlaid with the changes from an offset on."""
    base = snapshot.withColumn(arrival, F.lit(None).cast(changes.schema[arrival].dataType))
    tail = changes.filter(F.col(arrival) >= from_offset)
    both = base.unionByName(tail.select(base.columns)).withColumn(arrival, F.coalesce(arrival, F.lit(-1).cast(changes.schema[arrival].dataType)))
    return latest_per_key(both, keys, arrival, tombstone)


def replay(log: DataFrame, ts: str, start, end, shift: Column | None = None) -> DataFrame:
    """Rows of the half-open range, moved in time if asked for."""
    out = log.filter((F.col(ts) >= start) & (F.col(ts) < end))
    return out.withColumn(ts, F.col(ts) + shift) if shift is not None else out


def grouped_table_agg(changes: DataFrame, keys: list[str], arrival: str, group: str, aggs: list[Column], zeros: dict[str, object], tombstone: Column | None = None) -> DataFrame:
    """Aggregates over a table's present rows by a column of theirs.

    A group that once had rows and has none now stays, with its zero values.
    """
    now = latest_per_key(changes, keys, arrival, tombstone).groupBy(group).agg(*aggs)
    ever = changes.filter(F.col(group).isNotNull()).select(group).distinct()
    return ever.join(now, group, "left").na.fill(zeros)

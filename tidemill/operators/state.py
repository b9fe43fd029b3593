"""State stores and timers as plans: what a store holds after a log of operations, and what timers see.

A log has a key, a column that orders its operations and the operations themselves.
Nothing is replayed row by row: the operation that decides a key's state is found by
aggregation, so a hot key costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_value(log: DataFrame, key: str, seq: str, op: str, value: str) -> DataFrame:
    """The keys and values after ``put``, ``put_if_absent`` and ``delete``; other operations do nothing.

    A key's last put or delete decides, unless that is a delete (or there is none): then
    the first ``put_if_absent`` behind it does.
    """
    log = log.filter(F.col(key).isNotNull()).select(key, seq, op, value)
    reset = log.filter(F.col(op).isin("put", "delete")).groupBy(key).agg(F.max(seq).alias("_at"), F.max_by(F.struct(op, value), F.col(seq)).alias("_last"))
    late = log.filter(F.col(op) == "put_if_absent").join(reset, key, "left").filter("_at IS NULL").unionByName(
        log.filter(F.col(op) == "put_if_absent").join(reset, key).filter(F.col(seq) > F.col("_at"))
    )
    first = late.groupBy(key).agg(F.min_by(F.struct(value), F.col(seq)).alias("_first"))
    both = reset.join(first, key, "full")
    put = F.col(f"_last.{op}") == "put"
    return both.filter(put | F.col("_first").isNotNull()).select(key, F.when(put, F.col(f"_last.{value}")).otherwise(F.col(f"_first.{value}")).alias(value))


def timestamped(log: DataFrame, keys: list[str], seq: str, ts: str, value: str) -> DataFrame:
    """Each key's latest value with its time."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(value, ts), F.col(seq)).alias("_l"))
    return last.select(*keys, f"_l.{value}", f"_l.{ts}")


def cached(log: DataFrame, key: str, seq: str, value: str, flush: Column) -> DataFrame:
    """What a write cache lets through: of a key's puts between two flushes only the last, tombstones (null values) too."""
    return log.withColumn("flush", flush).groupBy("flush", key).agg(F.max_by(value, seq).alias(value), F.count("*").alias("absorbed"))


def transactional(log: DataFrame, key: str, seq: str, value: str, txn: str, commits: DataFrame) -> DataFrame:
    """The table after the transactions in ``commits`` (txn, commit_seq): aborted and open ones leave nothing.

    Writes become visible at their commit, so the later commit wins and within it the later write.
    """
    done = log.join(commits, txn)
    return done.groupBy(key).agg(F.max_by(value, F.struct("commit_seq", seq)).alias(value))


def within_bounds(positions: DataFrame, bounds: DataFrame) -> DataFrame:
    """(partition, position, wanted, fresh): whether each partition of a store has come as far as a query asks for."""
    return bounds.join(positions, "partition", "left").select("partition", "position", "wanted", (F.coalesce("position", F.lit(-1)) >= F.col("wanted")).alias("fresh"))


def first_hit(instances: list[DataFrame], key: str, value: str) -> DataFrame:
    """One answer a key from several instances: that of the first one that has it."""
    every = None
    for i, t in enumerate(instances):
        part = t.select(key, value, F.lit(i).alias("instance"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.min_by(value, "instance").alias(value), F.min("instance").alias("instance"))


def retained(log: DataFrame, ts_us: str, retention_us: int) -> DataFrame:
    """Entries that a store still holds at the end: none older than the retention before stream time."""
    top = log.agg(F.max(ts_us).alias("_top"))
    return log.join(F.broadcast(top), F.col(ts_us) > F.col("_top") - retention_us).drop("_top")  # one row


def punctuations(log: DataFrame, key: str, seq: str, ts_us: str, every_us: int, cancel: Column | None = None) -> DataFrame:
    """(key, at_us, n): stream-time timers of each key, and the records it had seen when they fired.

    A timer fires with the record that takes the key's stream time (its running
    maximum) past the next multiple of the interval: once, however far it goes.  The
    first record starts the schedule.  Behind a record for which ``cancel`` holds nothing fires.
    """
    w = Window.partitionBy(key).orderBy(seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("_past", F.max(ts_us).over(before)).withColumn("_n", F.row_number().over(w).cast("long"))
    fires = F.col("_past").isNotNull() & (F.floor(F.col(ts_us) / every_us) > F.floor(F.col("_past") / every_us))
    if cancel is not None:
        rows = rows.withColumn("_off", F.coalesce(F.max(cancel.cast("int")).over(before), F.lit(0)))
        fires = fires & (F.col("_off") == 0)
    return rows.filter(fires).select(key, (F.floor(F.col(ts_us) / every_us) * every_us).cast("long").alias("at_us"), F.col("_n").alias("n"))


def combined_watermark(marks: DataFrame, now: Column, idle_after_us: int) -> DataFrame:
    """(source, watermark_us, idle, combined_us): the least watermark of the sources that are not idle."""
    rows = marks.withColumn("idle", F.col("seen_us") < now - idle_after_us)
    least = rows.agg(F.min(F.when(~F.col("idle"), F.col("watermark_us"))).alias("combined_us"))
    return rows.crossJoin(F.broadcast(least)).select("source", "watermark_us", "idle", "combined_us")  # one row

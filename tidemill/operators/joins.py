"""Joins of streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.tables import as_of, latest_per_key


class JoinWindow:
    """How far, in the unit of the time columns, the right record may lie before or after the left one."""

    def __init__(self, before, after, grace=0):
        if before + after < 0:
            raise ValueError("the window ends before it starts")
        self.before, self.after, self.grace = before, after, grace

    @classmethod
    def symmetric(cls, d, grace=0) -> JoinWindow:
        return cls(d, d, grace)

    #: An alias of the symmetric window; it has nothing to do with sliding aggregation.
    sliding = symmetric

    @classmethod
    def before_only(cls, d, grace=0) -> JoinWindow:
        return cls(d, 0, grace)

    @classmethod
    def after_only(cls, d, grace=0) -> JoinWindow:
        return cls(0, d, grace)


def stream_stream(left: DataFrame, right: DataFrame, key: str, ts: str, window: JoinWindow, how: str = "inner") -> DataFrame:
    """Equal keys, times within the window, bounds included; unmatched rows as ``how`` says.

    Columns of the sides are prefixed l_ and r_.  The equality on the key lets both
    sides be shuffled once; the range is a residual condition.
    """
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)).filter(F.col(f"l_{key}").isNotNull())
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).filter(F.col(f"r_{key}").isNotNull())
    near = (F.col(f"r_{ts}") >= F.col(f"l_{ts}") - window.before) & (F.col(f"r_{ts}") <= F.col(f"l_{ts}") + window.after)
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & near, how)


def stream_table(stream: DataFrame, changes: DataFrame, key: str, arrival: str, value: str, how: str = "inner") -> DataFrame:
    """Each stream record with the table's value when it arrived; misses go, or stay as null with left."""
    return as_of(changes, stream.filter(F.col(key).isNotNull()), key, arrival, arrival, value, how)


def table_table(left: DataFrame, right: DataFrame, key: str, arrival: str, how: str = "inner") -> DataFrame:
    """Latest with latest of two changelogs."""
    a, b = latest_per_key(left, [key], arrival).drop(arrival), latest_per_key(right, [key], arrival).drop(arrival)
    return a.join(b, key, how)


def foreign_key(left: DataFrame, right: DataFrame, left_key: str, fk: Column, right_key: str, arrival: str, how: str = "inner") -> DataFrame:
    """Latest rows of the left table with those of the right one that their foreign key names."""
    a = latest_per_key(left, [left_key], arrival).drop(arrival).withColumn("_fk", fk)
    b = latest_per_key(right, [right_key], arrival).drop(arrival)
    return a.join(b, F.col("_fk") == F.col(right_key), how).drop("_fk")


def global_table(stream: DataFrame, table: DataFrame, key: str, condition: Column, how: str = "inner", most_bytes: int = 64 << 20) -> DataFrame:
    """Stream against a replicated table: broadcast if the plan's size estimate allows, else shuffled.

    Records without a key are dropped, also with left.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    side = F.broadcast(table) if size <= most_bytes else table
    return stream.filter(F.col(key).isNotNull()).join(side, condition, how)


def without_positions(data: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows of files without those deleted by (file_path, pos)."""
    return data.join(deletes.select("file_path", "pos"), ["file_path", "pos"], "left_anti")


def without_equals(data: DataFrame, deletes: DataFrame, fields: list[str]) -> DataFrame:
    """Rows without those that equal a delete in all fields; null equals null."""
    d = deletes.select(*(F.col(f).alias(f"_d_{f}") for f in fields))
    on = F.lit(True)
    for f in fields:
        on = on & F.col(f).eqNullSafe(F.col(f"_d_{f}"))
    return data.join(d, on, "left_anti")

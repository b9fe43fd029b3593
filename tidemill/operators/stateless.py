"""Record-at-a-time transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def keep(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def keep_not(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of which the condition does not hold; one that is null does not hold."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def map_values(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def flat_map(df: DataFrame, values: Column, name: str) -> DataFrame:
    """A row for each element of an array expression; an empty one drops the row."""
    return df.withColumn(name, F.explode(values))


def select_key(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.withColumn(name, key)


def values_only(df: DataFrame, *keys: str) -> DataFrame:
    return df.drop(*keys)


def peek(df: DataFrame, observation: Observation, *metrics: Column) -> DataFrame:
    """The same rows; the metrics are taken as they pass."""
    return df.observe(observation, *metrics)


def merge(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def branch(df: DataFrame, branches: list[tuple[str, Column]], default: str | None = None, name: str = "branch") -> DataFrame:
    """Each row under the first branch whose condition holds; else the default, else dropped."""
    label = F.lit(default)
    for n, c in reversed(branches):
        label = F.when(F.coalesce(c, F.lit(False)), F.lit(n)).otherwise(label)
    return df.withColumn(name, label).filter(F.col(name).isNotNull())


def repartition_by(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def event_time(df: DataFrame, ts: str, policy: str, arrival: str) -> DataFrame:
    """Timestamps by policy; an unknown one is null (or -1 in long columns).

    ``fail`` raises, ``skip`` drops, ``partition_time`` takes the greatest seen so far.
    """
    from pyspark.sql import Window

    bad = F.col(ts).isNull()
    if policy == "skip":
        return df.filter(~bad)
    if policy == "fail":
        return df.withColumn(ts, F.when(bad, F.raise_error(F.lit("record without a timestamp")).cast(df.schema[ts].dataType)).otherwise(F.col(ts)))
    if policy == "partition_time":
        w = Window.orderBy(arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(ts, F.coalesce(F.col(ts), F.max(ts).over(w)))
    if policy == "wall_clock":
        return df.withColumn(ts, F.current_timestamp())
    raise ValueError(f"unknown policy {policy}")

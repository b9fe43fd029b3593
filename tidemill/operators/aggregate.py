"""Keyed aggregation; rows without a key are dropped, as a null group is not a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return keyed(df, *keys).groupBy(*keys).agg(F.count("*").alias(name))


def fold(df: DataFrame, keys: list[str], arrival: str, value: str, init: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """A fold in order of arrival for steps that are not commutative.

    A key's values are gathered in one row, so keys must be of bounded size; use the
    built-in aggregates (partial, spilling) wherever the step is associative.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(arrival), F.col(value).alias("v")))), lambda s: s["v"])
    return keyed(df, *keys).groupBy(*keys).agg(ordered.alias("_vs")).select(*keys, F.aggregate("_vs", init, step).alias(name))


def reduce(df: DataFrame, keys: list[str], arrival: str, value: str, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """A fold that the first value seeds."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(arrival), F.col(value).alias("v")))), lambda s: s["v"])
    vs = F.col("_vs")
    rest = F.slice(vs, 2, F.greatest(F.size(vs) - 1, F.lit(0)))
    return keyed(df, *keys).groupBy(*keys).agg(ordered.alias("_vs")).select(*keys, F.aggregate(rest, F.element_at(vs, 1), step).alias(name))


def changelog(df: DataFrame, keys: list[str], arrival: str, **aggs: Column) -> DataFrame:
    """One row for each record, with the running aggregates that it brings about."""
    w = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed(df, *keys).withColumns({n: a.over(w) for n, a in aggs.items()})


def cogroup(inputs: list[tuple[str, DataFrame]], key: str, value: str, aggs: Callable[[Callable[[str], Column]], list[Column]], *more: str) -> DataFrame:
    """Several streams folded into one accumulator: a tagged union and one aggregation.

    ``aggs`` gets a function from a stream's tag to its value column (null elsewhere).
    """
    both = None
    for tag, df in inputs:
        one = keyed(df, key).select(key, *more, F.lit(tag).alias("_tag"), F.col(value).alias("_v"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy(key, *more).agg(*aggs(lambda tag: F.when(F.col("_tag") == tag, F.col("_v"))))

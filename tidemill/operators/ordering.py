"""Sort orders of transformed fields; the declared place of nulls holds in either direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import transforms
from tidemill.sources import sinks


def order_columns(fields: list[tuple[str, str, str, str]]) -> list[Column]:
    """(transform, column, asc or desc, nulls first or last) as sort columns."""
    out = []
    for transform, column, direction, nulls in fields:
        c = transforms.apply(transform, F.col(column))
        out.append(getattr(c, f"{direction}_nulls_{nulls}")())
    return out


def sorted_by(df: DataFrame, fields: list[tuple[str, str, str, str]]) -> DataFrame:
    return df.orderBy(*order_columns(fields))


def numbered(df: DataFrame, fields: list[tuple[str, str, str, str]], name: str) -> DataFrame:
    """The rank in that order, from 1; rows that tie in every field are ranked in any order.

    The rows are dealt by range and sorted, and each task's ranks begin after the counts of
    the tasks before it.  They are written once: other ranges may come from another run.
    """
    spark, order, path = df.sparkSession, order_columns(fields), sinks.shared_path(df.sparkSession, "numbered")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_task", F.shiftright("_at", 33))
    begins, begin = [], 0
    for task, n in sorted(rows.groupBy("_task").count().collect()):  # a row a task
        begins.append((task, begin))
        begin += n
    begins = F.broadcast(spark.createDataFrame(begins, "_task long, _begin long"))
    rank = F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(begins, "_task").select(*df.columns, rank.alias(name))

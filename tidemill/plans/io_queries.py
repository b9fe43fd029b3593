"""Round trips through formats and sinks, and user-defined functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemill.plans.registry import query, table
from tidemill.sources import sinks


def round_trip(s, df, fmt, read=None, **options):
    path = sinks.shared_path(s, fmt)
    df.write.format(fmt).options(**options).save(path)
    return (read or s.read.schema(df.schema)).options(**options).format(fmt).load(path)


@query("s9_parquet_read", "SELECT * FROM nation")
def s9(s, d):
    return table(s, d, "nation")


@query("s9_parquet_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 300 AND l_returnflag = 'R'")
def s9b(s, d):
    return table(s, d, "lineitem").filter("l_orderkey BETWEEN 100 AND 300 AND l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@query("s12_orc_read", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100")
def s12(s, d):
    return round_trip(s, table(s, d, "customer").select("c_custkey", "c_name"), "orc").filter("c_custkey > 100")


@query("s16_csv_read", "SELECT c_custkey, c_name || ', \"x\"' AS c_name, c_acctbal FROM customer")
def s16(s, d):
    c = table(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("c_name"), "c_acctbal")
    return round_trip(s, c, "csv", header="true", quote='"', escape='"', multiLine="true")


@query("s16_tsv_read", "SELECT n_nationkey, n_name FROM nation")
def s16b(s, d):
    return round_trip(s, table(s, d, "nation").select("n_nationkey", "n_name"), "csv", sep="\t")


@query("s17_ndjson_read", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def s17(s, d):
    return round_trip(s, table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "json", mode="FAILFAST")


@query("s18_xml_read", "SELECT n_nationkey, n_name FROM nation")
def s18(s, d):
    return round_trip(s, table(s, d, "nation").select("n_nationkey", "n_name"), "xml", rowTag="nation", rootTag="nations")


@query("k2_dynamic_routing", "SELECT event_id, event_type AS topic FROM events WHERE event_type IN ('click', 'view')")
def k2(s, d):
    path = sinks.shared_path(s, "routed")
    sinks.route(table(s, d, "events").select("event_id", "event_type"), F.col("event_type"), path)
    return s.read.parquet(path).filter("topic IN ('click', 'view')").select("event_id", "topic")


@query("k3_partitioner", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def k3(s, d):
    return table(s, d, "events").repartition(6, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("k4_rotating_files", "SELECT event_id FROM events")
def k4(s, d):
    path = sinks.shared_path(s, "rotated")
    sinks.rotate(table(s, d, "events").select("event_id"), path, 300)
    return s.read.schema("event_id long").json(path)


@query("k7_parquet_options", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def k7(s, d):
    path = sinks.shared_path(s, "tuned")
    sinks.parquet(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), path, bloom=("o_orderkey",))
    return s.read.parquet(path).filter("o_orderkey = 77")


@query("k8_nested_parquet", "SELECT o_custkey, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1")
def k8(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("orders"))
    path = sinks.shared_path(s, "nested")
    sinks.parquet(o, path)
    return s.read.parquet(path).select("o_custkey", F.size("orders").alias("n"))


@query("k12_dead_letters", "SELECT event_id FROM events WHERE NOT coalesce(value <= 90, false)")
def k12(s, d):
    return sinks.split_dead_letters(table(s, d, "events").select("event_id", "value"), F.col("value") <= 90)[1].select("event_id")


@query("p15_async_enrichment", "SELECT event_id, user_id, user_id * 3 + 1 AS enriched FROM events WHERE user_id % 5 <> 0")
def p15(s, d):
    def call(x):
        if x % 5 == 0:
            raise ValueError(x)
        return x * 3 + 1

    return sinks.enrich(table(s, d, "events").select("event_id", "user_id"), "user_id", call, "enriched", "long", retries=1, on_failure="drop")


@query("u1_scalar_udf", "SELECT event_id, value * value AS v FROM events")
def u1(s, d):
    @F.pandas_udf("double")
    def square(v: pd.Series) -> pd.Series:
        return v * v

    return table(s, d, "events").select("event_id", square("value").alias("v"))


@query("u2_aggregate_udf", "SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY 1")
def u2(s, d):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return table(s, d, "events").groupBy("event_type").agg(spread("value").alias("spread"))


@query("u3_table_udf", "SELECT event_id, unnest(range(event_id % 3)) AS i FROM events")
def u3(s, d):
    def run(batches):
        for b in batches:
            n = b["event_id"] % 3
            yield pd.DataFrame({"event_id": b["event_id"].repeat(n), "i": [i for k in n for i in range(k)]})

    return table(s, d, "events").select("event_id").mapInPandas(run, "event_id long, i long")


@query("a9_pushed_aggregate", "SELECT count(*) AS n, max(l_orderkey) AS high FROM lineitem")
def a9(s, d):
    """Plain aggregates; with ``spark.sql.parquet.aggregatePushdown`` and the v2 reader they come from the footers."""
    return table(s, d, "lineitem").agg(F.count("*").alias("n"), F.max("l_orderkey").alias("high"))


def touching(events):
    from tidemill.operators import windows

    e = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a, b = (e.select(*(F.col(c).alias(f"{p}_{c}") for c in e.columns)) for p in "ab")
    on = (F.col("a_user_id") == F.col("b_user_id")) & (F.col("a_event_id") < F.col("b_event_id"))
    hit = windows.touches(F.col("a_us"), F.col("a_us"), F.col("b_us"), F.col("b_us"), 21_600_000_000)
    return a.join(b, on & hit).select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


@query("w7_sessions_touch", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000")
def w7(s, d):
    return touching(table(s, d, "events"))


def debounced(rows: pd.DataFrame) -> pd.DataFrame:
    first = last = None
    out = []
    for us, v in sorted(zip(rows["event_id"], zip(rows["us"], rows["value"], strict=True), strict=True)):
        us, v = v
        if first is not None and us >= first + 86_400_000_000:
            out.append((rows["user_id"].iloc[0], last, us))
            first = None
        first, last = us if first is None else first, v
    return pd.DataFrame(out, columns=["user_id", "value", "at_us"])


@query("w13_suppress_until_limit")
def w13(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.groupBy("user_id").applyInPandas(debounced, "user_id long, value double, at_us long")

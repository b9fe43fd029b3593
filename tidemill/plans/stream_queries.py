"""Queries over ``events`` as a stream (key user_id, time ts, order of arrival event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import aggregate, stateless, windows
from tidemill.plans.registry import query, table

HOUR = 3_600_000_000
#: Events shuffled deterministically: the order in which late data arrive.
LATE = "event_id % 97 * 1000000 + event_id"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def in_us(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def q(name: str, sql: str):
    """Register a query over events."""
    return query(name, sql)


@q("w1_tumbling_count", """SELECT event_type, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n
    FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2, 3""")
def w1(s, d):
    e = windows.tumbling(events(s, d), "ts", "1 hour")
    return aggregate.count(e, "event_type", "window_start", "window_end")


@q("p1_filter", "SELECT event_id, user_id, value FROM events WHERE value > 50")
def p1(s, d):
    return stateless.keep(events(s, d), F.col("value") > 50).select("event_id", "user_id", "value")


@q("p2_filter_not", "SELECT event_id, value FROM events WHERE NOT coalesce(value > 50, false)")
def p2(s, d):
    return stateless.keep_not(events(s, d), F.col("value") > 50).select("event_id", "value")


@q("p3_map_values", "SELECT event_id, value * 2 + 1 AS scaled, upper(event_type) AS kind FROM events")
def p3(s, d):
    e = stateless.map_values(events(s, d), scaled=F.col("value") * 2 + 1, kind=F.upper("event_type"))
    return e.select("event_id", "scaled", "kind")


@q("p4_map_key_value", "SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS key, value + 1 AS value FROM events")
def p4(s, d):
    return events(s, d).select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), (F.col("value") + 1).alias("value"))


@q("p5_flat_map", "SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> ''")
def p5(s, d):
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    return stateless.flat_map(table(s, d, "documents"), words, "word").select("doc_id", "word")


@q("p6_select_key", "SELECT event_id, event_type AS key, value FROM events")
def p6(s, d):
    return stateless.select_key(events(s, d), F.col("event_type")).select("event_id", "key", "value")


@q("p7_values", "SELECT value, props FROM events")
def p7(s, d):
    return stateless.values_only(events(s, d), "user_id", "event_id", "event_type", "ts").select("value", "props")


@q("p8_peek", "SELECT event_id, value FROM events")
def p8(s, d):
    from pyspark.sql import Observation

    return stateless.peek(events(s, d), Observation("peeked"), F.count(F.lit(1)).alias("rows")).select("event_id", "value")


@q("p9_merge", "SELECT event_id, user_id, 'buy' AS tag FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, user_id, 'see' AS tag FROM events WHERE event_type IN ('view', 'click')")
def p9(s, d):
    e = events(s, d)
    one = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.lit("buy").alias("tag"))
    return stateless.merge(one, e.filter("event_type IN ('view', 'click')").select("event_id", "user_id", F.lit("see").alias("tag")))


@q("p10_branch", """SELECT event_id, CASE WHEN value > 90 THEN 'high' WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'middle' END AS branch
    FROM events WHERE value > 90 OR event_type = 'error' OR value > 50""")
def p10(s, d):
    v = F.col("value")
    return stateless.branch(events(s, d), [("high", v > 90), ("error", F.col("event_type") == "error"), ("middle", v > 50)]).select("event_id", "branch")


@q("p10_branch_default", "SELECT CASE WHEN value > 90 THEN 'high' ELSE 'rest' END AS branch, count(*) AS n FROM events GROUP BY 1")
def p10b(s, d):
    return aggregate.count(stateless.branch(events(s, d), [("high", F.col("value") > 90)], "rest"), "branch")


@q("p11_repartition", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def p11(s, d):
    return aggregate.count(stateless.repartition_by(events(s, d), 8, "user_id"), "user_id")


@q("p16_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def p16(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_quantity")


@q("s4_consume_from_offset", "SELECT event_id, ts FROM events WHERE event_id >= 500")
def s4(s, d):
    return events(s, d).filter("event_id >= 500").select("event_id", "ts")


@q("s5_partition_time", """SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN ts END, max(CASE WHEN event_id % 7 <> 0 THEN ts END)
      OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS ts FROM events""")
def s5(s, d):
    from pyspark.sql import Window

    bad = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(s, d).withColumn("t", bad).select("event_id", F.coalesce("t", F.max("t").over(w)).alias("ts"))


@q("s5_skip_invalid", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events WHERE event_id % 7 <> 0")
def s5b(s, d):
    e = events(s, d).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    return stateless.event_time(e, "ts", "skip", "event_id")


@q("a1_group_by", "SELECT event_type, sum(value) AS total FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def a1(s, d):
    return aggregate.keyed(events(s, d), "event_type").groupBy("event_type").agg(F.sum("value").alias("total")).select("event_type", "total")


@q("a2_count", "SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def a2(s, d):
    return aggregate.count(events(s, d), "user_id")


@q("a3_reduce", "SELECT user_id, max(value) AS top, min(event_id) AS first_id FROM events GROUP BY 1")
def a3(s, d):
    return aggregate.keyed(events(s, d), "user_id").groupBy("user_id").agg(F.max("value").alias("top"), F.min("event_id").alias("first_id"))


@q("a3_reduce_ordered", "SELECT user_id, string_agg(event_type, '>' ORDER BY event_id) AS path FROM events GROUP BY 1")
def a3b(s, d):
    return aggregate.reduce(events(s, d), ["user_id"], "event_id", "event_type", lambda a, b: F.concat(a, F.lit(">"), b), "path")


@q("a4_aggregate", "SELECT user_id, string_agg(left(event_type, 1), '' ORDER BY event_id) AS path FROM events GROUP BY 1")
def a4(s, d):
    return aggregate.fold(events(s, d), ["user_id"], "event_id", "event_type", F.lit(""), lambda acc, v: F.concat(acc, F.substring(v, 1, 1)), "path")


@q("a5_changelog", """SELECT event_id, user_id, count(*) OVER w AS n, max(value) OVER w AS top FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def a5(s, d):
    return aggregate.changelog(events(s, d), ["user_id"], "event_id", n=F.count("*"), top=F.max("value")).select("event_id", "user_id", "n", "top")


@q("a7_cogroup", """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, coalesce(max(value) FILTER (WHERE event_type = 'purchase'), 0) AS top_purchase
    FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1""")
def a7(s, d):
    e = events(s, d)
    sides = [(t, e.filter(F.col("event_type") == t)) for t in ("click", "purchase")]
    return aggregate.cogroup(sides, "user_id", "value", lambda v: [F.count(v("click")).alias("clicks"), F.coalesce(F.max(v("purchase")), F.lit(0.0)).alias("top_purchase")])


@q("a8_windowed_cogroup", """SELECT user_id, date_trunc('day', ts) AS window_start, count(*) FILTER (WHERE event_type = 'click') AS clicks,
    count(*) FILTER (WHERE event_type = 'view') AS views FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""")
def a8(s, d):
    e = windows.tumbling(events(s, d), "ts", "1 day")
    sides = [(t, e.filter(F.col("event_type") == t)) for t in ("click", "view")]
    return aggregate.cogroup(sides, "user_id", "value", lambda v: [F.count(v("click")).alias("clicks"), F.count(v("view")).alias("views")], "window_start")


@q("a9_count_star", "SELECT count(*) AS n FROM lineitem")
def a9(s, d):
    return table(s, d, "lineitem").agg(F.count("*").alias("n"))


@q("a10_count_column", "SELECT count(l_shipdate) AS n, count(l_tax) AS m FROM lineitem")
def a10(s, d):
    return table(s, d, "lineitem").agg(F.count("l_shipdate").alias("n"), F.count("l_tax").alias("m"))


@q("a11_min_max", "SELECT min(l_orderkey) AS low, max(l_orderkey) AS high, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line FROM lineitem")
def a11(s, d):
    return table(s, d, "lineitem").agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"))


@q("a12_sum", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem")
def a12(s, d):
    return table(s, d, "lineitem").agg(F.sum("l_linenumber").alias("total"), F.sum("l_orderkey").alias("keys"))


@query("a13_distinct_estimate")
def a13(s, d):
    return table(s, d, "lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_count_distinct("l_suppkey").alias("suppliers"))


@q("a15_lag_report", """WITH t AS (SELECT event_type AS task, max(event_id) AS o FROM events GROUP BY 1), e AS (SELECT max(event_id) AS last_o FROM events)
    SELECT task, last_o - o AS lag, CASE WHEN last_o - o = 0 THEN 'none' WHEN last_o - o < 5 THEN 'minor' ELSE 'major' END AS severity, max(last_o - o) OVER () AS max_lag,
    CAST(sum(last_o - o) OVER () AS BIGINT) AS total_lag FROM t, e""")
def a15(s, d):
    from pyspark.sql import Window

    at = events(s, d).groupBy(F.col("event_type").alias("task")).agg(F.max("event_id").alias("at"))
    every = Window.partitionBy()  # a row a task
    lag = F.max("at").over(every) - F.col("at")
    out = at.select("task", lag.alias("lag"))
    severity = F.when(F.col("lag") == 0, "none").when(F.col("lag") < 5, "minor").otherwise("major")
    return out.select("task", "lag", severity.alias("severity"), F.max("lag").over(every).alias("max_lag"), F.sum("lag").over(every).alias("total_lag"))


_HOP = """SELECT event_type, k * {a} AS start_us, k * {a} + {s} AS end_us, count(*) AS n FROM (
      SELECT event_type, unnest(range(greatest(CAST(ceil((epoch_us(ts) - {s} + 1) / {a}) AS BIGINT), 0), epoch_us(ts) // {a} + 1)) AS k FROM events) GROUP BY ALL"""


@q("w2_hopping_count", _HOP.format(s=2 * HOUR, a=HOUR // 2))
def w2(s, d):
    return aggregate.count(windows.hopping(in_us(s, d), F.col("us"), 2 * HOUR, HOUR // 2), "event_type", "start_us", "end_us")


@q("w2_hopping_with_gaps", _HOP.format(s=HOUR, a=3 * HOUR))
def w2b(s, d):
    return aggregate.count(windows.hopping(in_us(s, d), F.col("us"), HOUR, 3 * HOUR), "event_type", "start_us", "end_us")


@q("w3_sliding_per_record", f"SELECT user_id, epoch_us(ts) - {HOUR} + 1 AS start_us, epoch_us(ts) + 1 AS end_us, count(*) AS n FROM events GROUP BY ALL")
def w3(s, d):
    return aggregate.count(windows.sliding_per_record(in_us(s, d), F.col("us"), HOUR), "user_id", "start_us", "end_us")


@q("w3_look_back", f"""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW) AS n FROM events""")
def w3b(s, d):
    return windows.look_back(in_us(s, d), ["user_id"], "us", 24 * HOUR, n=F.count("*")).select("event_id", "user_id", "n")


@q("w4_unlimited", "SELECT user_id, epoch_us(ts) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def w4(s, d):
    return aggregate.count(in_us(s, d).withColumn("start_us", F.col("us")), "user_id", "start_us")


_SESSIONS = """WITH b AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM b)
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, {agg} FROM g GROUP BY user_id, g{having}"""


@q("w5_session_count", _SESSIONS.format(agg="count(*) AS n", having=""))
def w5(s, d):
    return windows.sessions(events(s, d), ["user_id"], "ts", "6 hours", F.count("*").alias("n"))


@q("w6_session_bounds", _SESSIONS.format(agg="max(value) AS top", having=" HAVING count(*) > 1"))
def w6(s, d):
    out = windows.sessions(events(s, d), ["user_id"], "ts", "6 hours", F.max("value").alias("top"), F.count("*").alias("n"))
    return out.filter("n > 1").drop("n")


@q("w5_busy_sessions", _SESSIONS.format(agg="count(*) AS n", having=" HAVING count(*) >= 4"))
def w5b(s, d):
    return windows.sessions(events(s, d), ["user_id"], "ts", "6 hours", F.count("*").alias("n")).filter("n >= 4")


@q("w8_windowed_aggregate", """SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS n, max(value) AS top, min(value) AS low,
    string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) AS users FROM events GROUP BY 1, 2""")
def w8(s, d):
    e = windows.tumbling(events(s, d), "ts", "1 day")
    order = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "user_id"))), lambda x: x["user_id"].cast("string"))
    return e.groupBy("event_type", "window_start").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.min("value").alias("low"), F.array_join(order, ",").alias("users"))


_LATE_SQL = f"(event_id % 97 * 1000000 + event_id)"


@q("w9_grace_drop", f"""WITH a AS (SELECT *, epoch_us(ts) AS us, max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY {_LATE_SQL} ROWS UNBOUNDED PRECEDING) AS now FROM events)
    SELECT user_id, us // {HOUR} * {HOUR} AS start_us, count(*) AS n FROM a WHERE us + {HOUR} + {200 * HOUR} >= now GROUP BY 1, 2""")
def w9(s, d):
    e = in_us(s, d).withColumn("arrival", F.expr(LATE))
    kept = windows.drop_late(e, "us", "arrival", HOUR, 200 * HOUR, "user_id")
    return aggregate.count(kept.withColumn("start_us", F.floor(F.col("us") / HOUR).cast("long") * HOUR), "user_id", "start_us")


@q("w10_emit_on_update", f"""SELECT event_id, event_type, epoch_us(ts) // {24 * HOUR} * {24 * HOUR} AS start_us,
    count(*) OVER (PARTITION BY event_type, epoch_us(ts) // {24 * HOUR} ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events""")
def w10(s, d):
    e = in_us(s, d).withColumn("start_us", F.floor(F.col("us") / (24 * HOUR)).cast("long") * 24 * HOUR)
    return aggregate.changelog(e, ["event_type", "start_us"], "event_id", n=F.count("*")).select("event_id", "event_type", "start_us", "n")


@q("w11_emit_every_n", "SELECT event_id, user_id, n AS n_seen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 5 = 0")
def w11(s, d):
    return windows.emit_every(events(s, d), ["user_id"], "event_id", 5).select("event_id", "user_id", F.col("n_seen").cast("long").alias("n_seen"))


@q("w12_suppress_until_close", """WITH w AS (SELECT event_type, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY 1, 2, 3)
    SELECT * FROM w WHERE window_end + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""")
def w12(s, d):
    e = windows.tumbling(events(s, d), "ts", "1 day")
    w = e.groupBy("event_type", "window_start", "window_end").agg(F.count("*").alias("n"))
    now = events(s, d).agg(F.max("ts").alias("now"))
    return windows.closed(w.join(F.broadcast(now)), "window_end", F.col("now"), F.expr("INTERVAL 6 HOURS")).drop("now")  # one row


@q("w15_stream_time", f"SELECT event_id, max(ts) OVER (PARTITION BY user_id ORDER BY {_LATE_SQL} ROWS UNBOUNDED PRECEDING) AS stream_time FROM events")
def w15(s, d):
    e = events(s, d).withColumn("arrival", F.expr(LATE))
    return e.select("event_id", windows.stream_time("ts", "arrival", "user_id").alias("stream_time"))


@q("w16_bounded_out_of_orderness", f"""SELECT event_id, max(ts) OVER (PARTITION BY user_id ORDER BY {_LATE_SQL} ROWS UNBOUNDED PRECEDING) - INTERVAL 10 MINUTE AS watermark FROM events""")
def w16(s, d):
    e = events(s, d).withColumn("arrival", F.expr(LATE))
    return e.select("event_id", (windows.stream_time("ts", "arrival", "user_id") - F.expr("INTERVAL 10 MINUTES")).alias("watermark"))


@q("w17_min_of_sources", "SELECT min(t) AS watermark FROM (SELECT event_type, max(ts) AS t FROM events GROUP BY 1)")
def w17(s, d):
    return events(s, d).groupBy("event_type").agg(F.max("ts").alias("t")).agg(F.min("t").alias("watermark"))


@q("w18_windowed_key", "SELECT event_type || '@' || CAST(epoch_us(date_trunc('hour', ts)) AS VARCHAR) AS windowed_key, count(*) AS n FROM events GROUP BY 1")
def w18(s, d):
    e = windows.tumbling(events(s, d), "ts", "1 hour")
    key = F.concat(F.col("event_type"), F.lit("@"), F.unix_micros(F.col("window_start").cast("timestamp")).cast("string"))
    return aggregate.count(e.withColumn("windowed_key", key), "windowed_key")


@q("o3_top_articles", """WITH w AS (SELECT event_type, date_trunc('day', ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY 1, 2, 3)
    SELECT event_type, window_start, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type, window_start ORDER BY n DESC, user_id) AS r FROM w) WHERE r <= 3""")
def o3(s, d):
    from pyspark.sql import Window

    w = windows.tumbling(events(s, d), "ts", "1 day").groupBy("event_type", "window_start", "user_id").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("event_type", "window_start").orderBy(F.col("n").desc(), "user_id"))
    return w.withColumn("r", r).filter("r <= 3").drop("r")


@q("x_word_count", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY 1")
def word_count(s, d):
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    return aggregate.count(stateless.flat_map(table(s, d, "conversations"), words, "word"), "word")

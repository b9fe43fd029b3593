"""State stores, timers, retention and watermark coordination over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import state
from tidemill.plans.registry import query, table


def events(s, d):
    return table(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


_OP = "CASE event_type WHEN 'purchase' THEN 'put' WHEN 'click' THEN 'put_if_absent' WHEN 'error' THEN 'delete' ELSE 'get' END"


@query("i6_key_value_store", f"""WITH l AS (SELECT user_id, event_id, value, {_OP} AS op FROM events WHERE user_id IS NOT NULL),
    r AS (SELECT user_id, max(event_id) AS at_id, arg_max(op, event_id) AS op, arg_max(value, event_id) AS value FROM l WHERE op IN ('put', 'delete') GROUP BY 1),
    f AS (SELECT l.user_id, arg_min(l.value, l.event_id) AS value FROM l LEFT JOIN r ON l.user_id = r.user_id WHERE l.op = 'put_if_absent' AND l.event_id > coalesce(r.at_id, -1) GROUP BY 1)
    SELECT coalesce(r.user_id, f.user_id) AS user_id, CASE WHEN r.op = 'put' THEN r.value ELSE f.value END AS value FROM r FULL JOIN f ON r.user_id = f.user_id WHERE r.op = 'put' OR f.user_id IS NOT NULL""")
def i6(s, d):
    return state.key_value(events(s, d).withColumn("op", F.expr(_OP)), "user_id", "event_id", "op", "value")


@query("i6_range_reverse", "SELECT user_id, count(*) AS n FROM events WHERE user_id BETWEEN 20 AND 60 GROUP BY 1 ORDER BY user_id DESC")
def i6r(s, d):
    return events(s, d).filter("user_id BETWEEN 20 AND 60").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("user_id"))


@query("i9_timestamped_store", "SELECT user_id, arg_max(value, event_id) AS value, arg_max(epoch_us(ts), event_id) AS us FROM events GROUP BY 1")
def i9(s, d):
    return state.timestamped(events(s, d), ["user_id"], "event_id", "us", "value")


@query("i9_timestamped_window", "SELECT user_id, epoch_us(ts) // 86400000000 AS day, arg_max(value, event_id) AS value, arg_max(epoch_us(ts), event_id) AS us FROM events GROUP BY 1, 2")
def i9w(s, d):
    return state.timestamped(events(s, d).withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("long")), ["user_id", "day"], "event_id", "us", "value")


@query("i10_caching_store", """SELECT event_id // 100 AS flush, user_id, arg_max(v, event_id) AS value, count(*) AS absorbed
    FROM (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN -1 ELSE value END AS v FROM events) GROUP BY 1, 2""")
def i10(s, d):
    e = events(s, d).withColumn("value", F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.col("value")))
    return state.cached(e, "user_id", "event_id", "value", F.floor(F.col("event_id") / 100).cast("long"))


@query("i11_transactions", """WITH c AS (SELECT event_id // 10 AS txn, event_id AS commit_seq FROM events WHERE event_id % 10 = 9 AND event_type <> 'error')
    SELECT user_id, arg_max(value, event_id) AS value FROM events JOIN c ON event_id // 10 = txn GROUP BY 1""")
def i11(s, d):
    e = events(s, d).withColumn("txn", F.floor(F.col("event_id") / 10).cast("long"))
    commits = e.filter("event_id % 10 = 9 AND event_type <> 'error'").select("txn", F.col("event_id").alias("commit_seq"))
    return state.transactional(e, "user_id", "event_id", "value", "txn", commits)


@query("i4_position_bounds", """SELECT p.partition, position, wanted, position >= wanted AS fresh FROM (SELECT event_id % 4 AS partition, max(event_id) AS position FROM events GROUP BY 1) p
    JOIN (VALUES (0, 100), (1, 5000000), (3, 0)) b(partition, wanted) ON p.partition = b.partition""")
def i4(s, d):
    positions = events(s, d).groupBy((F.col("event_id") % 4).alias("partition")).agg(F.max("event_id").alias("position"))
    return state.within_bounds(positions, s.createDataFrame([(0, 100), (1, 5_000_000), (3, 0)], "partition long, wanted int"))


_INSTANCES = ("click", "purchase", "view")


@query("i5_first_hit", """WITH t AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS instance, arg_max(value, event_id) AS value
    FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1, 2) SELECT user_id, arg_min(value, instance) AS value, min(instance) AS instance FROM t GROUP BY 1""")
def i5(s, d):
    e = events(s, d)
    own = [e.filter(F.col("event_type") == t).groupBy("user_id").agg(F.max_by("value", "event_id").alias("value")) for t in _INSTANCES]
    return state.first_hit(own, "user_id", "value")


@query("w20_retention", "SELECT event_id FROM events WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - 2 * 86400000000")
def w20(s, d):
    """Two days: the default of windows of one day."""
    return state.retained(events(s, d), "us", 2 * 86_400_000_000).select("event_id")


_FIRES = """WITH p AS (SELECT *, epoch_us(ts) AS us, max(epoch_us(ts)) OVER w AS past, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
    coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w, 0) AS stopped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, us // 86400000000 * 86400000000 AS at_us, n FROM p WHERE past IS NOT NULL AND us // 86400000000 > past // 86400000000{}"""


@query("w19_punctuator", _FIRES.format(""))
def w19(s, d):
    return state.punctuations(events(s, d), "user_id", "event_id", "us", 86_400_000_000)


@query("w19_cancelled_punctuator", _FIRES.format(" AND stopped = 0"))
def w19c(s, d):
    return state.punctuations(events(s, d), "user_id", "event_id", "us", 86_400_000_000, F.col("event_type") == "error")


@query("w17_idle_sources", """WITH m AS (SELECT event_type AS source, max(epoch_us(ts)) AS seen_us, max(epoch_us(ts)) - 3600000000 AS watermark_us FROM events WHERE event_type <> 'error' OR event_id < 300 GROUP BY 1),
    r AS (SELECT *, seen_us < (SELECT max(seen_us) FROM m) - 86400000000 AS idle FROM m) SELECT source, watermark_us, idle, (SELECT min(watermark_us) FROM r WHERE NOT idle) AS combined_us FROM r""")
def w17(s, d):
    """A source that falls silent (errors, behind the 300th event) holds nothing back."""
    e = events(s, d).filter("event_type <> 'error' OR event_id < 300")
    marks = e.groupBy(F.col("event_type").alias("source")).agg(F.max("us").alias("seen_us"), (F.max("us") - 3_600_000_000).alias("watermark_us"))
    top = marks.agg(F.max("seen_us").alias("now_us"))
    return state.combined_watermark(marks.crossJoin(F.broadcast(top)), F.col("now_us"), 86_400_000_000)


_CLOSED = "SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) AS n FROM events GROUP BY 1, 2 HAVING epoch_us(max(ts)) // 3600000000 * 3600000000 + 3600000000 + {grace} <= (SELECT max(epoch_us(ts)) FROM events)"


@query("w10_emit_on_close", _CLOSED.format(grace=600_000_000))
def w10(s, d):
    """Only windows that stream time has closed, ten minutes of grace included."""
    start = (F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000).cast("long")
    top = events(s, d).agg(F.max("us").alias("top"))
    w = events(s, d).groupBy("event_type", start.alias("start_us")).agg(F.count("*").alias("n"))
    return w.join(F.broadcast(top), F.col("start_us") + 3_600_000_000 + 600_000_000 <= F.col("top")).drop("top")  # one row


@query("w16_watermark_strategies", """SELECT event_id, max(epoch_us(ts)) OVER w AS ascending_us, max(epoch_us(ts)) OVER w - 7200000000 AS bounded_us, CAST(NULL AS BIGINT) AS none_us
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w16(s, d):
    from pyspark.sql import Window

    top = F.max("us").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lags = {"ascending_us": 0, "bounded_us": 7_200_000_000}
    return events(s, d).select("event_id", *((top - lag).alias(n) for n, lag in lags.items()), F.lit(None).cast("long").alias("none_us"))


@query("i17_continue_on_bad_records", "SELECT event_id, user_id * 2 AS twice FROM events WHERE event_type <> 'error'")
def i17(s, d):
    """Records that cannot be read are left out and the rest goes on; ``fail`` would raise."""
    raw = table(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit("x?")).otherwise(F.col("user_id").cast("string")).alias("raw"))
    return raw.withColumn("n", F.expr("try_cast(raw AS BIGINT)")).filter("n IS NOT NULL").select("event_id", (F.col("n") * 2).alias("twice"))


@query("u6_custom_policy", "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 3 = 0 OR n = 1")
def u6(s, d):
    """An emit policy of the user's: a key's first update and every third."""
    from pyspark.sql import Window

    policy = lambda n: (n % 3 == 0) | (n == 1)
    e = events(s, d).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return e.filter(policy(F.col("n"))).select("user_id", "event_id", "n")

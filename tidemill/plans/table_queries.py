"""Queries over changelogs as tables, joins, stored-state lookups and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import joins, ordering, tables
from tidemill.plans.registry import query, table

MINUTE = 60_000_000


def events(s, d):
    return table(s, d, "events")


_LATEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"


def latest(s, d, *columns):
    return tables.latest_per_key(events(s, d).select("user_id", "event_id", *columns), ["user_id"], "event_id")


@query("s2_table_source", _LATEST)
def s2(s, d):
    return latest(s, d, "event_type", "value")


@query("p12_to_table", f"SELECT user_id, event_type FROM ({_LATEST})")
def p12(s, d):
    return latest(s, d, "event_type").select("user_id", "event_type")


@query("p13_table_filter", f"SELECT user_id, value FROM ({_LATEST}) WHERE value > 30")
def p13(s, d):
    return latest(s, d, "value").filter("value > 30").select("user_id", "value")


@query("p13_table_filter_not", f"SELECT user_id, value FROM ({_LATEST}) WHERE NOT (value > 30)")
def p13b(s, d):
    return latest(s, d, "value").filter("NOT value > 30").select("user_id", "value")


@query("p14_table_map_values", f"SELECT user_id, value * 10 AS value FROM ({_LATEST})")
def p14(s, d):
    return latest(s, d, "value").select("user_id", (F.col("value") * 10).alias("value"))


def backfilled(s, d, offset):
    e = events(s, d).select("user_id", "event_type", "event_id")
    snapshot = tables.latest_per_key(e.filter(F.col("event_id") < offset), ["user_id"], "event_id").drop("event_id")
    return tables.backfill(snapshot, e, ["user_id"], "event_id", offset)


@query("s7_backfill", """SELECT user_id, arg_max(event_type, event_id) AS event_type, CASE WHEN max(event_id) >= 600 THEN max(event_id) ELSE -1 END AS event_id FROM events GROUP BY 1""")
def s7(s, d):
    return backfilled(s, d, 600)


@query("s8_replay", "SELECT event_id, ts + INTERVAL 1 HOUR AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def s8(s, d):
    return tables.replay(events(s, d).select("event_id", "ts"), "ts", F.expr("TIMESTAMP_NTZ '2024-01-05'"), F.expr("TIMESTAMP_NTZ '2024-01-06'"), F.expr("INTERVAL 1 HOUR"))


_CDC = "(SELECT event_id AS seq, user_id, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'insert' ELSE 'update' END AS op, CASE WHEN event_type <> 'error' THEN value END AS after FROM events)"


def cdc(s, d):
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return events(s, d).select(F.col("event_id").alias("seq"), "user_id", op.alias("op"), F.when(F.col("event_type") != "error", F.col("value")).alias("after"))


@query("i14_cdc_apply", f"SELECT user_id, seq, after FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM {_CDC}) WHERE r = 1 AND op <> 'delete' AND after IS NOT NULL")
def i14(s, d):
    return tables.apply_changes(cdc(s, d), ["user_id"], "seq").select("user_id", "seq", "after")


@query("a16_cdc_compaction", f"SELECT user_id, seq, op, after FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM {_CDC}) WHERE r = 1")
def a16(s, d):
    return tables.compact_changes(cdc(s, d), ["user_id"], "seq")


@query("s6_cdc_snapshot_phase", f"SELECT op, count(*) AS n, count(after) AS with_row FROM {_CDC} GROUP BY 1")
def s6(s, d):
    return cdc(s, d).groupBy("op").agg(F.count("*").alias("n"), F.count("after").alias("with_row"))


@query("a6_table_aggregate", """WITH l AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)
    SELECT event_type, count(user_id) AS n, coalesce(max(value), 0) AS top FROM (SELECT DISTINCT event_type FROM events) LEFT JOIN l USING (event_type) GROUP BY 1""")
def a6(s, d):
    e = events(s, d).select("user_id", "event_type", "value", "event_id")
    return tables.grouped_table_agg(e, ["user_id"], "event_id", "event_type", [F.count("*").alias("n"), F.max("value").alias("top")], {"n": 0, "top": 0.0})


@query("i1_key_query", f"SELECT * FROM ({_LATEST}) WHERE user_id = 7")
def i1(s, d):
    return s2(s, d).filter("user_id = 7")


@query("i1_range_query", f"SELECT * FROM ({_LATEST}) WHERE user_id BETWEEN 3 AND 20 ORDER BY user_id")
def i1b(s, d):
    return s2(s, d).filter("user_id BETWEEN 3 AND 20").orderBy("user_id")


@query("i1_count_query", f"SELECT count(*) AS n FROM ({_LATEST})")
def i1c(s, d):
    return s2(s, d).agg(F.count("*").alias("n"))


@query("i2_window_range_query", """SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS n FROM events
    WHERE date_trunc('day', ts) BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09' AND user_id = 5 GROUP BY 1, 2""")
def i2(s, d):
    from tidemill.operators import windows

    w = windows.tumbling(events(s, d), "ts", "1 day").groupBy("user_id", "window_start").agg(F.count("*").alias("n"))
    return w.filter("user_id = 5 AND window_start BETWEEN TIMESTAMP_NTZ '2024-01-03' AND TIMESTAMP_NTZ '2024-01-09'")


@query("i3_multi_version_query", "SELECT user_id, ts, value FROM events WHERE user_id = 5 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-12' ORDER BY ts")
def i3(s, d):
    e = events(s, d).filter("user_id = 5").select("user_id", "ts", "value")
    return tables.version_history(e, "ts", F.expr("TIMESTAMP_NTZ '2024-01-03'"), F.expr("TIMESTAMP_NTZ '2024-01-12'")).orderBy("ts")


@query("i7_versioned_as_of", """SELECT user_id, max_by(value, event_id) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1""")
def i7(s, d):
    return events(s, d).filter("ts <= TIMESTAMP_NTZ '2024-01-15'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@query("i8_ttl", """SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1
    AND ts + INTERVAL 2 DAY > TIMESTAMP '2024-01-30'""")
def i8(s, d):
    return tables.visible(latest(s, d, "ts"), "ts", F.expr("INTERVAL 2 DAYS"), F.expr("TIMESTAMP_NTZ '2024-01-30'"))


_SS = """SELECT l.event_id AS l_event_id, r.event_id AS r_event_id, coalesce(l.user_id, r.user_id) AS user_id
    FROM (SELECT * FROM events WHERE event_type = 'click') l {how} JOIN (SELECT * FROM events WHERE event_type = 'purchase') r
    ON l.user_id = r.user_id AND r.ts >= l.ts - INTERVAL {b} MINUTE AND r.ts <= l.ts + INTERVAL {a} MINUTE"""


def stream_join(s, d, before, after, how):
    e = events(s, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", "user_id", "us", "event_type")
    out = joins.stream_stream(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", "us", joins.JoinWindow(before * MINUTE, after * MINUTE), how)
    return out.select("l_event_id", "r_event_id", F.coalesce("l_user_id", "r_user_id").alias("user_id"))


for _name, _how, _b, _a in (
    ("j1_stream_stream_inner", "inner", 600, 900),
    ("j2_stream_stream_left", "left", 600, 900),
    ("j2_stream_stream_outer", "full", 600, 900),
    ("j3_before_only", "inner", 900, 0),
    ("j3_after_only", "inner", 0, 900),
    ("j3_symmetric", "inner", 700, 700),
):
    query(_name, _SS.format(how=_how, b=_b, a=_a))(lambda s, d, b=_b, a=_a, how=_how: stream_join(s, d, b, a, how))

_ASOF = """SELECT s.event_id, s.user_id, t.value FROM (SELECT * FROM events WHERE event_type = 'click') s ASOF {how} JOIN
    (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase') t ON s.user_id = t.user_id AND s.event_id >= t.event_id"""


def stream_table(s, d, how):
    e = events(s, d)
    changes = e.filter("event_type = 'purchase'").select("user_id", "event_id", "value")
    return joins.stream_table(e.filter("event_type = 'click'").select("event_id", "user_id"), changes, "user_id", "event_id", "value", how)


query("j4_stream_table_inner", _ASOF.format(how=""))(lambda s, d: stream_table(s, d, "inner"))
query("j5_stream_table_left", _ASOF.format(how="LEFT"))(lambda s, d: stream_table(s, d, "left"))
query("j12_as_of", """SELECT o.o_orderkey, o.o_custkey, e.value FROM orders o ASOF LEFT JOIN (SELECT user_id, event_id, value FROM events) e ON o.o_custkey = e.user_id AND o.o_orderkey >= e.event_id""")(
    lambda s, d: tables.as_of(events(s, d).select(F.col("user_id").alias("o_custkey"), "event_id", "value"), table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "event_id", "o_orderkey", "value")
)

_TT = """WITH c AS (SELECT user_id, max_by(value, event_id) AS click FROM events WHERE event_type = 'click' GROUP BY 1),
    p AS (SELECT user_id, max_by(value, event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id, click, purchase FROM c {how} JOIN p USING (user_id)"""


def table_table(s, d, how):
    e = events(s, d)
    a, b = (e.filter(F.col("event_type") == t).select("user_id", "event_id", F.col("value").alias(t)) for t in ("click", "purchase"))
    return joins.table_table(a, b, "user_id", "event_id", how).select("user_id", "click", "purchase")


for _how, _name in (("inner", "j6_table_table_inner"), ("left", "j6_table_table_left"), ("full", "j6_table_table_outer")):
    query(_name, _TT.format(how=_how))(lambda s, d, how=_how: table_table(s, d, how))


def foreign_key(s, d, how):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").alias("at"))
    c = table(s, d, "customer").select("c_custkey", "c_name", F.lit(None).cast("timestamp_ntz").alias("at"))
    c = c.withColumn("at", F.expr("TIMESTAMP_NTZ '2000-01-01'"))
    return joins.foreign_key(o, c, "o_orderkey", F.col("o_custkey"), "c_custkey", "at", how).select("o_orderkey", "o_orderstatus", "c_name")


query("j7_foreign_key_inner", "SELECT o_orderkey, o_orderstatus, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda s, d: foreign_key(s, d, "inner"))
query("j8_foreign_key_left", "SELECT o_orderkey, o_orderstatus, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")(lambda s, d: foreign_key(s, d, "left"))


def global_join(s, d, how):
    n = table(s, d, "nation")
    return joins.global_table(table(s, d, "customer"), n, "c_custkey", F.col("c_nationkey") == F.col("n_nationkey"), how).select("c_custkey", "n_name")


query("j9_global_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IS NOT NULL")(lambda s, d: global_join(s, d, "inner"))
query("j10_global_left", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IS NOT NULL")(lambda s, d: global_join(s, d, "left"))
query("s3_global_table_source", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda s, d: joins.global_table(table(s, d, "nation"), table(s, d, "region"), "n_nationkey", F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
)
query("j11_self_join", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.event_id <= a.event_id + 50")(
    lambda s, d: events(s, d).select(F.col("event_id").alias("a_id"), "user_id").join(events(s, d).select(F.col("event_id").alias("b_id"), "user_id"), "user_id").filter("b_id > a_id AND b_id <= a_id + 50").select("a_id", "b_id")
)


@query("j13_position_deletes", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER () - 1 AS pos FROM orders) WHERE pos % 5 <> 0 OR pos >= 1000""")
def j13(s, d):
    """Positions are those of the driver's single-file table."""
    data = table(s, d, "orders").select("o_orderkey", F.lit("orders").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    deletes = s.range(1000).filter("id % 5 = 0").select(F.lit("orders").alias("file_path"), F.col("id").alias("pos"))
    return joins.without_positions(data, deletes).select("o_orderkey")


@query("j14_equality_deletes", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def j14(s, d):
    deletes = s.createDataFrame([("F", "1-URGENT"), (None, "x")], "o_orderstatus string, o_orderpriority string")
    return joins.without_equals(table(s, d, "orders"), deletes, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey")


@query("o1_sort_order", "SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate) DESC NULLS LAST, o_orderpriority ASC NULLS FIRST, o_orderkey) AS rank FROM orders")
def o1(s, d):
    fields = [("year", "o_orderdate", "desc", "last"), ("identity", "o_orderpriority", "asc", "first"), ("identity", "o_orderkey", "asc", "first")]
    return ordering.numbered(table(s, d, "orders"), fields, "rank").select("o_orderkey", "rank")


@query("o2_ordered_range_scan", "SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 10 AND 60 ORDER BY c_custkey DESC")
def o2(s, d):
    return table(s, d, "customer").filter("c_custkey BETWEEN 10 AND 60").orderBy(F.desc("c_custkey")).select("c_custkey", "c_name")


def without_orders(s, d, orders):
    return table(s, d, "customer").select("c_custkey").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("o4_set_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def o4(s, d):
    return without_orders(s, d, table(s, d, "orders"))

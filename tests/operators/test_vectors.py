"""Literal vectors of stream semantics: windows, lateness, sessions, tables, changelogs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemill.operators import aggregate, joins, stateless, tables, windows


def stream(spark, rows, schema="key string, value string, ts long, n long"):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tumbling_of_100(spark):
    s = stream(spark, [("k", "v", t) for t in (10, 50, 99, 150, 190)])
    w = windows.hopping(s, F.col("ts"), 100, 100)
    assert sorted_rows(aggregate.count(w, "key", "start_us")) == [("k", 0, 3), ("k", 100, 2)]


def test_hopping_and_sliding_assignment(spark):
    s = stream(spark, [("k", "v", 125)])
    assert sorted(r.start_us for r in windows.hopping(s, F.col("ts"), 100, 50).collect()) == [50, 100]
    assert windows.hopping(s, F.col("ts"), 10, 100).count() == 0
    one = windows.sliding_per_record(stream(spark, [("k", "v", 200)]), F.col("ts"), 100).first()
    assert (one.start_us, one.end_us) == (101, 201)


@pytest.mark.parametrize(("grace", "kept"), [(50, 3), (200, 4)])
def test_late_records(spark, grace, kept):
    s = stream(spark, [("k", "v", t) for t in (10, 50, 210, 20)])
    assert windows.drop_late(s, "ts", "n", 100, grace).count() == kept


def test_sessions(spark):
    e = spark.sql("SELECT 'a' AS key, timestamp_millis(t) AS ts FROM VALUES (0), (50), (90) AS v(t) UNION ALL SELECT 'b', timestamp_millis(t) FROM VALUES (0), (50), (250) AS v(t)")
    got = windows.sessions(e, ["key"], "ts", "100 milliseconds", F.count("*").alias("n"))
    assert sorted((r.key, r.n) for r in got.collect()) == [("a", 3), ("b", 1), ("b", 2)]
    a = [r for r in got.collect() if r.key == "a"][0]
    assert (a.session_end - a.session_start).total_seconds() == 0.09


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=12), st.integers(1, 120), st.integers(1, 120))
def test_hopping_windows_hold_their_records(spark, times, size, advance):
    s = stream(spark, [("k", "v", t) for t in times])
    got = sorted((r.ts, r.start_us) for r in windows.hopping(s, F.col("ts"), size, advance).collect())
    assert got == sorted((t, k * advance) for t in times for k in range(0, t // advance + 1) if k * advance <= t < k * advance + size)


def test_branch_takes_the_first_match(spark):
    s = stream(spark, [("k", v, 0) for v in ("alpha", "bravo", "able", "banana", "cat", None)])
    got = stateless.branch(s, [("a", F.col("value").startswith("a")), ("ab", F.col("value").startswith("ab")), ("b", F.col("value").startswith("b"))])
    assert sorted((r.value, r.branch) for r in got.collect()) == [("able", "a"), ("alpha", "a"), ("banana", "b"), ("bravo", "b")]
    assert stateless.branch(s, [("a", F.col("value").startswith("a"))], "rest").filter("branch = 'rest'").count() == 4
    assert stateless.keep_not(s, F.col("value").startswith("a")).count() == 4


def test_flat_map_drops_empty_and_peek_passes(spark):
    s = stream(spark, [("k", "a b", 0), ("k", "", 1)])
    assert [r.w for r in stateless.flat_map(s, F.filter(F.split("value", " "), lambda x: x != ""), "w").collect()] == ["a", "b"]
    o = Observation("o")
    assert stateless.peek(s, o, F.count(F.lit(1)).alias("n")).count() == 2 and o.get == {"n": 2}


def test_event_time_policies(spark):
    s = spark.createDataFrame([(5, 0), (None, 1), (3, 2), (None, 3)], "ts long, n long")
    assert [r.ts for r in stateless.event_time(s, "ts", "partition_time", "n").orderBy("n").collect()] == [5, 5, 3, 5]
    assert stateless.event_time(s, "ts", "skip", "n").count() == 2
    with pytest.raises(Exception, match="record without a timestamp"):
        stateless.event_time(s, "ts", "fail", "n").collect()


def test_null_keys_are_dropped_and_order_is_arrival(spark):
    s = spark.createDataFrame([(None, "x", 0), ("k", "c", 3), ("k", "a", 1), ("k", "b", 2)], "key string, value string, n long")
    assert sorted_rows(aggregate.count(s, "key")) == [("k", 3)]
    assert aggregate.reduce(s, ["key"], "n", "value", lambda a, b: F.concat(a, b), "v").first().v == "abc"
    assert aggregate.fold(s, ["key"], "n", "value", F.lit(">"), lambda a, b: F.concat(a, b), "v").first().v == ">abc"
    assert sorted((r.n, r.c) for r in aggregate.changelog(s, ["key"], "n", c=F.count("*")).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_table_aggregates_keep_zero_groups(spark):
    c = spark.createDataFrame([("o1", "A", 10, 0), ("o2", "B", 5, 1), ("o1", "B", 100, 2), ("o2", "B", 1, 3)], "id string, customer string, amount long, n long")
    got = tables.grouped_table_agg(c, ["id"], "n", "customer", [F.count("*").alias("orders"), F.sum("amount").alias("total")], {"orders": 0, "total": 0})
    assert sorted_rows(got) == [("A", 0, 0), ("B", 2, 101)]


def test_table_filter_hides_keys_that_leave(spark):
    c = spark.createDataFrame([("k1", "ok", 0), ("k2", "ok", 1), ("k2", "skip", 2), ("k3", "yes", 3)], "key string, value string, n long")
    assert sorted(r.key for r in tables.latest_per_key(c, ["key"], "n").filter("value <> 'skip'").collect()) == ["k1", "k3"]


def test_cdc(spark):
    c = spark.createDataFrame([("insert", 1, "a", 0), ("update", 1, "b", 1), ("insert", 2, "c", 2), ("delete", 2, None, 3), ("update", 3, None, 4)], "op string, key long, after string, n long")
    assert [(r.key, r.after) for r in tables.apply_changes(c, ["key"], "n").collect()] == [(1, "b")]
    assert tables.compact_changes(c, ["key"], "n").count() == 3


def test_versions_and_ttl(spark):
    v = spark.createDataFrame([("k", 10, "a"), ("k", 20, "b")], "key string, ts long, v string")
    p = spark.createDataFrame([("k", 5), ("k", 10), ("k", 19), ("k", 20), ("j", 20)], "key string, at long")
    assert sorted_rows(tables.as_of(v, p, "key", "ts", "at", "v")) == sorted([("k", 5, None), ("k", 10, "a"), ("k", 19, "a"), ("k", 20, "b"), ("j", 20, None)], key=str)
    assert tables.as_of(v, p, "key", "ts", "at", "v", "inner").count() == 3
    assert [r.v for r in tables.visible(v, "ts", F.lit(5), F.lit(24)).collect()] == ["b"]
    assert tables.version_history(v, "ts", 10, 20).count() == 2


def test_stream_joins(spark):
    a = stream(spark, [("k", "l1", 100), ("k", "l2", 300), (None, "l3", 100)])
    b = stream(spark, [("k", "r1", 90), ("k", "r2", 110), ("k", "r3", 111)])
    pairs = lambda how, w: sorted_rows(joins.stream_stream(a, b, "key", "ts", w, how).select("l_value", "r_value"))
    assert pairs("inner", joins.JoinWindow.symmetric(10)) == [("l1", "r1"), ("l1", "r2")]
    assert pairs("inner", joins.JoinWindow.after_only(10)) == [("l1", "r2")]
    assert pairs("left", joins.JoinWindow.before_only(10)) == [("l1", "r1"), ("l2", None)]
    with pytest.raises(ValueError, match="ends before"):
        joins.JoinWindow(-5, 0)


def test_stream_table_join_is_as_of_arrival(spark):
    views = spark.createDataFrame([("alice", 1), ("alice", 4), ("dave", 5), (None, 6)], "user string, n long")
    users = spark.createDataFrame([("alice", 0, "eu"), ("alice", 3, "us")], "user string, n long, region string")
    assert sorted_rows(joins.stream_table(views, users, "user", "n", "region")) == [("alice", 1, "eu"), ("alice", 4, "us")]
    assert joins.stream_table(views, users, "user", "n", "region", "left").count() == 3


def test_foreign_key_and_global_joins(spark):
    orders = spark.createDataFrame([("o1", "u1", 0), ("o2", "u9", 1), ("o1", "u2", 2)], "id string, fk string, n long")
    users = spark.createDataFrame([("u1", "ann", 0), ("u2", "bob", 1)], "user string, name string, n long")
    got = joins.foreign_key(orders, users, "id", F.col("fk"), "user", "n", "left").select("id", "name")
    assert sorted_rows(got) == [("o1", "bob"), ("o2", None)]
    s = spark.createDataFrame([("a", "u1"), (None, "u1"), ("b", "u7")], "key string, u string")
    g = users.drop("n")
    assert joins.global_table(s, g, "key", F.col("u") == F.col("user")).count() == 1
    assert joins.global_table(s, g, "key", F.col("u") == F.col("user"), "left", most_bytes=0).count() == 2


def test_deletes(spark):
    rows = spark.createDataFrame([("f", i) for i in range(10)], "file_path string, pos long")
    gone = spark.createDataFrame([("f", 1), ("f", 4), ("f", 8), ("g", 2)], "file_path string, pos long")
    assert sorted(r.pos for r in joins.without_positions(rows, gone).collect()) == [0, 2, 3, 5, 6, 7, 9]
    d = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert joins.without_equals(d, spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"]).count() == 1


def test_emit_every_and_backfill(spark):
    s = stream(spark, [("k", "v", t) for t in range(7)])
    assert [r.n_seen for r in windows.emit_every(s, ["key"], "n", 3).orderBy("n").collect()] == [3, 6]
    assert windows.emit_every(s, ["key"], "n", 0).count() == 7
    snap = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v long")
    log = spark.createDataFrame([("a", 9, 4), ("c", 5, 8)], "key string, v long, n long")
    assert sorted((r.key, r.v) for r in tables.backfill(snap, log, ["key"], "n", 5).collect()) == [("a", 1), ("b", 2), ("c", 5)]

"""Queries over whole tables give what their SQL gives where the smallest scale cannot tell: at 10,000 events."""

import duckdb
import pytest

from tests.test_oracles import TABLES, rows
from tidemill.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def both(spark, sql, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), sql.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
    return got


def test_snapshots(spark, sql):
    assert both(spark, sql, "l1_snapshot_as_of")["snapshot_id"].tolist() == [514]
    assert both(spark, sql, "l10_snapshot_expiry")["snapshot_id"].max() > 400
    both(spark, sql, "l2_snapshots_between")


def test_applicable_deletes(spark, sql):
    assert len(both(spark, sql, "l5_applicable_deletes")) > 50_000


def test_set_difference(spark, sql):
    assert both(spark, sql, "o4_set_difference").empty


def test_sort_order(spark, sql):
    assert both(spark, sql, "o1_sort_order")["rank"].max() == 15_000


def test_numbered_gives_every_row_its_rank(spark):
    from tidemill.operators import ordering

    data = [(i, None if i % 5 == 0 else i % 7) for i in range(300)]
    df = spark.createDataFrame(data, "id int, x int").repartition(3)
    fields = [("identity", "x", "desc", "last"), ("identity", "id", "asc", "first")]
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks
    try:
        out = ordering.numbered(df, fields, "rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.id, r.x) for r in sorted(out, key=lambda r: r["rank"])] == want and {r["rank"] for r in out} == set(range(1, 301))
    assert ordering.numbered(df.limit(0), fields, "rank").count() == 0


def test_sessions_touch(spark, sql):
    assert both(spark, sql, "w7_sessions_touch")["a_id"].min() < 900


@pytest.mark.parametrize(("name", "n"), [("j7_foreign_key_inner", 15_000), ("j8_foreign_key_left", 15_000), ("j9_global_inner", 1500), ("j10_global_left", 1500), ("s7_backfill", 150)])
def test_joins_and_backfill(spark, sql, name, n):
    assert len(both(spark, sql, name)) == n


def test_backfill_has_no_gap_before_its_tail(spark, tmp_path):
    rows = [(1, "a", 100), (1, "b", 450), (2, "c", 700)]
    spark.createDataFrame(rows, "user_id long, event_type string, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["s7_backfill"](spark, str(tmp_path)).select("user_id", "event_type", "event_id").collect()
    assert sorted(map(tuple, got)) == [(1, "b", -1), (2, "c", 700)]

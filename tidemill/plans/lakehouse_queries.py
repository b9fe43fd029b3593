"""Queries over table-format metadata made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import predicates as P
from tidemill.plans.registry import query, table
from tidemill.sources import lakehouse

_FILES = """(SELECT 'f' || (o_orderkey // 200) AS file_path, count(*) AS record_count, min(o_orderkey) AS k_lower, max(o_orderkey) AS k_upper,
    CAST(count(*) - count(o_orderkey) AS BIGINT) AS k_nulls, o_orderkey // 200 AS g FROM orders GROUP BY o_orderkey // 200)"""


def file_stats(s, d):
    """Statistics as if ``orders`` lay in files of 200 keys."""
    g = F.floor(F.col("o_orderkey") / 200).cast("long")
    o = table(s, d, "orders").groupBy(g.alias("g")).agg(F.count("*").alias("record_count"), F.min("o_orderkey").alias("k_lower"), F.max("o_orderkey").alias("k_upper"), (F.count("*") - F.count("o_orderkey")).alias("k_nulls"))
    return o.withColumn("file_path", F.concat(F.lit("f"), F.col("g").cast("string"))).withColumn("k_nans", F.lit(0))


_SNAPSHOTS = "(SELECT event_id AS snapshot_id, CASE WHEN event_id > 0 THEN event_id - 1 END AS parent_id, ts FROM events)"


def snapshots(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("snapshot_id"), F.when(F.col("event_id") > 0, F.col("event_id") - 1).alias("parent_id"), "ts")


_ENTRIES = """(SELECT 'f' || event_id AS file_path, event_id // 10 AS snapshot_id, CASE WHEN event_type = 'error' THEN 'deleted' WHEN event_type = 'view' THEN 'existing' ELSE 'added' END AS status, user_id AS record_count FROM events)"""


def entries(s, d):
    status = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "view", "existing").otherwise("added")
    return table(s, d, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_path"), F.floor(F.col("event_id") / 10).cast("long").alias("snapshot_id"), status.alias("status"), F.col("user_id").alias("record_count"))


@query("l1_snapshot_as_of", f"SELECT * FROM {_SNAPSHOTS} WHERE ts <= TIMESTAMP '2024-01-02 12:00:00' ORDER BY ts DESC, snapshot_id DESC LIMIT 1")
def l1(s, d):
    return lakehouse.as_of(snapshots(s, d), F.expr("TIMESTAMP_NTZ '2024-01-02 12:00:00'"))


@query("l2_snapshots_between", "SELECT CAST(i AS BIGINT) AS snapshot_id FROM range(101, 121) t(i)")
def l2(s, d):
    return lakehouse.lineage_between(snapshots(s, d), 100, 120).select("snapshot_id")


@query("l3_file_pruning", f"SELECT file_path, NOT (k_lower >= 450 AND k_upper <= 900) AS residual FROM {_FILES} WHERE k_upper >= 450 AND k_lower <= 900")
def l3(s, d):
    e = P.And(P.Leaf(">=", "k", 450), P.Not(P.Leaf(">", "k", 900)))
    return lakehouse.prune(file_stats(s, d), e).select("file_path", "residual")


@query("l4_partition_projection", "SELECT o_orderkey FROM orders WHERE o_orderkey - o_orderkey % 100 <= 300")
def l4(s, d):
    parts = table(s, d, "orders").withColumn("k_trunc", F.col("o_orderkey") - F.pmod("o_orderkey", F.lit(100)))
    return parts.filter(P.to_column(P.partition_filter(P.Leaf("<", "o_orderkey", 333), {"k_trunc": ("o_orderkey", "truncate[100]")}))).select("o_orderkey")


def applicable_deletes(e):
    name = lambda p: F.concat(F.lit(p), F.col("event_id").cast("string")).alias("file_path")
    part, seq = F.col("user_id").alias("partition"), F.col("event_id").alias("sequence")
    kind = F.when(F.col("event_id") % 2 == 0, "position").otherwise("equality").alias("kind")
    return lakehouse.applicable_deletes(e.filter("event_type <> 'error'").select(name("d"), part, seq), e.filter("event_type = 'error'").select(name("x"), part, seq, kind))


@query("l5_applicable_deletes", """WITH f AS (SELECT 'd' || event_id AS file_path, user_id AS part, event_id AS seq FROM events WHERE event_type <> 'error'),
    x AS (SELECT 'x' || event_id AS delete_path, user_id AS part, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'position' ELSE 'equality' END AS kind FROM events WHERE event_type = 'error')
    SELECT file_path, delete_path, kind FROM f JOIN x USING (part) WHERE CASE WHEN kind = 'position' THEN x.seq >= f.seq ELSE x.seq > f.seq END""")
def l5(s, d):
    return applicable_deletes(table(s, d, "events"))


@query("l6_append_scan", f"SELECT file_path FROM {_ENTRIES} WHERE status = 'added' AND snapshot_id BETWEEN 11 AND 20")
def l6(s, d):
    return lakehouse.appended(entries(s, d), list(range(11, 21))).select("file_path")


@query("l6_changelog_scan", f"SELECT file_path, CASE status WHEN 'added' THEN 'insert' ELSE 'delete' END AS change FROM {_ENTRIES} WHERE status IN ('added', 'deleted') AND snapshot_id BETWEEN 11 AND 20")
def l6b(s, d):
    return lakehouse.changes(entries(s, d), list(range(11, 21))).select("file_path", "change")


@query("a14_snapshot_summary", f"""WITH g AS (SELECT snapshot_id, status, count(*) AS files, CAST(sum(record_count) AS BIGINT) AS records FROM {_ENTRIES} GROUP BY 1, 2)
    SELECT snapshot_id, status || '-files' AS key, files AS value FROM g UNION ALL SELECT snapshot_id, status || '-records', records FROM g WHERE records <> 0""")
def a14(s, d):
    return lakehouse.summary(entries(s, d))


def expired(s, snaps):
    refs = s.createDataFrame([("main", 7), ("tag", 11)], "name string, snapshot_id long")
    return lakehouse.expired(snaps, refs, F.expr("TIMESTAMP_NTZ '2024-01-12'"), F.expr("INTERVAL 5 DAYS"), 3).select("snapshot_id")


@query("l10_snapshot_expiry", f"""SELECT snapshot_id FROM {_SNAPSHOTS} WHERE ts + INTERVAL 5 DAY < TIMESTAMP '2024-01-12' AND snapshot_id NOT IN (7, 11)
    AND snapshot_id NOT IN (SELECT snapshot_id FROM {_SNAPSHOTS} ORDER BY ts DESC, snapshot_id DESC LIMIT 3)""")
def l10(s, d):
    return expired(s, snapshots(s, d))


@query("l11_orphan_files", f"SELECT 'f' || event_id AS file_path FROM events EXCEPT SELECT file_path FROM {_ENTRIES} WHERE status <> 'deleted'")
def l11(s, d):
    listing = table(s, d, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_path"))
    return lakehouse.orphans(listing, lakehouse.live_files(entries(s, d)))


@query("k11_manifest_bin_pack", """SELECT file_path, CAST(floor(coalesce(sum(size) OVER (PARTITION BY part ORDER BY file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500) AS BIGINT) AS bin
    FROM (SELECT 'f' || event_id AS file_path, user_id AS part, event_id % 90 AS size FROM events)""")
def k11(s, d):
    f = table(s, d, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_path"), F.col("user_id").alias("partition"), (F.col("event_id") % 90).alias("size"))
    return lakehouse.bin_pack(f, 500).select("file_path", "bin")


@query("l14_delta_active_files", "SELECT user_id AS path, event_id AS size FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 700) WHERE r = 1 AND event_type <> 'error'")
def l14(s, d):
    e = table(s, d, "events")
    path = F.col("user_id").cast("string")
    add = F.when(F.col("event_type") != "error", F.struct(path.alias("path"), F.col("event_id").alias("size"), F.lit(None).cast("string").alias("stats")))
    actions = e.select(F.col("event_id").alias("version"), add.alias("add"), F.when(F.col("event_type") == "error", F.struct(path.alias("path"))).alias("remove"))
    return lakehouse.delta_files(actions, 700).select(F.col("path").cast("long").alias("path"), "size")


@query("l15_hudi_slices", """SELECT user_id AS file_id, event_id AS instant FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events
    WHERE event_type IN ('click', 'purchase') AND event_id <= 800) WHERE r = 1""")
def l15(s, d):
    e = table(s, d, "events")
    action = F.when(F.col("event_type") == "click", "commit").when(F.col("event_type") == "purchase", "deltacommit").otherwise("clean")
    c = e.select(F.col("event_id").alias("instant"), action.alias("action"), F.lit("completed").alias("state"), F.lit("p").alias("partition"), F.col("user_id").alias("file_id"), F.lit("x").alias("path"), F.lit(None).cast("array<bigint>").alias("replaced"))
    return lakehouse.hudi_slices(c, 800).select("file_id", "instant")


@query("l16_lance_files", "SELECT user_id AS fragment_id, 'v' || event_type AS file_path FROM events WHERE event_id // 100 = (SELECT max(event_id // 100) FROM events)")
def l16(s, d):
    e = table(s, d, "events")
    m = e.select(F.floor(F.col("event_id") / 100).cast("long").alias("version"), F.col("user_id").alias("fragment_id"), F.array(F.concat(F.lit("v"), "event_type")).alias("files"))
    return lakehouse.lance_version(m).select("fragment_id", "file_path")


@query("l17_schema_resolution", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name AS title, s_acctbal, 'none' AS note FROM supplier")
def l17(s, d):
    from pyspark.sql import types as T

    reader = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("title", T.StringType()), T.StructField("s_acctbal", T.DoubleType()), T.StructField("note", T.StringType(), False)])
    return lakehouse.resolve(table(s, d, "supplier"), reader, {"title": ["s_name"]}, {"note": "none"})


@query("p16_project_field_ids", "SELECT c_custkey, c_acctbal FROM customer")
def p16(s, d):
    return lakehouse.project_ids(table(s, d, "customer"), {1: "c_custkey", 2: "c_name", 4: "c_acctbal"}, [1, 4, 9])


@query("s10_row_group_skipping")
def s10(s, d):
    """Row groups and how many of them a predicate on l_orderkey would skip, from the footers."""
    from tidemill.sources import files

    f = files.parquet_footers(s, f"{d}/lineitem.parquet").filter("column = 'l_orderkey'")
    return f.agg(F.count("*").alias("total"), F.sum((F.col("low").cast("long") > 100).cast("long")).alias("dropped"))


@query("l19_footer_metrics")
def l19(s, d):
    from tidemill.sources import files

    return files.parquet_footers(s, f"{d}/orders.parquet").groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("bytes").alias("bytes"))

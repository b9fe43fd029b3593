"""The same shapes run by Structured Streaming over ``events`` until the source is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import stateless
from tidemill.plans.registry import query, table
from tidemill.sources import sinks
from tidemill.streaming import jobs


def stream(s, d, lag="60 days"):
    """``events`` as a file stream with a watermark."""
    schema = table(s, d, "events").schema
    return jobs.with_event_time(jobs.file_stream(s, f"{d}/event[s].parquet", schema), "ts", lag)


def drained(s, df, mode="append"):
    return jobs.drained(s, df, sinks.shared_path(s, "drained"), mode)


@query("s1_stream_passthrough", "SELECT event_id, user_id, value FROM events")
def s1(s, d):
    return drained(s, stream(s, d).select("event_id", "user_id", "value"))


@query("p1_stream_filter_map", "SELECT event_id, value * 2 AS twice FROM events WHERE value > 50")
def p1(s, d):
    return drained(s, stateless.keep(stream(s, d), F.col("value") > 50).select("event_id", (F.col("value") * 2).alias("twice")))


@query("a2_stream_count", "SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def a2(s, d):
    return drained(s, stream(s, d).filter("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n")), "complete")


@query("w1_stream_tumbling_count", "SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def w1(s, d):
    out = drained(s, jobs.windowed(stream(s, d), ["event_type"], "ts", "1 hour", None, F.count("*").alias("n")), "complete")
    return out.select("event_type", F.unix_micros("window_start").alias("start_us"), "n")


@query("w2_stream_hopping_count", "SELECT event_type, k * 1800000000 AS start_us, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(ts) // 1800000000, epoch_us(ts) // 1800000000 - 1]) AS k FROM events) GROUP BY 1, 2")
def w2(s, d):
    out = drained(s, jobs.windowed(stream(s, d), ["event_type"], "ts", "1 hour", "30 minutes", F.count("*").alias("n")), "complete")
    return out.select("event_type", F.unix_micros("window_start").alias("start_us"), "n")


@query("j1_stream_join", """SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM events l JOIN events r ON l.event_type = 'click' AND r.event_type = 'purchase' AND l.user_id = r.user_id
    AND r.ts BETWEEN l.ts - INTERVAL 2 HOUR AND l.ts + INTERVAL 3 HOUR""")
def j1(s, d):
    a, b = (stream(s, d).filter(F.col("event_type") == t).select("event_id", "user_id", "ts") for t in ("click", "purchase"))
    return drained(s, jobs.stream_stream(a, b, "user_id", "ts", "2 HOURS", "3 HOURS").select("l_event_id", "r_event_id"))


@query("j9_stream_static", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def j9(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return drained(s, stream(s, d).join(c, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@query("w13_stream_debounce")
def w13(s, d):
    e = stream(s, d).withColumn("ms", F.unix_millis("ts")).select("user_id", "value", "ms", "event_id")
    return drained(s, jobs.debounce(e, "user_id", "value", "ms", "event_id", 86_400_000))


@query("w14_bounded_suppress")
def w14(s, d):
    """One buffer over all keys, as the cap is global: every event in order of arrival through one task, a batch at a time."""
    def run(batches):
        import pyarrow as pa

        def out(rows):
            rows = list(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=["user_id", "value"])

        buffer: dict = {}
        for b in batches:
            yield out(jobs.overflow(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), buffer, 5, "emit_early", dead=lambda row: None))
        yield out(buffer.items())

    e = table(s, d, "events").select("user_id", "value", "event_id").repartition(1).sortWithinPartitions("event_id")
    return e.mapInArrow(run, "user_id long, value double")

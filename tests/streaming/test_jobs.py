import pytest
from pyspark.sql import functions as F

from tidemill.operators import aggregate, windows
from tidemill.streaming import jobs

EVENTS = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in three files, in order."""
    d = str(tmp_path_factory.mktemp("events") / "e")
    e = spark.read.parquet(f"{EVENTS}/events.parquet")
    for i in range(3):
        e.filter(F.floor(F.col("event_id") / 334) == i).coalesce(1).write.mode("append").parquet(d)
    return d, e


def test_windowed_count_is_that_of_the_batch(spark, parts, tmp_path):
    d, e = parts
    s = jobs.with_event_time(jobs.file_stream(spark, d, e.schema, 1), "ts", "60 days")
    out = jobs.drained(spark, jobs.windowed(s, ["event_type"], "ts", "1 hour", None, F.count("*").alias("n")), str(tmp_path / "counts"), "complete")
    want = aggregate.count(windows.tumbling(e, "ts", "1 hour"), "event_type", "window_start", "window_end")
    got = out.select("event_type", F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "n")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()


def test_append_emits_closed_windows_only(spark, parts, tmp_path):
    d, e = parts
    s = jobs.with_event_time(jobs.file_stream(spark, d, e.schema, 1), "ts", "60 days")
    assert jobs.drained(spark, jobs.windowed(s, [], "ts", "1 day", None, F.count("*").alias("n")), str(tmp_path / "closed")).count() == 0


def test_stream_stream_join(spark, parts, tmp_path):
    d, e = parts
    side = lambda t: jobs.with_event_time(jobs.file_stream(spark, d, e.schema), "ts", "60 days").filter(F.col("event_type") == t).select("event_id", "user_id", "ts")
    joined = jobs.drained(spark, jobs.stream_stream(side("click"), side("purchase"), "user_id", "ts", "10 HOURS", "15 HOURS"), str(tmp_path / "joined"))
    a, b = (e.filter(F.col("event_type") == t) for t in ("click", "purchase"))
    want = a.alias("l").join(b.alias("r"), F.expr("l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 10 HOURS AND l.ts + INTERVAL 15 HOURS")).count()
    assert joined.count() == want > 0


def test_debounce(spark, tmp_path):
    rows = [("k", "first", 0, 0), ("k", "second", 50, 1), ("k", "third", 120, 2), ("k", "fourth", 130, 3), ("j", "x", 10, 4), (None, "y", 500, 5), ("k", "fifth", 230, 6)]
    df = spark.createDataFrame(rows, "key string, value string, t long, n long")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    out = jobs.drained(spark, jobs.debounce(jobs.file_stream(spark, str(tmp_path / "d"), df.schema), "key", "value", "t", "n", 100), str(tmp_path / "debounced"))
    assert sorted(map(tuple, out.collect())) == [("k", "fourth", 230), ("k", "second", 120)]


def test_bounded_buffers():
    rows = [("a", 1), ("b", 2), ("a", 3), ("c", 4)]
    assert jobs.bounded_suppress(rows, 2, "emit_early") == ([("a", 3), ("b", 2), ("c", 4)], [])
    assert jobs.bounded_suppress(rows, 2, "drop_oldest") == ([("b", 2), ("c", 4)], [])
    assert jobs.bounded_suppress(rows, 2, "dead_letter") == ([("a", 3), ("b", 2)], [("c", 4)])
    with pytest.raises(OverflowError):
        jobs.bounded_suppress(rows, 2, "shutdown")


def test_bounded_suppress_query_reads_all_events(spark):
    import pyarrow.parquet as pq

    from tidemill.plans import registry

    d = "/root/testdata/sf0.01"
    e = pq.read_table(f"{d}/events.parquet").sort_by("event_id")
    want, _ = jobs.bounded_suppress(list(zip(e["user_id"].to_pylist(), e["value"].to_pylist(), strict=True)), 5, "emit_early")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "700")
    try:
        assert list(map(tuple, registry.queries()["w14_bounded_suppress"](spark, d).collect())) == want
    finally:
        spark.conf.set(batch, before)


def test_two_phase_sink_is_idempotent_over_restart(spark, parts, tmp_path):
    d, e = parts
    done: list[int] = []
    sink = jobs.two_phase_sink(str(tmp_path / "out"), lambda i: done.append(i) or True)
    for _ in range(2):
        s = jobs.file_stream(spark, d, e.schema, 1)
        q = s.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    sink(spark.read.parquet(d).limit(0).unionAll(spark.read.parquet(str(tmp_path / "out/batch=1"))), 9)
    assert spark.read.parquet(str(tmp_path / "out")).filter("batch < 9").count() == e.count() and done == [0, 1, 2, 9]


def test_two_phase_sink_decides_once(spark, tmp_path):
    sink, df = jobs.TwoPhaseSink(spark, str(tmp_path / "sink")), spark.range(3)
    with pytest.raises(ValueError, match="not prepared"):
        sink.commit(0)
    sink.prepare(0, df)
    sink.commit(0)
    sink.commit(0)
    sink.prepare(1, df)
    sink.abort(1)
    sink.recover(lambda batch: True)
    assert sorted(r.id for r in sink.read("id long").collect()) == [0, 1, 2]

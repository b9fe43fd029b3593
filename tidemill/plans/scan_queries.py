"""Scans, deletes, sinks and messages from end to end: tables are written to the shared folder and read back."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.functions import predicates as P
from tidemill.functions import transforms
from tidemill.plans.registry import query, table
from tidemill.sources import files, lakehouse, sinks
from tidemill.streaming import jobs


def _text(s, path: str, name: str, lines: list[str]) -> None:
    """A metadata file of a few lines."""
    p = s._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = p.getFileSystem(s._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()


def _delta_table(s, d) -> str:
    """Orders by status in three versions: F, then O as well, then P instead of F."""
    root, o = sinks.shared_path(s, "delta"), table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    names = {}
    for status in "FOP":
        o.filter(F.col("o_orderstatus") == status).write.parquet(f"{root}/{status}")
        names[status] = [f"{status}/{r[0].rsplit('/', 1)[1]}" for r in s.read.parquet(f"{root}/{status}").select(F.col("_metadata.file_path")).distinct().collect()]  # a row a file
    add = lambda st: [json.dumps({"add": {"path": p, "size": 1, "dataChange": True}}) for p in names[st]]
    gone = lambda st: [json.dumps({"remove": {"path": p, "dataChange": True}}) for p in names[st]]
    meta = json.dumps({"metaData": {"id": "t", "schemaString": o.schema.json(), "partitionColumns": []}})
    for v, lines in enumerate(([meta, *add("F")], add("O"), [*gone("F"), *add("P")])):
        _text(s, f"{root}/_delta_log", f"{v:020d}.json", lines)
    return root


@query("s21_delta_open", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P')")
def s21(s, d):
    return lakehouse.read_delta(s, _delta_table(s, d)).select("o_orderkey", "o_totalprice")


@query("s21_delta_open_at_version", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def s21_at(s, d):
    return lakehouse.read_delta(s, _delta_table(s, d), 1).select("o_orderkey", "o_totalprice")


def _hudi_table(s, d) -> str:
    """Orders in three commits of two file groups: the second one rewrites the group of F."""
    root, o = sinks.shared_path(s, "hudi"), table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    for instant, group, rows in (("001", "f", "o_orderstatus = 'F'"), ("002", "o", "o_orderstatus = 'O'"), ("003", "f", "o_orderstatus = 'F' AND o_orderkey % 2 = 0")):
        o.filter(rows).write.parquet(f"{root}/p/{group}_{instant}.parquet")
        _text(s, f"{root}/.hoodie", f"{instant}.commit", [json.dumps({"partitionToWriteStats": {"p": [{"fileId": group, "path": f"p/{group}_{instant}.parquet"}]}})])
    _text(s, f"{root}/.hoodie", "004.commit.inflight", ["{}"])
    return root


@query("s22_hudi_open", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def s22(s, d):
    return lakehouse.read_hudi(s, _hudi_table(s, d)).select("o_orderkey")


@query("s22_hudi_open_at_instant", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F')")
def s22_at(s, d):
    return lakehouse.read_hudi(s, _hudi_table(s, d), "002").select("o_orderkey")


def _files(s, d):
    """Orders in files by ranges of keys, and an entry with bounds for each."""
    root = sinks.shared_path(s, "scan")
    table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(root)
    path = F.col("_metadata.file_path").alias("file_path")
    entries = s.read.parquet(root).groupBy(path).agg(F.count("*").alias("record_count"), F.min("o_orderkey").alias("o_orderkey_lower"), F.max("o_orderkey").alias("o_orderkey_upper"), (F.count("*") - F.count("o_orderkey")).alias("o_orderkey_nulls"))
    return root, entries.withColumn("o_orderkey_nans", F.lit(0)).withColumn("status", F.lit("added"))


_RANGE = P.And(P.Leaf(">=", "o_orderkey", 400), P.Leaf("<", "o_orderkey", 1200))


@query("s20_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 400 AND o_orderkey < 1200 AND o_orderpriority <> '1-URGENT'")
def s20(s, d):
    """Files pruned by their bounds, equality deletes applied, the rest filtered and projected."""
    _, entries = _files(s, d)
    deletes = s.createDataFrame([("1-URGENT",)], "o_orderpriority string")
    return lakehouse.scan(s, entries, _RANGE, ["o_orderkey", "o_totalprice"], equals=(deletes, ["o_orderpriority"]))


@query("l7_deletion_vectors", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 400 AND o_orderkey < 1200 AND o_orderkey % 7 <> 3")
def l7(s, d):
    """Each file's deleted positions as a deletion vector, decoded and applied by the scan."""
    root, entries = _files(s, d)
    rows = s.read.parquet(root).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"), "o_orderkey").filter("o_orderkey % 7 = 3")

    def encode(pdf):
        import pandas as pd

        return pd.DataFrame({"file_path": [pdf["file_path"].iloc[0]], "blob": [lakehouse.encode_deletion_vector(pdf["pos"].to_numpy())]})

    vectors = rows.groupBy("file_path").applyInPandas(encode, "file_path string, blob binary")  # a file's positions, bounded by the file
    return lakehouse.scan(s, entries, _RANGE, ["o_orderkey"], positions=lakehouse.deleted_positions(vectors))


@query("s13_arrow_messages", "SELECT event_id, value FROM events")
def s13(s, d):
    """Batches as IPC streams in a column, and back."""

    def encode(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["message"])

    def decode(batches):
        for b in batches:
            for m in b.column(0).to_pylist():
                yield from pa.ipc.open_stream(m).read_all().to_batches()

    return table(s, d, "events").select("event_id", "value").mapInArrow(encode, "message binary").mapInArrow(decode, "event_id long, value double")


_EVENT = {"type": "record", "name": "event", "fields": [{"name": "event_id", "type": "long"}, {"name": "event_type", "type": ["null", "string"]}, {"name": "value", "type": "double"}]}


@query("s14_avro_containers", "SELECT event_id, event_type, value FROM events")
def s14(s, d):
    """Batches as object containers (deflate) in a column, and back."""

    def encode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([files.write_container(_EVENT, b.to_pylist(), "deflate")], pa.binary())], names=["container"])

    def decode(batches):
        target = pa.schema([("event_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64())])
        for b in batches:
            for c in b.column(0).to_pylist():
                yield from pa.Table.from_pylist(files.read_container(c)[1], target).to_batches()

    return table(s, d, "events").select("event_id", "event_type", "value").mapInArrow(encode, "container binary").mapInArrow(decode, "event_id long, event_type string, value double")


# Public fingerprints of primitive schemas.
_PRINTS = {"null": "63dd24e7cc258f8a", "int": "7275d51a3f395c8f", "long": "d054e14493f41db7", "boolean": "9f42fc78a4d4f764", "string": "8f014872634503c7"}


@query("s15_avro_fingerprints", "SELECT name, crc64, md5('\"' || name || '\"') AS md5 FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in _PRINTS.items()) + ") t(name, crc64)")
def s15(s, d):
    rows = [(n, f"{files.fingerprint(n):016x}", files.fingerprint_md5(n)) for n in _PRINTS]
    return s.createDataFrame(rows, "name string, crc64 string, md5 string")


@query("t5_bound_truncation", "SELECT o_orderkey, left(o_orderpriority, 4) AS low, CASE WHEN length(o_orderpriority) <= 4 THEN o_orderpriority ELSE left(o_orderpriority, 3) || chr(ascii(substr(o_orderpriority, 4, 1)) + 1) END AS high FROM orders")
def t5(s, d):
    low, high = transforms.truncated_bounds(F.col("o_orderpriority"), 4)
    return table(s, d, "orders").select("o_orderkey", low.alias("low"), high.alias("high"))


@query("t6_metrics_mode", """SELECT 'o_orderkey' AS column, count(*) AS n, CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high FROM orders
    UNION ALL SELECT 'o_orderpriority', count(*), left(min(o_orderpriority), 3), left(max(o_orderpriority), 2) || chr(ascii(substr(max(o_orderpriority), 3, 1)) + 1) FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), NULL, NULL FROM orders""")
def t6(s, d):
    modes = {"o_orderkey": "full", "o_orderstatus": "counts", "o_totalprice": "none"}
    return transforms.column_metrics(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), "truncate(3)", modes)


@query("l9_schema_evolution", "SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false), ('d', true), ('e', false)) t(change, allowed)")
def l9(s, d):
    from pyspark.sql import types as T

    def schema(text):
        return T._parse_datatype_string(text)

    pairs = {"a": ("x int", "x bigint"), "b": ("x int", "x string"), "c": ("x int", "x int, y int NOT NULL"), "d": ("x decimal(5,2)", "x decimal(9,2)"), "e": ("x int", "x int NOT NULL")}
    return s.createDataFrame([(k, not lakehouse.evolution_errors(schema(a), schema(b))) for k, (a, b) in pairs.items()], "change string, allowed boolean")


@query("k1_topic_sink", "SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, 'props' AS header FROM events")
def k1(s, d):
    """Records with key, value and headers into a topic (a folder of files), read back as the next stream would."""
    path = sinks.shared_path(s, "topic")
    record = table(s, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.array(F.struct(F.lit("props").alias("name"), F.col("props").alias("value"))).alias("headers"))
    record.write.parquet(path)
    return s.read.schema(record.schema).parquet(path).select("key", "value", F.col("headers")[0]["name"].alias("header"))


@query("k5_foreach", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k5(s, d):
    """A function of the user's for every batch of a stream; here it writes counts, added up afterwards."""
    from tidemill.plans.streaming_queries import stream

    path = sinks.shared_path(s, "foreach")
    call = lambda batch, batch_id: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    stream(s, d).writeStream.foreachBatch(call).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("event_type string, n long").option("basePath", path).parquet(f"{path}/batch=*").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("k6_two_phase_sink", "SELECT event_id FROM events WHERE event_id % 4 IN (0, 2)")
def k6(s, d):
    """Of four prepared batches one is committed twice, one aborted, and recovery finishes one and undoes the last."""
    e, sink = table(s, d, "events").select("event_id"), jobs.TwoPhaseSink(s, sinks.shared_path(s, "two-phase"))
    for batch in range(4):
        sink.prepare(batch, e.filter(F.col("event_id") % 4 == batch))
    sink.commit(0)
    sink.prepare(0, e)
    sink.commit(0)
    sink.abort(1)
    sink.recover(lambda batch: batch == 2)
    return sink.read("event_id long")

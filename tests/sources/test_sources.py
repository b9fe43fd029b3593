import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import predicates as P
from tidemill.functions import transforms as X
from tidemill.sources import files, lakehouse

SCHEMA = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "m", "type": {"type": "map", "values": "double"}}]}
ROWS = [{"id": i * -7, "name": None if i % 2 else f"n{i}", "tags": ["a", "b"][: i % 3], "m": {"x": i / 2}} for i in range(20)]


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro_round_trip(spark, tmp_path, codec):
    data = files.write_container(SCHEMA, ROWS, codec)
    assert files.read_container(data) == (SCHEMA, ROWS)
    (tmp_path / "a.avro").write_bytes(data)
    got = [r.asDict() for r in files.read_avro(spark, str(tmp_path), SCHEMA).orderBy(F.desc("id")).collect()]
    assert got == sorted(ROWS, key=lambda r: -r["id"])


def test_avro_fingerprint():
    assert files.canonical_form({"type": "int", "doc": "x"}) == '"int"'
    assert f"{files.fingerprint('int'):016x}" == "7275d51a3f395c8f"


def test_arrow_ipc(spark, tmp_path):
    t = pa.table({"id": pa.array([1, 2, 3], pa.int64()), "s": ["a", None, "c"]})
    for name, new in (("f.arrow", pa.ipc.new_file), ("s.arrow", pa.ipc.new_stream)):
        with pa.OSFile(str(tmp_path / name), "wb") as f, new(f, t.schema) as w:
            w.write_table(t)
    assert sorted(map(tuple, files.read_arrow(spark, str(tmp_path), "id long, s string").collect()), key=str) == sorted([(1, "a"), (2, None), (3, "c")] * 2, key=str)


def test_parquet_footers(spark, tmp_path):
    pq.write_table(pa.table({"id": list(range(10, 100))}), tmp_path / "x.parquet", row_group_size=30)
    got = files.parquet_footers(spark, str(tmp_path)).orderBy("row_group").collect()
    assert [(r.rows, r.nulls, r.low, r.high) for r in got] == [(30, 0, "10", "39"), (30, 0, "40", "69"), (30, 0, "70", "99")]


def test_delta_log(spark, tmp_path):
    log = tmp_path / "_delta_log"
    log.mkdir()
    schema = T.StructType([T.StructField("id", T.LongType())])
    for n, lo in (("a", 0), ("b", 10)):
        pq.write_table(pa.table({"id": pa.array(range(lo, lo + 5), pa.int64())}), tmp_path / f"{n}.parquet")
    actions = [
        [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": "t", "schemaString": schema.json()}}, {"add": {"path": "a.parquet", "size": 1}}, {"commitInfo": {"operation": "WRITE", "timestamp": 1}}],
        [{"add": {"path": "b.parquet", "size": 2}}, {"commitInfo": {"operation": "WRITE", "timestamp": 2}}],
        [{"remove": {"path": "a.parquet"}}, {"commitInfo": {"operation": "DELETE", "timestamp": 3}}],
    ]
    for v, rows in enumerate(actions):
        (log / f"{v:020d}.json").write_text("\n".join(map(json.dumps, rows)))
    a = lakehouse.delta_actions(spark, str(tmp_path))
    assert [r.path for r in lakehouse.delta_files(a).collect()] == ["b.parquet"]
    assert sorted(r.path for r in lakehouse.delta_files(a, 1).collect()) == ["a.parquet", "b.parquet"]
    assert [r.operation for r in lakehouse.delta_history(a).collect()] == ["DELETE", "WRITE", "WRITE"]
    assert sorted(r.id for r in lakehouse.read_delta(spark, str(tmp_path)).collect()) == list(range(10, 15))


def test_hudi_and_lance(spark):
    assert lakehouse.hudi_instants(["002.commit", "001.deltacommit.inflight", "junk", "001.deltacommit"]) == [("001", "deltacommit", "completed"), ("001", "deltacommit", "inflight"), ("002", "commit", "completed")]
    rows = [("001", "commit", "completed", "p", "f1", "a", None), ("002", "deltacommit", "completed", "p", "f1", "b", None), ("003", "replacecommit", "completed", "p", "f2", "c", ["f1"]), ("004", "commit", "inflight", "p", "f3", "d", None)]
    c = spark.createDataFrame(rows, "instant string, action string, state string, partition string, file_id string, path string, replaced array<string>")
    assert [r.path for r in lakehouse.hudi_slices(c).collect()] == ["c"]
    assert [r.path for r in lakehouse.hudi_slices(c, "002").collect()] == ["b"]
    m = spark.createDataFrame([(1, 0, ["a"]), (2, 0, ["a", "b"]), (2, 1, ["c"])], "version int, fragment_id int, files array<string>")
    assert sorted(r.file_path for r in lakehouse.lance_version(m).collect()) == ["a", "b", "c"]
    assert [r.file_path for r in lakehouse.lance_version(m, 1).collect()] == ["a"]


def test_snapshots(spark):
    s = spark.createDataFrame([(1, None, 10), (2, 1, 20), (3, 2, 30), (4, 2, 40)], "snapshot_id long, parent_id long, ts long")
    assert lakehouse.as_of(s, 29).first().snapshot_id == 2 and lakehouse.current(s).first().snapshot_id == 4
    assert lakehouse.ancestors(s, 3) == [3, 2, 1] and lakehouse.between(s, 1, 4) == [4, 2]
    refs = spark.createDataFrame([("tag", 1)], "name string, snapshot_id long")
    assert sorted(r.snapshot_id for r in lakehouse.expired(s, refs, 41, F.lit(5)).collect()) == [2, 3]
    assert lakehouse.by_ref(s, refs, "tag").first().snapshot_id == 1


def test_lineage_is_walked_by_joins(spark):
    s = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(50)] + [(60, 61, 0), (61, 62, 0), (62, 61, 0)], "snapshot_id long, parent_id long, ts long")
    assert lakehouse.ancestors(s, 49) == list(range(49, -1, -1)) and lakehouse.between(s, 10, 40) == list(range(40, 10, -1))
    assert lakehouse.ancestors(s, 60) == [60, 61, 62] and lakehouse.ancestors(s, 99) == []
    with pytest.raises(ValueError):
        lakehouse.lineage_between(s, 60, 40)


def test_schema_evolution(spark):
    of = lambda *f: T.StructType([T.StructField(n, t, null) for n, t, null in f])
    old = of(("a", T.IntegerType(), False), ("d", T.DecimalType(9, 2), True))
    assert lakehouse.evolution_errors(old, of(("a", T.LongType(), False), ("d", T.DecimalType(12, 2), True), ("n", T.StringType(), True))) == []
    for bad in (of(("a", T.StringType(), False)), of(("d", T.DecimalType(9, 2), True)), of(("a", T.IntegerType(), False), ("d", T.DecimalType(9, 3), True)), of(("a", T.IntegerType(), False), ("x", T.LongType(), False))):
        assert lakehouse.evolution_errors(old, bad)
    df = spark.createDataFrame([(1, "x")], "a int, old string")
    out = lakehouse.resolve(df, of(("a", T.LongType(), True), ("b", T.StringType(), True), ("c", T.IntegerType(), False)), {"b": ["old"]}, {"c": 9})
    assert tuple(out.first()) == (1, "x", 9)


def test_transform_vectors(spark):
    import numpy as np

    assert X.murmur3_bytes(b"iceberg") & 0x7FFFFFFF == 1210000089
    assert (int(X.murmur3_long(np.array([34]))[0]) & 0x7FFFFFFF) == 2017239379
    row = spark.range(1).select(X.bucket(F.lit(34), 16), X.truncate(F.lit(23), 10), X.truncate(F.lit(-1), 10), X.truncate(F.lit("iceberg"), 3, "string"), X.truncate(F.lit("10.65").cast("decimal(9,2)"), 50, "decimal(9,2)")).first()
    assert tuple(row)[:4] == (3, 20, -10, "ice") and str(row[4]) == "10.50"
    assert (X.lower_bound("abc", 2), X.upper_bound("abc", 2), X.upper_bound("a", 2), X.upper_bound(b"\xff\xff\x01", 2), X.upper_bound("a\U0010ffffb", 2)) == ("ab", "ac", "a", None, "b")


def random_predicate(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        op = rng.choice(["=", "!=", "<", "<=", ">", ">=", "in", "not_in", "is_null", "not_null"])
        return P.Leaf(op, "x", tuple(rng.sample(range(12), 3)) if "in" == op or op == "not_in" else rng.randrange(12))
    kind = rng.choice([P.And, P.Or, P.Not])
    return P.Not(random_predicate(rng, depth - 1)) if kind is P.Not else kind(random_predicate(rng, depth - 1), random_predicate(rng, depth - 1))


def test_file_skipping_is_sound(spark):
    rng = random.Random(3)
    data = [(f, rng.choice([None, *range(f, f + 4)])) for f in range(9) for _ in range(rng.choice([1, 1, 5]))]
    rows = spark.createDataFrame(data, "f int, x int").cache()
    stats = rows.groupBy("f").agg(F.min("x").alias("x_lower"), F.max("x").alias("x_upper"), F.sum(F.col("x").isNull().cast("long")).alias("x_nulls"), F.count("*").alias("record_count"), F.lit(0).alias("x_nans")).cache()
    for _ in range(25):
        e = random_predicate(rng)
        got = {r.f: (r.may, r.must) for r in stats.select("f", P.may_match(e).alias("may"), P.must_match(e).alias("must")).collect()}
        hits = {r.f: (r.n, r.m) for r in rows.groupBy("f").agg(F.count(F.when(P.to_column(e), 1)).alias("n"), F.count("*").alias("m")).collect()}
        for f, (n, m) in hits.items():
            assert got[f][0] or n == 0, e
            assert not got[f][1] or n == m, e


def test_partition_projection():
    spec = {"b": ("x", "bucket[16]"), "t": ("x", "truncate[10]"), "i": ("y", "identity")}
    assert P.partition_filter(P.Leaf("=", "x", 34), spec) == P.And(P.Leaf("=", "b", 3), P.Leaf("=", "t", 30))
    assert P.partition_filter(P.Not(P.Leaf("=", "x", 34)), spec) == P.TRUE
    assert P.partition_filter(P.And(P.Leaf("<", "x", 25), P.Leaf("in", "y", (1,))), spec) == P.And(P.Leaf("<=", "t", 20), P.Leaf("in", "i", (1,)))


def test_deletion_vectors_round_trip_and_runs():
    import struct
    import zlib

    import numpy as np

    from tidemill.sources import lakehouse as lh

    rng = np.random.default_rng(1)
    for p in ([], [0], [7, 65535, 65536, 1 << 33], rng.integers(0, 1 << 20, 9000), np.arange(100_000)):
        want = np.unique(np.asarray(p, np.int64))
        assert (lh.decode_deletion_vector(lh.encode_deletion_vector(want)) == want).all()
    body = struct.pack("<iQ", lh._DV_MAGIC, 1) + struct.pack("<II", 0, lh._RUNS) + b"\x01" + struct.pack("<HH", 0, 9) + struct.pack("<HHHHH", 2, 5, 3, 20, 5)
    blob = struct.pack(">i", len(body)) + body + struct.pack(">I", zlib.crc32(body))
    assert lh.decode_deletion_vector(blob).tolist() == [*range(5, 9), *range(20, 26)]
    import pytest

    with pytest.raises(ValueError, match="deletion vector"):
        lh.decode_deletion_vector(blob[:-1] + b"x")

"""Table formats as plans over their metadata: snapshots, logs, timelines, files, deletes, upkeep.

Metadata is DataFrames, so that a table of a million files is planned by the cluster,
and walks along parents are joins too.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import predicates
from tidemill.sources import sinks

# --- snapshots: snapshot_id, parent_id, ts


def current(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("ts"), F.desc("snapshot_id")).limit(1)


def as_of(snapshots: DataFrame, ts) -> DataFrame:
    """The last snapshot at or before the time."""
    return current(snapshots.filter(F.col("ts") <= ts))


def by_ref(snapshots: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    return snapshots.join(F.broadcast(refs.filter(F.col("name") == name).limit(1).select("snapshot_id")), "snapshot_id")


def lineage(snapshots: DataFrame, snapshot_id: int, until: int | None = None) -> DataFrame:
    """(snapshot_id, depth): a snapshot at depth 0 and its ancestors, at least as far as ``until``.

    Each round follows jumps of twice the length, so the rounds are logarithmic in the
    depth.  They are written, as the plan would double with each.
    """

    def saved(df: DataFrame) -> DataFrame:
        path = sinks.shared_path(df.sparkSession, "lineage")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    line = saved(snapshots.filter(F.col("snapshot_id") == snapshot_id).select("snapshot_id", F.lit(0).cast("long").alias("depth")))
    own = snapshots.select(F.col("parent_id").alias("snapshot_id"), F.col("snapshot_id").alias("_from"))
    jumps = saved(own.join(snapshots.select("snapshot_id"), "snapshot_id", "left_semi").select("_from", F.col("snapshot_id").alias("_to")))
    step, n = 1, line.count()
    while n and (until is None or line.filter(F.col("snapshot_id") == until).isEmpty()):
        more = line.join(jumps, F.col("snapshot_id") == F.col("_from")).select(F.col("_to").alias("snapshot_id"), (F.col("depth") + step).alias("depth"))
        line = saved(line.unionAll(more).groupBy("snapshot_id").agg(F.min("depth").alias("depth")))  # a cycle is gone round once
        before, n = n, line.count()
        if n == before:
            break
        jumps = saved(jumps.join(jumps.select(F.col("_from").alias("_to"), F.col("_to").alias("_next")), "_to").select("_from", F.col("_next").alias("_to")))
        step *= 2
    return line


def ancestors(snapshots: DataFrame, snapshot_id: int) -> list[int]:
    """From a snapshot back along its parents, itself first."""
    return [r[0] for r in lineage(snapshots, snapshot_id).orderBy("depth").collect()]  # a row an ancestor


def lineage_between(snapshots: DataFrame, after: int, to: int) -> DataFrame:
    """(snapshot_id, depth): ancestors of ``to`` past ``after``, which is left out."""
    line = lineage(snapshots, to, after)
    end = line.filter(F.col("snapshot_id") == after).first()
    if end is None:
        raise ValueError(f"{after} is no ancestor of {to}")
    return line.filter(F.col("depth") < end["depth"])


def between(snapshots: DataFrame, after: int, to: int) -> list[int]:
    return [r[0] for r in lineage_between(snapshots, after, to).orderBy("depth").collect()]


# --- files: file_path, status (added, existing, deleted), snapshot_id, statistics


def live_files(entries: DataFrame) -> DataFrame:
    return entries.filter("status <> 'deleted'")


def prune(files: DataFrame, predicate) -> DataFrame:
    """Files that may hold matching rows, with ``residual``: whether the rows must still be filtered."""
    return files.filter(predicates.may_match(predicate)).withColumn("residual", ~predicates.must_match(predicate))


def appended(entries: DataFrame, snapshot_ids: list[int]) -> DataFrame:
    return entries.filter((F.col("status") == "added") & F.col("snapshot_id").isin(*snapshot_ids))


def changes(entries: DataFrame, snapshot_ids: list[int]) -> DataFrame:
    """Tasks of a changelog scan: files that came (insert) or went (delete)."""
    rows = entries.filter(F.col("status").isin("added", "deleted") & F.col("snapshot_id").isin(*snapshot_ids))
    return rows.withColumn("change", F.when(F.col("status") == "added", "insert").otherwise("delete"))


def applicable_deletes(files: DataFrame, deletes: DataFrame) -> DataFrame:
    """(file_path, delete_path): position deletes from the file's sequence on, equality deletes after it."""
    d = deletes.select(F.col("file_path").alias("delete_path"), F.col("sequence").alias("d_sequence"), "kind", "partition")
    newer = F.when(F.col("kind") == "position", F.col("d_sequence") >= F.col("sequence")).otherwise(F.col("d_sequence") > F.col("sequence"))
    return files.join(d, "partition").filter(newer).select("file_path", "delete_path", "kind")


def bin_pack(files: DataFrame, target: int, size: str = "size") -> DataFrame:
    """Files in groups of about ``target`` bytes, in the order of their paths: group by running total."""
    run = F.sum(size).over(Window.partitionBy("partition").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("bin", F.floor(F.coalesce(run, F.lit(0)) / target).cast("long"))


def summary(entries: DataFrame) -> DataFrame:
    """Counts of a snapshot's files and rows by status; what is zero has no row."""
    out = entries.groupBy("snapshot_id", "status").agg(F.count("*").alias("files"), F.sum("record_count").alias("records"))
    kind = F.concat_ws("-", F.col("status"), F.lit("files")), F.concat_ws("-", F.col("status"), F.lit("records"))
    pairs = F.explode(F.array(F.struct(kind[0].alias("k"), F.col("files").alias("v")), F.struct(kind[1].alias("k"), F.col("records").alias("v"))))
    return out.select("snapshot_id", pairs.alias("p")).select("snapshot_id", F.col("p.k").alias("key"), F.col("p.v").alias("value")).filter("value <> 0")


def expired(snapshots: DataFrame, refs: DataFrame, now, max_age: Column, keep_last: int = 1) -> DataFrame:
    """Snapshots to expire: none that a ref names, none of the newest, none younger than the age."""
    kept = refs.select("snapshot_id")
    newest = snapshots.orderBy(F.desc("ts"), F.desc("snapshot_id")).limit(max(1, keep_last)).select("snapshot_id")
    old = snapshots.filter(F.col("ts") + max_age < now)
    return old.join(kept.unionAll(newest), "snapshot_id", "left_anti")


def orphans(listing: DataFrame, referenced: DataFrame) -> DataFrame:
    return listing.join(referenced.select("file_path"), "file_path", "left_anti")


def scan(spark: SparkSession, entries: DataFrame, predicate, columns: list[str], positions: DataFrame | None = None, equals: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """Rows of a snapshot: live files that may match are read, deletes applied, the predicate and the projection last.

    ``entries`` has file paths with bounds; ``positions`` (file_path, pos) and ``equals`` are deletes.
    """
    from tidemill.operators import joins

    wanted = prune(live_files(entries), predicate)
    paths = [r[0] for r in wanted.select("file_path").distinct().toLocalIterator()]  # what pruning left
    if not paths:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    rows = spark.read.parquet(*paths).withColumn("file_path", F.col("_metadata.file_path")).withColumn("pos", F.col("_metadata.row_index"))
    if positions is not None:
        rows = joins.without_positions(rows, positions)
    if equals is not None:
        rows = joins.without_equals(rows, *equals)
    return rows.filter(predicates.to_column(predicate)).select(*columns)


# Magic number and cookies of the public deletion-vector and Roaring bitmap formats.
_DV_MAGIC, _NO_RUNS, _RUNS = 1681511377, 12346, 12347


def encode_deletion_vector(positions) -> bytes:
    """Positions as a deletion-vector blob: length, magic, a 64-bit Roaring bitmap by high halves, checksum."""
    p = np.unique(np.asarray(positions, np.uint64))
    high = (p >> np.uint64(32)).astype(np.uint32)
    body = struct.pack("<iQ", _DV_MAGIC, len(np.unique(high)))
    for h in np.unique(high).tolist():
        low = p[high == h].astype(np.uint32)
        keys, at = np.unique(low >> np.uint32(16), return_index=True)
        parts = [x.astype(np.uint16) for x in np.split(low & np.uint32(0xFFFF), at[1:])]
        data = []
        for x in parts:
            if len(x) <= 4096:
                data.append(x.astype("<u2").tobytes())
            else:
                bits = np.zeros(65536, np.uint8)
                bits[x] = 1
                data.append(np.packbits(bits, bitorder="little").tobytes())
        head = struct.pack("<III", h, _NO_RUNS, len(keys)) + b"".join(struct.pack("<HH", k, len(x) - 1) for k, x in zip(keys.tolist(), parts, strict=True))
        begin = len(head) - 4 + 4 * len(keys)  # offsets count from the cookie
        offsets = np.cumsum([begin, *(len(x) for x in data)])[:-1]
        body += head + offsets.astype("<u4").tobytes() + b"".join(data)
    return struct.pack(">i", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def decode_deletion_vector(blob: bytes) -> np.ndarray:
    """The positions of a deletion-vector blob; array, bitmap and run containers."""
    size = struct.unpack_from(">i", blob)[0]
    body = blob[4 : 4 + size]
    magic, n = struct.unpack_from("<iQ", body)
    if magic != _DV_MAGIC or zlib.crc32(body) != struct.unpack_from(">I", blob, 4 + size)[0]:
        raise ValueError("not a deletion vector, or a damaged one")
    at, out = 12, []
    for _ in range(n):
        high, cookie = struct.unpack_from("<II", body, at)
        at += 8
        runs, count = b"", 0
        if cookie & 0xFFFF == _RUNS:
            count = (cookie >> 16) + 1
            runs = body[at : at + (count + 7) // 8]
            at += len(runs)
        elif cookie == _NO_RUNS:
            count = struct.unpack_from("<I", body, at)[0]
            at += 4
        else:
            raise ValueError("not a Roaring bitmap")
        heads = np.frombuffer(body, "<u2", 2 * count, at).reshape(-1, 2).astype(np.int64)
        at += 4 * count
        if not runs or count >= 4:
            at += 4 * count  # offsets: containers follow in order anyway
        for i, (key, last) in enumerate(heads.tolist()):
            if runs and runs[i // 8] >> (i % 8) & 1:
                k = struct.unpack_from("<H", body, at)[0]
                pairs = np.frombuffer(body, "<u2", 2 * k, at + 2).reshape(-1, 2).astype(np.int64)
                low = np.concatenate([np.arange(s, s + m + 1) for s, m in pairs.tolist()])
                at += 2 + 4 * k
            elif last + 1 <= 4096:
                low = np.frombuffer(body, "<u2", last + 1, at).astype(np.int64)
                at += 2 * (last + 1)
            else:
                low = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8, 8192, at), bitorder="little"))
                at += 8192
            out.append((high << 32) + (key << 16) + low)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def deleted_positions(vectors: DataFrame) -> DataFrame:
    """(file_path, pos) of deletion vectors (file_path, blob): a position delete for each bit."""

    def run(batches):
        for b in batches:
            for path, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pos = decode_deletion_vector(blob)
                for k in range(0, len(pos), 65536):
                    part = pos[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(part)], names=["file_path", "pos"])

    return vectors.select("file_path", "blob").mapInArrow(run, "file_path string, pos long")


def read_hudi(spark: SparkSession, table: str, instant: str | None = None) -> DataFrame:
    """The rows of a timeline folder's newest file slices, up to an instant: commits are JSON with their write statistics."""
    text = spark.read.text(f"{table}/.hoodie/*", wholetext=True).withColumn("name", F.element_at(F.split("_metadata.file_path", "/"), -1))
    stats = F.from_json("value", "partitionToWriteStats map<string,array<struct<fileId:string,path:string>>>, partitionToReplaceFileIds map<string,array<string>>")
    timeline = text.select(F.regexp_extract("name", r"^(\d+)\.(commit|deltacommit|replacecommit)$", 1).alias("instant"), F.regexp_extract("name", r"^(\d+)\.(commit|deltacommit|replacecommit)$", 2).alias("action"), stats.alias("s")).filter("instant <> ''")
    rows = timeline.select("instant", "action", "s.partitionToReplaceFileIds", F.explode("s.partitionToWriteStats").alias("partition", "w")).select("instant", "action", "partition", F.element_at("partitionToReplaceFileIds", F.col("partition")).alias("replaced"), F.explode("w").alias("w"))
    commits = rows.select("instant", "action", F.lit("completed").alias("state"), "partition", F.col("w.fileId").alias("file_id"), F.col("w.path").alias("path"), "replaced")
    paths = [f"{table}/{r[0]}" for r in hudi_slices(commits, instant).select("path").toLocalIterator()]
    return spark.read.parquet(*paths)


# --- logs


def delta_actions(spark: SparkSession, table: str) -> DataFrame:
    """The action rows of a JSON transaction log with their version."""
    schema = "add struct<path:string,size:long,dataChange:boolean,stats:string,partitionValues:map<string,string>>, remove struct<path:string,dataChange:boolean>, metaData struct<id:string,schemaString:string,partitionColumns:array<string>>, protocol struct<minReaderVersion:int,minWriterVersion:int>, commitInfo struct<operation:string,timestamp:long>"
    rows = spark.read.schema(schema).json(f"{table}/_delta_log/*.json")
    return rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).cast("long"))


def delta_files(actions: DataFrame, version: int | None = None) -> DataFrame:
    """Files that are active at a version: the last action on each path adds it."""
    if version is not None:
        actions = actions.filter(F.col("version") <= version)
    path = F.coalesce("add.path", "remove.path")
    last = actions.filter("add IS NOT NULL OR remove IS NOT NULL").groupBy(path.alias("path")).agg(F.max_by("add", F.struct("version", F.col("add").isNotNull())).alias("add"))
    return last.filter("add IS NOT NULL").select("path", "add.size", "add.stats")


def delta_history(actions: DataFrame) -> DataFrame:
    return actions.filter("commitInfo IS NOT NULL").select("version", "commitInfo.operation", "commitInfo.timestamp").orderBy(F.desc("version"))


def delta_schema(actions: DataFrame) -> T.StructType:
    row = actions.filter("metaData IS NOT NULL").orderBy(F.desc("version")).select("metaData.schemaString").first()
    return T.StructType.fromJson(__import__("json").loads(row[0]))


def read_delta(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    actions = delta_actions(spark, table)
    paths = [f"{table}/{r['path']}" for r in delta_files(actions, version).select("path").toLocalIterator()]
    return spark.read.schema(delta_schema(actions)).parquet(*paths) if paths else spark.createDataFrame([], delta_schema(actions))


def hudi_instants(names: list[str]) -> list[tuple[str, str, str]]:
    """(instant, action, state) of timeline file names; names that are none are left out."""
    out = []
    for n in names:
        m = re.fullmatch(r"(\d+)\.(commit|deltacommit|replacecommit|clean|savepoint|rollback|compaction)(?:\.(requested|inflight))?", n)
        if m:
            out.append((m[1], m[2], m[3] or "completed"))
    return sorted(out)


def hudi_slices(commits: DataFrame, instant: str | None = None) -> DataFrame:
    """The newest slice of each file group from completed commits up to an instant.

    ``commits``: instant, action, state, partition, file_id, path, replaced (file ids).
    """
    done = commits.filter("state = 'completed' AND action IN ('commit', 'deltacommit', 'replacecommit')")
    if instant is not None:
        done = done.filter(F.col("instant") <= instant)
    gone = done.select("partition", F.explode("replaced").alias("file_id"), F.col("instant").alias("at"))
    gone = gone.groupBy("partition", "file_id").agg(F.max("at").alias("at"))
    last = done.groupBy("partition", "file_id").agg(F.max_by(F.struct("instant", "path"), "instant").alias("s")).select("partition", "file_id", "s.*")
    return last.join(gone, ["partition", "file_id"], "left").filter("at IS NULL OR instant > at").drop("at")


def lance_version(manifests: DataFrame, version: int | None = None) -> DataFrame:
    """The fragments' data files of the latest, or of a given, version (version, fragment_id, files)."""
    wanted = manifests.filter(F.col("version") == version) if version is not None else manifests.join(F.broadcast(manifests.agg(F.max("version").alias("version"))), "version")
    return wanted.select("version", "fragment_id", F.explode("files").alias("file_path"))


# --- schemas

_WIDER = {("int", "bigint"), ("float", "double"), ("date", "timestamp"), ("date", "timestamp_ntz"), ("int", "double"), ("void", None)}


def may_promote(old: T.DataType, new: T.DataType) -> bool:
    if old == new or isinstance(old, T.NullType):
        return True
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return old.scale == new.scale and new.precision >= old.precision
    return (old.simpleString(), new.simpleString()) in {("int", "bigint"), ("float", "double"), ("date", "timestamp"), ("date", "timestamp_ntz")}


def evolution_errors(old: T.StructType, new: T.StructType, defaults: dict | None = None) -> list[str]:
    """What forbids to read old data under the new schema; none if nothing does."""
    out, before = [], {f.name: f for f in old}
    for f in new:
        if f.name not in before:
            if not f.nullable and f.name not in (defaults or {}):
                out.append(f"{f.name}: a required field without a default was added")
            continue
        b = before[f.name]
        if not may_promote(b.dataType, f.dataType):
            out.append(f"{f.name}: {b.dataType.simpleString()} cannot become {f.dataType.simpleString()}")
        if b.nullable and not f.nullable:
            out.append(f"{f.name}: an optional field became required")
    out += [f"{f.name}: a required field was dropped" for f in old if not f.nullable and f.name not in new.names]
    return out


def resolve(df: DataFrame, reader: T.StructType, aliases: dict[str, list[str]] | None = None, defaults: dict | None = None) -> DataFrame:
    """Data of a writer's schema under a reader's: by name or alias, promoted, with defaults for what is missing."""
    columns = []
    for f in reader:
        own = next((n for n in (f.name, *(aliases or {}).get(f.name, ())) if n in df.columns), None)
        if own is not None:
            if not may_promote(df.schema[own].dataType, f.dataType) and (df.schema[own].dataType.simpleString(), f.dataType.simpleString()) not in {("int", "float"), ("int", "double"), ("bigint", "float"), ("bigint", "double"), ("string", "binary"), ("binary", "string")}:
                raise ValueError(f"{f.name}: {df.schema[own].dataType.simpleString()} does not resolve to {f.dataType.simpleString()}")
            columns.append(F.col(own).cast(f.dataType).alias(f.name))
        elif f.name in (defaults or {}) or f.nullable:
            columns.append(F.lit((defaults or {}).get(f.name)).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"{f.name}: missing, without a default")
    return df.select(*columns)


def project_ids(df: DataFrame, ids: dict[int, str], wanted: list[int]) -> DataFrame:
    """Columns by field id; an error if none of them is there."""
    names = [ids[i] for i in wanted if i in ids]
    if not names:
        raise ValueError("no such fields")
    return df.select(*names)

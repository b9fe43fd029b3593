"""Line dedup over levelled sorted runs of line hashes.

Method.  ``LineRuns`` keeps, in a shared folder, runs of (hash, documents that
hold the line, largest such document), each bucketed and sorted by hash; a hash is
in one run only.  Batches of documents come largest ids first.  Each is reduced to such
rows and merge-anti-joined with the runs: hashes that nobody held before become a run
of level 0, and the document they come with keeps the line, as all later ones are
smaller.  Of hashes held before only the count goes to a second set of runs.  As
soon as a level has ``fanout`` runs they are merged into one of the next level, so
a hash is rewritten only a logarithmic number of times.  The verdict adds up, for each
hash of the runs, its own count and the later ones.  Runs have as many buckets as the
session has shuffle partitions, so neither the anti-join nor a merge moves them.

The hash has 128 bits.  Lines are reduced to a row per document and hash before
any shuffle, and to a row per hash and task before the one by hash, so a line
that a third of all documents hold costs a row per task.  Texts meet the lines
to drop in one shuffled-hash join by document; its build side holds hashes only.

Defined results: null or empty text is one empty line; a null document id never
counts as the largest, and its repeated lines go; rows that repeat a doc_id are
one document for the count, and all of the largest id keep their lines; ids may be
numbers or strings; very long texts are cut line by line like others; ties cannot
occur otherwise; an empty table gives an empty result.
Other columns of the input pass through where the text is rewritten, but for its own
``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, shuffles_removed, text_parts

#: Ids of several rows that may be broadcast; with more, all rows are made distinct by a shuffle.
REPEATED_BROADCAST = 1 << 20
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: str, least: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None if the key is short."""
    s = line.strip(BLANK)
    if len(s) < least:
        return None
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass").lower())  # bytes: only A-Z are lowered


def line_keys(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, row, key) for each document and distinct long line of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_parts(batches):
            ids, at, keys = b.column(0), [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text:
                    own = {line_key(x, least) for x in text.split("\n")} - {None}
                    keys += own
                    at += [i] * len(own)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, key binary")


class LineRuns:
    """Levelled sorted runs in a folder all executors see: ``new`` of (key, n_docs, last_doc), ``again`` of (key, n_docs)."""

    def __init__(self, scratch: Scratch, fanout: int = 4):
        self.scratch, self.fanout = scratch, fanout
        self.levels: dict[str, list[list[str]]] = {"new": [], "again": []}
        self.made, self.tables = 0, f"tidemill_{uuid.uuid4().hex}"

    def names(self, kind: str = "new") -> list[str]:
        return [n for level in self.levels[kind] for n in level]

    def read(self, names: list[str]) -> DataFrame:
        out = None
        for n in names:
            part = self.scratch.spark.table(f"{self.tables}_{n}")
            out = part if out is None else out.unionAll(part)
        return out

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}{self.made}"
        self.made += 1
        n = max(1, int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions")))
        with shuffles_removed(self.scratch.spark):
            rows.write.bucketBy(n, "key").sortBy("key").format("parquet").option("path", self.scratch.path(name)).saveAsTable(f"{self.tables}_{name}")
        return name

    def _put(self, rows: DataFrame, kind: str, level: int = 0) -> None:
        levels = self.levels[kind]
        while len(levels) <= level:
            levels.append([])
        levels[level].append(self._write(rows, kind))
        if len(levels[level]) >= self.fanout:
            old, levels[level] = levels[level], []
            both = self.read(old)
            self._put(both.groupBy("key").agg(F.sum("n_docs").alias("n_docs")) if kind == "again" else both, kind, level + 1)
            self._drop(old)

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.scratch.spark.sql(f"DROP TABLE IF EXISTS {self.tables}_{n}")
        self.scratch.drop(*names)

    def drop(self) -> None:
        for kind, levels in self.levels.items():
            self._drop(self.names(kind))
            levels.clear()

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The batch's rows whose key no run holds: a merge anti-join of sorted sides."""
        for n in self.names():
            batch = batch.join(self.read([n]).select("key").hint("merge"), "key", "left_anti")
        return batch

    def seen(self, batch: DataFrame) -> DataFrame:
        """The batch's rows whose key a run holds already."""
        out = None
        for n in self.names():
            part = batch.join(self.read([n]).select("key").hint("merge"), "key", "left_semi")
            out = part if out is None else out.unionAll(part)  # a key is in one run only
        return out if out is not None else batch.limit(0)

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (doc_id, key) rows, whose ids are smaller than those of all batches before."""
        batch = keys.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if self.names():
            name = self._write(batch, "batch")
            batch = self.read([name])
            known = self.seen(batch).select("key", "n_docs")
            self._put(known, "again")
            self._put(self.unseen(batch), "new")
            self._drop([name])
        else:
            self._put(batch, "new")

    def verdict(self, least_docs: int) -> DataFrame:
        """Keys that at least so many documents hold, with the document that keeps the line."""
        new = self.read(self.names())
        if not self.names("again"):
            return new.filter(F.col("n_docs") >= least_docs).select("key", "last_doc")
        more = self.read(self.names("again")).groupBy("key").agg(F.sum("n_docs").alias("more"))
        total = F.col("n_docs") + F.coalesce("more", F.lit(0))
        return new.join(more, "key", "left").filter(total >= least_docs).select("key", "last_doc")


def cuts(docs: DataFrame, batches: int, id_col: str) -> list:
    """Ids that part the documents into about so many batches of like size, ascending; of any type that can be ordered."""
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id IS NOT NULL").repartitionByRange(batches, "doc_id")
    firsts = sorted(r[0] for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first")).select("first").collect())  # a row a partition
    return [firsts[k * len(firsts) // batches] for k in range(1, batches) if len(firsts) >= batches]


def dropped_lines(docs: DataFrame, scratch: Scratch, least_chars: int = 40, least_docs: int = 5, batches: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, keys): the hashes of the lines that each document loses.

    The documents enter the runs in ``batches`` batches, largest ids first.
    """
    keys = scratch.save(line_keys(docs, least_chars, id_col), "keys")
    repeated = docs.groupBy(F.col(id_col).alias("doc_id")).count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = scratch.save(repeated, "repeated")
    n = repeated.count()
    once = keys
    if n > REPEATED_BROADCAST:
        once = keys.filter("doc_id IS NOT NULL").distinct().unionAll(keys.filter("doc_id IS NULL"))
    elif n:  # rows of one id count as one document
        several = F.broadcast(repeated)
        once = keys.join(several, "doc_id", "left_anti").unionByName(keys.join(several, "doc_id", "left_semi").distinct())
    runs = LineRuns(scratch)
    edges = [None, *cuts(docs, batches, id_col), None]
    for i in reversed(range(len(edges) - 1)):
        own = F.col("doc_id").isNull() if i == 0 else F.lit(False)  # rows without an id come last
        inside = F.col("doc_id").isNotNull()
        if edges[i] is not None:
            inside = inside & (F.col("doc_id") >= edges[i])
        if edges[i + 1] is not None:
            inside = inside & (F.col("doc_id") < edges[i + 1])
        runs.add(once.filter(own | inside))
    hot = scratch.save(runs.verdict(least_docs), "hot")  # written, so that the join below can split a hot key
    lost = keys.join(hot, "key").filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last_doc")))
    lost = scratch.save(lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "lost")
    runs.drop()
    scratch.drop("keys", "repeated", "hot")
    return lost


def rewrite(docs: DataFrame, lost: DataFrame, least_chars: int = 40, text_col: str = "text") -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and the text that stays, as ``text``."""
    docs = docs.drop("n_lines", "n_dropped")
    lost = lost.select(F.col("doc_id").alias("_lost_id"), F.col("keys").alias("_lost_keys"))
    both = docs.join(lost.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(lost["_lost_id"]), "left").drop("_lost_id")
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_parts(batches, at):
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                if keys:
                    gone = set(keys)
                    kept = [x for x in lines if line_key(x, least_chars) not in gone]
                    texts.append("\n".join(kept))
                else:
                    kept = lines
                    texts.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "n_lines", "n_dropped"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return both.mapInArrow(run, f"{out}, n_lines long, n_dropped long")


def dedup_lines(spark: SparkSession, docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Documents whose lines that ``least_docs`` documents share stay only in the largest doc_id."""
    scratch = Scratch(spark, "line-dedup")
    return rewrite(docs, dropped_lines(docs, scratch, least_chars, least_docs), least_chars)

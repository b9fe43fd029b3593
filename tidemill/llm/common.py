"""What the operators share: scratch tables in the shared folder and Arrow columns as numpy."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is one made here.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidemill-"))
    return _own[0]


class Scratch:
    """Tables written once to the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_removed(self.spark):
            df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def left(self, prefix: str) -> list[str]:
        """Names of the tables that still stand and begin so."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [n for n in (f.getPath().getName() for f in files.listStatus(path)) if n.startswith(prefix)]


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, an action's shuffle files go as soon as it has ended, as what it wrote is read from then on;
    and Arrow batches are small, as whole texts may be long.  The session's settings come back afterwards."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * PART_BYTES)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Bytes of text that a worker handles at once.
PART_BYTES = 1 << 20


def text_parts(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = PART_BYTES, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none has more than ``most`` bytes of text or ``rows`` rows, unless a single row has.

    Spark bounds a batch by bytes and rows of its own (``spark.sql.execution.arrow.*``);
    what is worked out beside the texts takes many times their size, hence smaller parts.
    """
    for b in batches:
        if b.num_rows <= 1:
            yield b
            continue
        size = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(text)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < b.num_rows:
            done = int(size[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(size, done + most, side="right"))))
            yield b.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give memory that a task has freed back to the machine: a worker lives on, and so would its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RADIX = np.uint64(0x9E3779B97F4A7C15)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def word_hashes(offsets: np.ndarray, raw: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, their first bytes, and each text's first word."""
    hashes, begin, _, first = word_spans(offsets, raw, is_word, fold)
    return hashes, begin, first


def word_spans(offsets: np.ndarray, raw: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of each text, without a loop over them.

    ``is_word`` and ``fold`` are tables over the 256 byte values: what belongs to
    a word, and what a byte is taken for.  Returns the hashes of all words in
    order, the bytes at which each begins and ends, and for each text the number of
    its first word (n + 1 values).  A word's hash is the sum of its bytes' values,
    each times a random odd multiplier of its place, modulo 2**64 (multilinear
    hashing): equal words have equal hashes wherever they stand, and as the
    multipliers follow no rule of each other, no rule makes different words collide.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    word = is_word[raw]
    left = np.empty(len(raw), bool)
    left[0] = True
    np.logical_not(word[:-1], out=left[1:])
    inner = offsets[1:-1]
    left[inner[inner < len(raw)]] = True
    begin = np.flatnonzero(word & left)
    right = np.empty(len(raw), bool)
    right[-1] = True
    np.logical_not(word[1:], out=right[:-1])
    right[inner[inner > 0] - 1] = True
    end = np.flatnonzero(word & right) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end, np.zeros(len(offsets), np.int64)
    values = np.where(word, _VALUES[fold[raw]], np.uint64(0))
    hashes = np.zeros(len(begin), np.uint64)
    place = np.arange(len(raw), dtype=np.int64)
    owner = np.repeat(np.arange(len(begin)), end - begin)
    inside = np.flatnonzero(word)
    power = _multipliers(int((end - begin).max()))
    terms = values[inside] * power[place[inside] - begin[owner]]
    np.add.reduceat(terms, np.concatenate([[0], np.cumsum(end - begin)[:-1]]), out=hashes)
    return mix(hashes), begin, end, np.searchsorted(begin, offsets).astype(np.int64)


_multiplier_table = np.zeros(0, np.uint64)


def _multipliers(n: int) -> np.ndarray:
    """The odd multipliers of the first n places of a word, by a counter through the finaliser."""
    global _multiplier_table
    if len(_multiplier_table) < n:
        many = max(n, 256)
        if many > 1 << 20:  # a word as long as that is not worth keeping
            return mix(np.arange(1, n + 1, dtype=np.uint64) * _RADIX) | np.uint64(1)
        _multiplier_table = mix(np.arange(1, many + 1, dtype=np.uint64) * _RADIX) | np.uint64(1)
    return _multiplier_table


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k words of one sequence."""
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * _RADIX + words[i : i + n])
    return out

"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous supersteps.

Method.  Every document becomes pieces of at most ``capacity`` tokens.  The pieces
are range-sorted by length, largest first, and ranked within their length, all in
distributed sorts: a task knows the rank of its rows but for an offset, and only
the counts by task and length reach the driver (at most tasks + capacity numbers,
as sorted tasks hold adjoining lengths).

A superstep takes the pieces of one length.  Its sweep looks for the successor of
that length among the gaps that are left in open sequences: the least gap that
still holds it.  Pieces that compete for the same gaps are told apart by rank: the
i-th piece takes the i-th place.  Then the gaps are updated and the next, smaller
length follows.  As equal pieces and equal gaps are runs of consecutive ranks and
of consecutive sequence numbers, a whole run is matched at once, and a superstep
adds at most a few runs; the sweep's state is therefore bounded by the capacity,
whatever the number of documents.  The matches are applied to the pieces where
they lie, by a search of the rank.  The result is that of best-fit decreasing.

A hot length costs nothing extra: its rows are spread by (length, id, piece).

Defined results: null or empty text is a document of the one end token; repeated
rows are packed each; ties of length are ordered by id and piece; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, as_bytes, text_parts, word_spans

#: Words whose ids a worker remembers (some 40 bytes each); beyond that only those it met again since the last time are kept.
CACHED_WORDS = 1_000_000
#: New words that go to the tokenizer as one text, and what may stand between them.
JOINED_WORDS = 200
MARKS = "\x01\x02\x1f~"
_encoders: dict[tuple[str, int], Encoder] = {}

_IS_WORD = np.ones(256, bool)
_IS_WORD[[10, 32]] = False
_PLAIN = np.arange(256, dtype=np.uint8)


class Encoder:
    """Token ids of whole texts by a public tokenizer that drops white space.

    Such a tokenizer never joins across a space or line end, so a text's ids are
    those of its words in turn; one that does not is refused.  The ids of words are remembered in flat arrays
    under 64-bit hashes; only words not remembered reach the tokenizer, many in one text with a mark after each:
    most of the time of a short text is not spent on its words.  A text with another number of marks than words
    has a word that holds the mark; its words are encoded one by one.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id
        probe = ["a b", "a", "b", "a\nb\n", " a  b"]
        own = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in probe]
        if not own[0] == own[1] + own[2] == own[3] == own[4]:
            raise ValueError("the tokenizer joins words across white space")
        self.mark, self.mark_id = "", 0
        for mark in MARKS:
            alone, between = self._ids([mark, f"a {mark} b"])
            if len(alone) == 1 and between == own[1] + alone + own[2]:
                self.mark, self.mark_id = mark, alone[0]
                break
        self._forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)  # met again since it was learned, or since others were forgotten
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    def _make_room(self, coming: int) -> None:
        """Forget words not met again, or all where that does not make room enough."""
        kept = self.again
        if int(kept.sum()) + coming > CACHED_WORDS:
            self._forget()
            return
        n, at = self.n[kept], self.at[kept]
        begin = np.cumsum(n, dtype=np.int64) - n
        store = self.store[np.arange(int(n.sum())) + np.repeat(at - begin, n)]
        self.keys, self.at, self.n, self.again = self.keys[kept], begin, n, np.zeros(len(n), bool)
        self.store, self.used = np.concatenate([store, np.zeros(1 << 16, np.uint32)]), len(store)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in one array, and how many each has."""
        flat, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for i in range(0, len(words), 100 * JOINED_WORDS):
            some = words[i : i + 100 * JOINED_WORDS]
            groups = [some[k : k + JOINED_WORDS] for k in range(0, len(some), JOINED_WORDS)]
            joined = self._ids([f" {self.mark} ".join([*g, ""]) for g in groups]) if self.mark else [[]] * len(groups)
            for g, own in zip(groups, joined, strict=True):
                ids = np.array(own, np.uint32)
                ends = np.flatnonzero(ids == self.mark_id)
                if len(ends) == len(g):
                    flat.append(np.delete(ids, ends))
                    n.append(np.diff(ends, prepend=-1).astype(np.int32) - 1)
                else:  # a word holds the mark, or there is none
                    each = self._ids(g)
                    flat += [np.array(x, np.uint32) for x in each]
                    n.append(np.fromiter(map(len, each), np.int32, len(each)))
        return np.concatenate(flat), np.concatenate(n)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words (hashes sorted, none known)."""
        flat, n = self._encode_words(words)
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(len(self.store), np.uint32)])
        self.store[self.used : self.used + len(flat)] = flat
        place = np.searchsorted(self.keys, hashes)
        self.at = np.insert(self.at, place, self.used + np.cumsum(n) - n)
        self.n = np.insert(self.n, place, n)
        self.keys = np.insert(self.keys, place, hashes)
        self.again = np.insert(self.again, place, False)
        self.used += len(flat)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, each text's end id last, and where each text begins (n + 1 values)."""
        offsets, raw = as_bytes(column)
        hashes, begin, end, first = word_spans(offsets, raw, _IS_WORD, _PLAIN)
        known, example, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(known) > CACHED_WORDS:
            self._make_room(len(known))
        place = np.searchsorted(self.keys, known)
        new = np.ones(len(known), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != known[inside]
        self.again[place[~new]] = True
        if new.any():
            data = raw.tobytes()
            self._learn(known[new], [data[begin[i] : end[i]].decode() for i in example[new].tolist()])
            place = np.searchsorted(self.keys, known)
        place = place[back]
        n = self.n[place].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        text = np.arange(len(offsets) - 1)
        starts = total[first] + np.arange(len(offsets))  # an end id for each text before
        out = np.empty(int(starts[-1]), np.uint32)
        owner = np.repeat(text, np.diff(total[first]))
        source = np.arange(int(total[-1])) + np.repeat(self.at[place] - total[:-1], n)
        out[np.arange(int(total[-1])) + owner] = self.store[source]
        out[starts[1:] - 1] = self.end
        return out, starts


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        e = encoder(tokenizer, end_id)
        for b in text_parts(batches, rows=500):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            ids, starts = e.encode(b.column(1))
            data = memoryview(ids.astype("<u4").view(np.uint8))
            for i, (first, last) in enumerate(zip((4 * starts[:-1]).tolist(), (4 * starts[1:]).tolist(), strict=True)):
                for k, at in enumerate(range(first, last, 4 * capacity)):
                    part = data[at : min(last, at + 4 * capacity)]
                    for column, x in zip(rows, (i, k, (at - first) // 4, len(part) // 4, zlib.crc32(part), bytes(part) if keep_ids else None), strict=True):
                        column.append(x)
            columns = [b.column(0).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
            if keep_ids:
                columns.append(pa.array(rows[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def ranked(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[tuple[int, int], int], dict[int, int]]:
    """Rows with their task and local rank by length; the rank at which each task's rows of a length begin; rows by length."""
    columns = rows.schema.names
    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(partitions, F.col("length").desc(), "doc_id", "piece").sortWithinPartitions(F.col("length").desc(), "doc_id", "piece")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), -1, 0
        at = columns.index("length")
        for b in batches:
            length = b.column(at).to_numpy()
            if not len(length):
                continue
            new = np.flatnonzero(np.concatenate([[length[0] != last], length[1:] != length[:-1]]))
            place = np.arange(len(length))
            first = np.zeros(len(length), np.int64)
            first[new] = new
            local = place - np.maximum.accumulate(first)
            head = len(length) if not len(new) else int(new[0])
            local[:head] += seen
            last, seen = length[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(local.astype(np.int64))], names=[*b.schema.names, "task", "local_rank"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = scratch.save(dealt.mapInArrow(number, f"{schema}, task int, local_rank long"), "ranked")
    counts = numbered.groupBy("length", "task").count().collect()  # at most tasks + capacity rows
    begin: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for length, task, n in sorted((r[0], r[1], r[2]) for r in counts):
        begin[length, task] = total.get(length, 0)
        total[length] = begin[length, task] + n
    return numbered, begin, total


def supersteps(total: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit matches by runs: (length, first rank, pieces, pieces in a sequence, first sequence, offset); sequences used."""
    gaps: list[int] = []  # sorted sizes of gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap: first sequence, number
    matches = []
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(total, reverse=True):
        rank, left = 0, total[length]
        at = bisect_left(gaps, length)  # the successor: the least gap that holds it
        while left and at < len(gaps):
            gap = gaps[at]
            own, runs[gap] = runs[gap], []
            each = gap // length
            for i, (first, n) in enumerate(own):
                if not left:
                    runs[gap] += own[i:]
                    break
                full = min(n, left // each)
                if full:
                    matches.append((length, rank, full * each, each, first, capacity - gap))
                    leave(gap - each * length, first, full)
                    rank, left = rank + full * each, left - full * each
                if full < n and left:  # the last pieces go to one more sequence
                    matches.append((length, rank, left, left, first + full, capacity - gap))
                    leave(gap - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    runs[gap].append((first + full, n - full))
            if runs[gap]:
                break  # pieces ran out
            del runs[gap]
            gaps.remove(gap)
            at = bisect_left(gaps, length if not left else gap)
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                matches.append((length, rank, full * each, each, opened, 0))
                leave(capacity - each * length, opened, full)
            if rest:
                matches.append((length, rank + full * each, rest, rest, opened + full, 0))
                leave(capacity - rest * length, opened + full, 1)
            opened += full + bool(rest)
    return matches, opened


def pack(rows: DataFrame, capacity: int, scratch: Scratch | None = None) -> DataFrame:
    """Rows with a ``length`` (1 to capacity), ``doc_id`` and ``piece`` get ``sequence_id`` and ``offset``."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    numbered, begin, total = ranked(rows, scratch)
    matches, _ = supersteps(total, capacity)
    matches.sort()
    table = np.array(matches, np.int64).reshape(-1, 6)
    order = table[:, 0] * (1 << 44) + table[:, 1]  # by length, then rank; ranks stay below 2**44
    shared = spark.sparkContext.broadcast((table, order, begin))  # bounded by tasks and capacity
    columns = rows.schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, order, begin = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            named = dict(zip(b.schema.names, b.columns, strict=True))
            length, task, local = (named[c].to_numpy() for c in ("length", "task", "local_rank"))
            pairs, inverse = np.unique(length * (1 << 20) + task, return_inverse=True)
            starts = np.array([begin[int(p >> 20), int(p & ((1 << 20) - 1))] for p in pairs], np.int64)
            rank = local + starts[inverse]
            m = table[np.searchsorted(order, length * (1 << 44) + rank, side="right") - 1]
            k = rank - m[:, 1]
            yield pa.RecordBatch.from_arrays([*(named[c] for c in columns), pa.array(m[:, 4] + k // m[:, 3]), pa.array(m[:, 5] + k % m[:, 3] * length)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Tokenise whole documents, cut those over ``capacity`` and pack all pieces best-fit."""
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, tokenizer, end_id, capacity, keep_ids), "pieces")  # a range sort reads its input twice
    out = pack(cut, capacity, scratch)
    scratch.drop("pieces")
    return out

"""Repeated substrings across documents: sampled suffixes sorted first, the rest induced from them.

What is asked: every byte that lies in a ``length``-byte string which also starts in
a document with a smaller id is removed; only suffixes' first ``length`` bytes matter.

Method.  Full external induced sorting carries every suffix of the corpus through
disk-backed queues; that is a tuple of 16 bytes or more for each byte of text, many
times the disk that is to be had here, and was therefore not built (see README).
What is kept of it is the induction: a sample of suffixes is sorted, and the order
of all others follows from the sampled suffix next to them and the bytes between.

* A suffix is sampled if the hash of its first ``GRAM`` bytes is the least among
  those that begin in some ``length``-byte string around it.  The choice depends on
  that string alone, so equal strings, wherever they lie, hold the same sample at
  the same place; two suffixes in seventeen are taken.
* 48 bits of the sampled suffixes' hashes are shuffled in packed blocks and sorted;
  suffixes met in one document only are settled.  The others are marked in a
  filter, which may mark too much but never too little.  Its size follows their
  number; where it would pass ``FILTER_MOST`` bits, the texts are gone over once for each
  range of hashes instead.
* Marked samples travel with ``length - GRAM`` bytes on either side to a sort by
  sample.  There, strings that begin k bytes before the sample are equal if the k
  bytes before and the bytes behind are; one sorted sweep for each k finds the
  least document of each string and so the strings to remove.  The bytes
  beside the sample are compared in full, the sample itself by its 64-bit hash.
* A sample that more than ``HOT`` documents hold would land in one task.  Its strings
  are compared one by one instead: in a task by a sweep of their own, and of
  each string only the least document's place travels, under a 128-bit hash of the string.
  A string thus meets itself at most once a task and ``HELD`` samples.
* Copies of a whole text are settled beforehand; of equal surroundings among
  ``HELD`` samples of a task only those of the least document travel for comparison.

Tasks are as many as keep the samples of ``TASK_BYTES`` of text in each.
The texts meet their marks in one join by document at the end.

Defined results: null text is empty; a document without id neither removes nor loses
anything; rows that repeat an id are no earlier than one another; texts shorter than
``length`` lose nothing; an empty table gives an empty result; other columns are
not read.  Ids are integers of any width (others are refused), and ``length`` is
from ``GRAM`` + 1 to ``GRAM`` + 62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemill.llm.common import _RADIX, _VALUES, Scratch, as_bytes, mix, text_parts

GRAM = 35
#: Most bits of the filter of samples that several documents hold.
FILTER_MOST = 1 << 30
#: Whole copies that may be broadcast; with more, a join by document does the same.
COPIES_BROADCAST = 1 << 20
#: Bytes of text whose samples a task sorts, on the average.
TASK_BYTES = 32 << 20
#: Documents that may hold a sample before its strings are compared one by one.
HOT = 2048


def gram_hashes(raw: np.ndarray, gram: int = 0) -> np.ndarray:
    """64-bit hashes of every run of ``gram`` (GRAM) bytes: doubled up from single bytes."""
    gram = gram or GRAM
    step, width, out, done = _VALUES[raw], 1, None, 0
    n = len(raw) - gram + 1
    while True:
        if gram & width:
            out = step[done : done + n] if out is None else out * np.uint64(pow(int(_RADIX), width, 1 << 64)) + step[done : done + n]
            done += width
        if 2 * width > gram:
            return mix(out)
        step = step[:-width] * np.uint64(pow(int(_RADIX), width, 1 << 64)) + step[width:]
        width *= 2


def samples(offsets: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the sampled suffixes in ``raw``, their texts, their hashes."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(raw)
    width = length - GRAM + 1
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    begins = len(raw) - length + 1
    inside = np.zeros(len(raw) + 1, np.int32)  # strings that begin where they end within their text
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(inside[:-1])[:begins] > 0
    place = (least[:begins][valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(place):
        return none, none, np.zeros(0, np.uint64)
    text = np.searchsorted(offsets, place, side="right") - 1
    keep = np.ones(len(place), bool)
    keep[1:] = place[1:] != place[:-1]
    place, text = place[keep], text[keep]
    return place, text, hashes[place]


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of 64-bit hashes."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _shared_samples(rows: DataFrame, length: int, partitions: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Samples that several documents hold: (part, hashes, hot) by leading bits; the bits of a part; how many there are."""
    bits = max(0, (partitions - 1).bit_length())
    parts = 1 << bits

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_parts(batches, 1):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            _, text, h = samples(*as_bytes(b.column(1)), length)
            h = h >> np.uint64(16)  # 48 bits: two samples taken for one mark too much, never too little
            order = np.lexsort((ids[text], h))
            h, d = h[order], ids[text][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h = h[new]  # once for each document
            cut = np.searchsorted(_top(h << np.uint64(16), bits), np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16)
            data = [[x[cut[p] : cut[p + 1]].tobytes() for p in full.tolist()] for x in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(x, pa.binary()) for x in data)], names=["part", "low", "high"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for p, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(p, []).append(np.frombuffer(low, np.uint32) | np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32))
        for p in sorted(held):
            h = np.sort(np.concatenate(held.pop(p))) << np.uint64(16)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(first, len(h)))
            data = [h[first[n > 1]].tobytes(), h[first[n > HOT]].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["part", "hashes", "hot"])

    packed = rows.select("doc_id", "text").mapInArrow(blocks, "part int, low binary, high binary").repartition(parts, "part")
    found = scratch.save(packed.mapInArrow(several, "part int, hashes binary, hot binary"), "shared")
    return found, bits, int(found.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()[0]) // 8


def _filter(shared: DataFrame, column: str, first: int, n: int, bits: int, part_bits: int) -> np.ndarray:
    """Bitmap of ``bits`` bits over the hashes of parts ``first`` to ``first + n``, addressed by what follows the pass's leading bits."""
    pass_bits = part_bits - (n.bit_length() - 1)
    own = bits.bit_length() - 1
    out = np.zeros(bits // 8, np.uint8)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for x in b.column(0).to_pylist():
                at = np.unique(_top(np.frombuffer(x, np.uint64) << np.uint64(pass_bits), own))
                data.append(at.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["places"])

    rows = shared.filter((F.col("part") >= first) & (F.col("part") < first + n) & (F.octet_length(column) > 0)).select(column)
    for r in rows.mapInArrow(places, "places binary").toLocalIterator():  # by part: what ``bits`` allows for, in all
        at = np.frombuffer(r["places"], np.uint32)
        np.bitwise_or.at(out, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
    return out


def _bits_for(n: int) -> int:
    return 1 << max(20, (16 * max(1, n) - 1).bit_length())


MARKS = "doc_id long, tk int, place int, mask long"
#: Marked samples that a task compares among themselves before they travel.
HELD = 200_000


def _surroundings(rows: DataFrame, marked: np.ndarray, hot: np.ndarray, first: int, pass_bits: int, length: int, partitions: int) -> DataFrame:
    """What is to be compared, by task of the next sort: packed samples with the bytes beside them, places of hot
    samples' strings, and marks that are settled already."""
    shared = rows.sparkSession.sparkContext.broadcast((marked, hot))  # FILTER_MOST bits
    side = length - GRAM
    beside = np.concatenate([np.arange(side), np.arange(side + GRAM, 2 * side + GRAM)])

    def inside(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = _top((h >> np.uint64(16) << np.uint64(16)) << np.uint64(pass_bits), (8 * len(bitmap)).bit_length() - 1)
        return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def settle(hot: np.ndarray, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, doc, tk, place, behind, around = (np.concatenate(x) for x in zip(*held, strict=True))
        before = np.minimum(place, side)
        kind = h.copy()
        for i in range(2 * side):
            kind = kind * _RADIX + around[:, i]
        kind = mix(kind * _RADIX + behind.astype(np.uint64))
        order = np.lexsort((doc, kind))
        lead = np.ones(len(order), bool)
        lead[1:] = kind[order][1:] != kind[order][:-1]
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        same = (around[order] == around[head]).all(axis=1) & (before[order] == before[head]) & (behind[order] == behind[head]) & (h[order] == h[head])
        later = np.zeros(len(order), bool)
        later[order] = same & (doc[order] > doc[head])
        mask = np.where(later, possible(before, behind, side), 0)
        warm = inside(hot, h)
        own = np.flatnonzero(~later & warm)
        if len(own):
            found, at, k, value = strings(h[own], doc[own], before[own], behind[own], around[own], length)
            mask[own] = found
            yield from packed(_top(value[:, 0], 31) % partitions, 1, value, doc[own][at], tk[own][at], place[own][at], k)
        own = np.flatnonzero(mask)
        yield from packed(_top(mix(doc[own].view(np.uint64)), 31) % partitions, 2, doc[own], tk[own], place[own], mask[own])
        own = np.flatnonzero(~later & ~warm)
        yield from packed(_top(mix(h[own]), 31) % partitions, 0, h[own], doc[own], tk[own], place[own], behind[own].astype(np.int8), around[own])

    def packed(task: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        import zstandard

        if not len(task):
            return
        squeeze = zstandard.ZstdCompressor(level=1)
        order = np.lexsort((columns[0] if columns[0].ndim == 1 else columns[0][:, 0], task))
        task = task[order]
        cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        columns = tuple(c[order] for c in columns)
        data = [squeeze.compress(b"".join([(e - s).to_bytes(8, "little"), *(c[s:e].tobytes() for c in columns)])) for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(task)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(task[cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int8)), pa.array(data, pa.binary())], names=["task", "kind", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, hot = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        for b in text_parts(batches, 1):
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            offsets, raw = as_bytes(b.column(1))
            place, text, h = samples(offsets, raw, length)
            own = inside(marked, h) & (_top(h, pass_bits) == first)
            place, text, h = place[own], text[own], h[own]
            if not len(place):
                continue
            before = np.minimum(place - offsets[text], side)
            behind = np.minimum(offsets[text + 1] - place - GRAM, side)
            padded = np.concatenate([np.zeros(side, np.uint8), raw, np.zeros(side, np.uint8)])
            around = padded[place[:, None] + beside[None, :]]
            column = np.arange(2 * side)[None, :]
            around[(column < side - before[:, None]) | (column >= side + behind[:, None])] = 0
            held.append((h, ids[text], keys[text], (place - offsets[text]).astype(np.int32), behind, around))
            if sum(len(x[0]) for x in held) >= HELD:
                yield from settle(hot, held)
                held = []
        if held:
            yield from settle(hot, held)

    return rows.select("doc_id", "text", "tk").mapInArrow(run, "task int, kind byte, block binary")


def _weights(n: int) -> np.ndarray:
    return mix(np.arange(11, 11 + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def possible(before: np.ndarray, behind: np.ndarray, side: int) -> np.ndarray:
    """Bit k: the string that begins k bytes before the sample lies in the text."""
    k = np.arange(side + 1)[None, :]
    ok = (k <= before[:, None]) & (side - k <= behind[:, None])
    return (ok.astype(np.int64) << k).sum(axis=1)


def _string_hashes(sample: np.ndarray, around: np.ndarray, own: np.ndarray, k: int, side: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes beside the sample in the strings that begin k bytes before it, and a hash of the whole strings."""
    string = around[own, side - k : 2 * side - k]
    value = sample[own].copy()
    for i in range(side):
        value = value + string[:, i] * weights[i]
    return string, mix(value)


def sweep(sample: np.ndarray, doc: np.ndarray, before: np.ndarray, behind: np.ndarray, around: np.ndarray, length: int) -> np.ndarray:
    """Marks of samples whose strings some smaller document has: one sorted sweep for each place of the string.

    ``around`` holds the bytes on either side; the sample itself is its 64-bit hash.
    """
    side = length - GRAM
    can = possible(before, behind, side)
    mask = np.zeros(len(doc), np.int64)
    weights = _weights(side)
    for k in range(side + 1):
        own = np.flatnonzero(can >> k & 1)
        if len(own) < 2:
            continue
        string, value = _string_hashes(sample, around, own, k, side, weights)
        order = np.lexsort((doc[own], value))
        v, d = value[order], doc[own][order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        later = np.flatnonzero(d > d[head])
        one, two = order[later], order[head[later]]
        same = (string[one] == string[two]).all(axis=1) & (sample[own[one]] == sample[own[two]])
        mask[own[one[same]]] |= 1 << k
    return mask


def strings(sample: np.ndarray, doc: np.ndarray, before: np.ndarray, behind: np.ndarray, around: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The strings of hot samples.  Marks of those that a smaller document holds here, and of the others the
    sample, the place k in the mask and a 128-bit hash: those are yet to be compared with other tasks."""
    side = length - GRAM
    can = possible(before, behind, side)
    mask = np.zeros(len(doc), np.int64)
    at, ks, values = [], [], []
    weights, more = _weights(side), _weights(2 * side)[side:]
    for k in range(side + 1):
        own = np.flatnonzero(can >> k & 1)
        if not len(own):
            continue
        _, value = _string_hashes(sample, around, own, k, side, weights)
        _, second = _string_hashes(mix(sample), around, own, k, side, more)
        order = np.lexsort((doc[own], second, value))
        v, w, d = value[order], second[order], doc[own][order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        late = d > d[head]
        mask[own[order[late]]] |= 1 << k
        at.append(own[order[~late]])
        ks.append(np.full(len(at[-1]), k, np.int8))
        values.append(np.stack([v[~late], w[~late]], 1))
    none = np.zeros(0, np.int64)
    return mask, np.concatenate(at) if at else none, np.concatenate(ks) if ks else none.astype(np.int8), np.concatenate(values) if values else np.zeros((0, 2), np.uint64)


def _marks(compared: DataFrame, length: int, partitions: int) -> DataFrame:
    side = length - GRAM
    kinds = {
        0: [(np.uint64, 1), (np.int64, 1), (np.int32, 1), (np.int32, 1), (np.int8, 1), (np.uint8, 2 * side)],
        1: [(np.uint64, 2), (np.int64, 1), (np.int32, 1), (np.int32, 1), (np.int8, 1)],
        2: [(np.int64, 1), (np.int32, 1), (np.int32, 1), (np.int64, 1)],
    }

    def unpacked(kind: int, data: bytes) -> list[np.ndarray]:
        n, at, out = int.from_bytes(data[:8], "little"), 8, []
        for t, width in kinds[kind]:
            x = np.frombuffer(data, t, n * width, at)
            at += x.nbytes
            out.append(x if width == 1 else x.reshape(n, width))
        return out

    def answer(doc: np.ndarray, tk: np.ndarray, place: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
        own = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (doc, tk, place, mask)], names=["doc_id", "tk", "place", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        held: dict[tuple[int, int], list[list[np.ndarray]]] = {}
        for b in batches:
            for task, kind, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = unpacked(kind, open_.decompress(block))
                if kind == 2:
                    yield answer(*own)
                else:
                    held.setdefault((task, kind), []).append(own)
        for key in sorted(held):
            columns = [np.concatenate(x) for x in zip(*held.pop(key), strict=True)]
            if key[1] == 0:
                h, doc, tk, place, behind, around = columns
                order = np.argsort(h, kind="stable")
                sample = h[order]
                at = 0
                while at < len(order):  # whole samples, some 50,000 rows at once
                    to = min(len(order), at + 50_000)
                    to = int(np.searchsorted(sample, sample[to - 1], side="right"))
                    own = order[at:to]
                    mask = sweep(h[own], doc[own], np.minimum(place[own], side).astype(np.int64), behind[own].astype(np.int64), around[own], length)
                    yield answer(doc[own], tk[own], place[own], mask)
                    at = to
            else:
                value, doc, tk, place, k = columns
                order = np.lexsort((doc, value[:, 1], value[:, 0]))
                v, d = value[order], doc[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]).any(axis=1)
                head = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
                mask = np.where(d > d[head], np.int64(1) << k[order].astype(np.int64), 0)
                yield answer(d, tk[order], place[order], mask)

    return compared.repartition(partitions, "task").mapInArrow(run, MARKS)


def _packed(keyed: DataFrame) -> DataFrame:
    """The texts compressed, for the one shuffle that whole texts take part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data = [squeeze.compress(x.encode()) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["doc_id", "tk", "packed"])

    return keyed.select("doc_id", "tk", "text").mapInArrow(run, "doc_id long, tk int, packed binary")


def removals(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and ``kept``: the bytes that stay."""
    if not GRAM < length <= GRAM + 62:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 62}")
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError("doc_id must be an integer")
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("tk", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    names = keyed.filter((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).select("doc_id", "tk", F.octet_length("text").cast("long").alias("size"), F.unhex(F.sha2("text", 256)).alias("whole"))
    names = scratch.save(names, "names")
    total = int(names.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    least = scratch.save(names.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most"), "least")
    copies = names.join(least, "whole").filter(F.col("doc_id") > F.col("least")).select("doc_id", "tk", F.lit(True).alias("copy")).distinct()
    copies = scratch.save(copies, "copies")
    scratch.drop("names", "least")
    few = copies.count() <= COPIES_BROADCAST
    settled = keyed.join(F.broadcast(copies) if few else copies, ["doc_id", "tk"], "left")
    rows = settled.filter(F.col("copy").isNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    shared, part_bits, n = _shared_samples(rows, length, partitions, scratch)
    pass_bits = min(part_bits, max(0, (_bits_for(n) // FILTER_MOST).bit_length() - 1))
    own = 1 << (part_bits - pass_bits)  # parts of a pass
    marks = None
    for p in range(1 << pass_bits):
        marked = _filter(shared, "hashes", p * own, own, min(FILTER_MOST, _bits_for(n >> pass_bits)), part_bits)
        hot = _filter(shared, "hot", p * own, own, 1 << 20, part_bits)
        more = _marks(_surroundings(rows, marked, hot, p, pass_bits, length, partitions), length, partitions)
        more = scratch.save(more, f"marks-{p}")
        marks = more if marks is None else marks.unionByName(more)
    scratch.drop("shared")
    marks = marks.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("place", "mask")).alias("marks"))  # bounded by the document
    marks = marks.unionByName(copies.select("doc_id", "tk", F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("mask"))).alias("marks")))
    both = _packed(keyed).join(marks.hint("shuffle_hash"), ["doc_id", "tk"], "left").select("doc_id", "packed", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            at, marks = b.column(2).offsets.to_numpy(), b.column(2).values
            place, mask = marks.field(0).to_numpy(), marks.field(1).to_numpy()
            empty = b.column(2).is_null().to_pylist()
            for i, packed in enumerate(b.column(1).to_pylist()):
                data = open_.decompress(packed)
                spans = [] if empty[i] else covered(place[at[i] : at[i + 1]], mask[at[i] : at[i + 1]], len(data), length)
                kept, last = [], 0
                for s, e in spans:
                    kept.append(data[last:s])
                    last = e
                kept.append(data[last:])
                for column, x in zip(out, (len(data), sum(e - s for s, e in spans), len(spans), ",".join(f"{s}:{e}" for s, e in spans), b"".join(kept)), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    out = both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans string, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def covered(place: np.ndarray, mask: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the marked strings cover; place -1 stands for the whole text."""
    if not len(place):
        return []
    if (place < 0).any():
        return [(0, size)]
    depth = np.zeros(size + 1, np.int32)
    for k in range(length - GRAM + 1):
        s = place[mask >> k & 1 == 1] - k
        np.add.at(depth, s, 1)
        np.add.at(depth, s + length, -1)
    inside = np.cumsum(depth[:size]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

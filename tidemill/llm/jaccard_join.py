"""Exact Jaccard self-join of word n-gram sets: size-aware, light sets by subsets, heavy ones by inverted lists.

Method.  Two sets of sizes a and b link if they share at least
c(a, b) = ceil(p (a + b) / (100 + p)) shingles, p being the percentage asked for.

* Light sets (at most ``x`` shingles): every subset of each size c that some light
  partner may require is a key.  Sets that link share such a subset.
* Heavy sets, and light ones near enough in size to link with them: a shingle is a
  key if it is among the set's first n - ceil(p n / 100) + 1 in a global order; sets
  that link share one of those, so inverted lists of these alone lose nothing.
  The order is rarest first, by counts over all documents in a table of fixed size
  (any order is right; rare shingles only make the lists short).
* x is chosen by cost: for each size up to a bound, subsets to be made against list
  entries to be made and scanned, from the sizes counted in the same pass.

Sets that are equal are one class from the start.  Lists are scanned in the task
that holds them.  Short ones give their pairs; long ones, as near copies make them,
are never paired out: parity bitmaps of the sets bound their difference from below,
and only a least spanning forest of the pairs that the bound leaves, between
classes not yet known to be connected, is verified by the full sets.  Verified
links join components, refuted pairs are remembered, and the long lists are scanned
again until no unverified pair could join two components.  What results is exact:
every component, by links that span it.  Lists past ``BLOCK`` sets are dealt out by
pairs of blocks, so no task holds more than two.

Defined results: null or empty text, or text without words, is the empty set and
links with nothing; fewer words than n are one shingle of all; rows that repeat an
id are documents of their own; very long texts are sets like others (a set is held
whole where it is made and verified); a row without id is never a representative unless
its component has no id at all; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, as_bytes, mix, shingle_hashes, text_parts, word_hashes
from tidemill.llm.components import components

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

log = logging.getLogger(__name__)

#: Cells of the table of shingle counts.
CELLS = 1 << 22
#: Largest set that may count as light.
LIGHT_MOST = 64
#: Bits of each of a set's two parity bitmaps.
BITS = 2048
#: Classes that a task remembers to have listed.
SEEN = 500_000
#: Pairs whose sets are picked out by broadcasting their names; with more, the sets are shuffled.
FEW = 50_000
#: Lists up to so many sets give their pairs at once.
SHORT = 12
BLOCK = 2048
#: Places of a list that meet the verdict on it in one task.
SLICE = 256
#: 64-bit words of bitmaps compared at once (8 MB).
FOREST_WORDS = 1 << 20
#: Most pairs of one set, in one list and round, that are verified beside the forest.
MORE = 64
#: Bits of the filter of classes whose full sets are wanted.
WANTED_BITS = 1 << 25

_A, _B, _C = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def need(a, b, p: int):
    """The least overlap at which sets of sizes a and b link."""
    return -(-p * (a + b) // (100 + p))


def prefix(n: int, p: int) -> int:
    return n - -(-p * n // 100) + 1


def subset_sizes(n: int, x: int, p: int) -> list[int]:
    """Sizes of the subsets that a light set of n shingles must give, for partners up to x."""
    partners = range(-(-p * n // 100), min(x, 100 * n // p) + 1)
    return sorted({need(n, b, p) for b in partners if b and need(n, b, p) <= min(n, b)})


def subset_count(n: int, x: int, p: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, x, p))


def boundary(sizes: np.ndarray, load: float, p: int) -> int:
    """The largest size of light sets: least cost of subsets made and list entries made and scanned."""
    best, at = None, 0
    for x in range(0, LIGHT_MOST + 1):
        made = [int(sizes[n]) * subset_count(n, x, p) for n in range(1, x + 1) if sizes[n]]
        listed = [int(sizes[n]) * prefix(n, p) * (1 + load) for n in range(1, LIGHT_MOST + 1) if n > x or 100 * n >= p * (x + 1)]
        cost = sum(made) + sum(listed)
        if best is None or cost < best:
            best, at = cost, x
        if made and sum(made) > 1000 * (best + 1):
            break
    return at


def word_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    words, _, first = word_hashes(*as_bytes(column), IS_WORD, FOLD)
    shingles = shingle_hashes(words, k) if len(words) >= k else words[:0]
    out = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        elif b > a:
            out.append(shingle_hashes(words[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(words[:0])
    return out


def class_of(s: np.ndarray) -> bytes:
    """16 bytes that equal sets share."""
    return np.array([mix(s ^ _A).sum(dtype=np.uint64), mix(s ^ _B).sum(dtype=np.uint64)]).tobytes()


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the shingles that fall on each bit, by two hashes: in neither do differing bits outnumber differing shingles."""
    h = mix(s ^ _C)
    return b"".join(np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes() for at in (h & np.uint64(BITS - 1), h >> np.uint64(65 - BITS.bit_length())))


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The greater of the two bounds from below on how many shingles differ."""
    count = np.bitwise_count(x ^ y)
    half = BITS // 64
    return np.maximum(count[..., :half].sum(axis=-1, dtype=np.int64), count[..., half:].sum(axis=-1, dtype=np.int64))


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _counts(docs: DataFrame, k: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Documents by cell of the table, and by set size up to LIGHT_MOST; both of fixed size."""
    slices = 64
    width = CELLS // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sizes = np.zeros(CELLS, np.int32), np.zeros(LIGHT_MOST + 1, np.int64)
        for b in text_parts(batches, 0):
            sets = word_sets(b.column(0), k)
            if sets:
                np.add.at(cells, _cells(np.concatenate(sets)), 1)
            for s in sets:
                if len(s) <= LIGHT_MOST:
                    sizes[len(s)] += 1
        short = np.minimum(cells, 65535).astype(np.uint16)  # the order of what is so frequent does not matter
        data = [short[i * width : (i + 1) * width].tobytes() for i in range(slices)] + [sizes.tobytes()]
        keep = [i for i, x in enumerate(data) if any(x)]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([data[i] for i in keep], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.int64 if i == slices else np.uint16)
                total.setdefault(i, np.zeros(len(x), np.int64))
                total[i] += x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    summed = scratch.save(docs.select("text").mapInArrow(count, schema).repartition(slices, "slice").mapInArrow(add, schema), "counts")
    cells, sizes = np.zeros(CELLS, np.int32), np.zeros(LIGHT_MOST + 1, np.int64)
    for r in summed.toLocalIterator():  # CELLS numbers in all
        x = np.frombuffer(r["counts"], np.int64)
        if r["slice"] == slices:
            sizes += x
        else:
            cells[r["slice"] * width : (r["slice"] + 1) * width] = np.minimum(x, np.iinfo(np.int32).max)
    return cells, sizes


def _keys(s: np.ndarray, cells: np.ndarray, x: int, p: int) -> np.ndarray:
    """The keys under which a set is listed."""
    n = len(s)
    out = []
    if n <= x:
        parts = mix(s ^ _B)
        total = parts.sum(dtype=np.uint64)
        for c in subset_sizes(n, x, p):
            if c == n:
                sums = np.array([total])
            else:
                left_out = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(n), n - c)), np.int64).reshape(-1, n - c)
                sums = total - parts[left_out].sum(axis=1, dtype=np.uint64)
            out.append(mix(sums ^ np.uint64(c)))
    if n > x or 100 * n >= p * (x + 1):
        m = prefix(n, p)
        count = cells[_cells(s)]
        if m < n:
            near = np.argpartition(count, m - 1)[:m]
            bar = count[near].max()
            near = np.flatnonzero(count <= bar)
            near = near[np.lexsort((s[near], count[near]))][:m]
        else:
            near = np.arange(n)
        out.append(mix(s[near] ^ _A))
    return np.unique(np.concatenate(out)) if out else s[:0]


def _listed(docs: DataFrame, cells: np.ndarray, x: int, k: int, p: int) -> DataFrame:
    """Rows of two kinds: documents (doc_id, n, cls, bits) and list entries (key, n, cls)."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = shared.value, set()
        for b in text_parts(batches):
            sets = word_sets(b.column(1), k)
            cls = [class_of(s) if len(s) else None for s in sets]
            keys = {}
            for i, c in enumerate(cls):  # copies that a task meets are listed once
                if c is not None and c not in seen:
                    seen.add(c)
                    keys[i] = _keys(sets[i], cells, x, p)
            if len(seen) > SEEN:
                seen.clear()
            rows = list(range(len(sets))) + [i for i, v in keys.items() for _ in range(len(v))]
            n_docs, n_keys = len(sets), len(rows) - len(sets)
            ids = pa.concat_arrays([b.column(0), pa.nulls(n_keys, b.column(0).type)])
            key = pa.concat_arrays([pa.nulls(n_docs, pa.int64()), pa.array(np.concatenate([s[:0].view(np.int64) for s in sets[:1]] + [v.view(np.int64) for v in keys.values()]) if sets else [], pa.int64())])
            size = pa.array([len(sets[i]) for i in rows], pa.int32())
            bits = pa.array([bitmap(sets[i]) if len(sets[i]) else None for i in range(n_docs)] + [None] * n_keys, pa.binary())
            yield pa.RecordBatch.from_arrays([ids, key, size, pa.array([cls[i] for i in rows], pa.binary()), bits], names=["doc_id", "key", "n", "cls", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, n int, cls binary, bits binary")


def _runs(batches: Iterator[pa.RecordBatch], least: int = 4000) -> Iterator[pa.Table]:
    """Tables that hold whole runs of the first column, which is sorted."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut >= least:
            yield t.slice(0, cut).combine_chunks()
            t = t.slice(cut)
        rest = t
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _scan(entries: DataFrame, p: int, partitions: int) -> DataFrame:
    """Lists of two sets and more: pairs of the short ones (a, b), entries of the long ones (key, a, place, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            key, n = t.column(0).to_numpy(), t.column(1).to_numpy()
            cls = t.column(2).to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            pairs: set[tuple[bytes, bytes]] = set()
            long: list[tuple[int, bytes, int, int]] = []
            for s, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                members = sorted(set(zip(n[s : s + size].tolist(), cls[s : s + size], strict=True)))  # tasks list copies again
                size = len(members)
                if size <= SHORT:
                    for (na, a), (nb, b) in itertools.combinations(members, 2):
                        if 100 * na >= p * nb:
                            pairs.add((a, b) if a < b else (b, a))
                else:
                    long += [(int(key[s]), c, i, size) for i, (_, c) in enumerate(members)]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            rows = [(None, a, b, None, None) for a, b in pairs] + [(k, c, None, i, size) for k, c, i, size in long]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["key", "a", "b", "place", "size"])

    dealt = entries.repartition(partitions, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, a binary, b binary, place int, size int")


def _words(column: pa.Array) -> np.ndarray:
    _, raw = as_bytes(column)
    return raw.reshape(-1, 2 * BITS // 8).view(np.uint64)


def _may_link(pairs: DataFrame, classes: DataFrame, p: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps leave it open whether they link."""
    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                na, nb = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
                differ = _differ(_words(b.column(4)), _words(b.column(5)))
                keep = differ <= na + nb - 2 * need(na, nb, p)
                yield b.filter(pa.array(keep)).select([0, 1])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a binary, b binary")


def forest(n: np.ndarray, bits: np.ndarray, group: np.ndarray, refuted: tuple[np.ndarray, np.ndarray], p: int, split: int | None = None, more: int = 0) -> list[tuple[int, int]]:
    """Least spanning forest, between groups, of the pairs that may link (Boruvka on the bounds).

    ``refuted`` holds places i and j of pairs that do not link; ``split`` restricts to
    pairs of one below it and one from it on.  With ``more``, so many of each set's
    nearest pairs across groups come besides, to settle stubborn ones sooner.  Past the
    matrix of bounds (four bytes a pair) rows are taken a few at a time.
    """
    size = len(n)
    n = n.astype(np.int64)
    group = np.unique(group, return_inverse=True)[1]
    spare = np.full((size, size), np.inf, np.float32)
    step = max(1, FOREST_WORDS // max(1, bits.size))
    parts = [slice(s, min(s + step, size)) for s in range(0, size, step)]
    for rows in parts:
        differ = _differ(bits[rows, None, :], bits[None, :, :])
        total = n[rows, None] + n[None, :]
        least = need(total, 0, p)
        open_ = (differ <= total - 2 * least) & (least <= np.minimum(n[rows, None], n[None, :])) & (group[rows, None] != group[None, :])
        spare[rows][open_] = (differ / np.maximum(total - 2 * least, 1))[open_]
    spare[refuted] = spare[refuted[::-1]] = np.inf
    if split is not None:
        spare[:split, :split] = spare[split:, split:] = np.inf
    edges: list[tuple[int, int]] = []
    to, cost = np.zeros(size, np.int64), np.zeros(size, np.float32)
    first = True
    while True:
        for rows in parts:
            part = spare[rows]
            part[group[rows, None] == group[None, :]] = np.inf
            to[rows] = part.argmin(axis=1)
            cost[rows] = np.take_along_axis(part, to[rows, None], 1)[:, 0]
            if first and more:
                near = np.argpartition(part, min(more, size - 1), axis=1)[:, :more]
                i, k = np.nonzero(np.isfinite(np.take_along_axis(part, near, 1)))
                edges += [(min(a, b), max(a, b)) for a, b in zip((i + rows.start).tolist(), near[i, k].tolist(), strict=True)]
        first = False
        live = np.flatnonzero(np.isfinite(cost))
        if not len(live):
            return edges
        parent = np.arange(group.max() + 1)

        def root(g: int, parent=parent) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        done: set[int] = set()
        for i in live[np.argsort(cost[live], kind="stable")].tolist():
            g = int(group[i])
            if g in done:
                continue
            done.add(g)
            j = int(to[i])
            a, b = root(g), root(int(group[j]))
            if a != b:
                parent[a] = b
                edges.append((min(i, j), max(i, j)))
        group = np.array([root(g) for g in range(len(parent))])[group]


def _refuted_places(cls: pa.Array, no: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places i and j of those refuted pairs that lie in one list, without an object for each pair."""
    if isinstance(no, pa.ChunkedArray):
        no = no.combine_chunks()
    j = pc.index_in(no.flatten(), cls).fill_null(-1).to_numpy(zero_copy_only=False)
    i = np.repeat(np.arange(len(no)), pc.fill_null(pc.list_value_length(no), 0).to_numpy(zero_copy_only=False))
    return i[j >= 0], j[j >= 0]


def _forest_edges(long: DataFrame, classes: DataFrame, labels: DataFrame, refuted: DataFrame, p: int, partitions: int, extra: int) -> DataFrame:
    """Pairs (a, b) of the long lists that are to be verified next."""
    known = classes.select(F.col("cls").alias("a"), "n", "bits").join(labels, F.col("a") == F.col("node"), "left").join(refuted, "a", "left")
    rows = long.join(known.select("a", "n", "bits", F.coalesce("root", "a").alias("root"), "no"), "a")
    last = F.floor((F.col("size") - 1) / BLOCK).cast("int")
    own = F.floor(F.col("place") / BLOCK).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select(F.xxhash64("key", low, high).alias("task"), "key", low.alias("low"), high.alias("high"), "own", "a", "n", "bits", "root", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            task, key, low, high, own = (t.column(i).to_numpy() for i in range(5))
            cut = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            out: set[tuple[bytes, bytes]] = set()
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(task)], strict=True):
                part = t.slice(s, e - s)
                order = np.argsort(own[s:e], kind="stable")
                part = part.take(pa.array(order)).combine_chunks()
                roots = part.column(8).to_pylist()
                names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
                if len(names) < 2:
                    continue
                cls = part.column(5).to_pylist()
                no = _refuted_places(part.column(5).combine_chunks(), part.column(9))
                split = int((own[s:e] == low[s]).sum()) if low[s] != high[s] else None
                for i, j in forest(part.column(6).to_numpy(), _words(part.column(7).combine_chunks()), np.array([names[r] for r in roots]), no, p, split, extra):
                    out.add((min(cls[i], cls[j]), max(cls[i], cls[j])))
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

    dealt = rows.repartition(partitions, "task").sortWithinPartitions("task", "key", "low", "high")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _filter_places(cls: list[bytes]) -> np.ndarray:
    return (np.frombuffer(b"".join(cls), np.uint64)[::2] >> np.uint64(64 - WANTED_BITS.bit_length() + 1)).astype(np.int64)


def _wanted(classes: DataFrame) -> np.ndarray:
    """Filter of fixed size over classes (cls): it may want too many full sets, never too few."""
    width = 1 << 15

    def bits_of(places: np.ndarray) -> tuple[list[int], list[bytes]]:
        parts = np.unique(places // width)
        out = []
        for part in parts.tolist():
            bits = np.zeros(width, np.uint8)
            bits[places[places // width == part] % width] = 1
            out.append(np.packbits(bits).tobytes())
        return parts.tolist(), out

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, bits = bits_of(_filter_places(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(bits, pa.binary())], names=["part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(bits, np.uint8)
                total[part] = total[part] | x if part in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "bits"])

    schema = "part int, bits binary"
    out = np.zeros(WANTED_BITS // 8, np.uint8)
    for r in classes.mapInArrow(mark, schema).repartition(16, "part").mapInArrow(join, schema).toLocalIterator():  # WANTED_BITS in all
        out[r["part"] * width // 8 : (r["part"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out)


def _full_sets(docs: DataFrame, wanted: np.ndarray, k: int) -> DataFrame:
    """(cls, items) for the classes that the filter wants."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value)
        for b in text_parts(batches, 0):
            out = {}
            for s in word_sets(b.column(0), k):
                if len(s):
                    c = class_of(s)
                    if c not in out and wanted[_filter_places([c])[0]]:
                        out[c] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["cls", "items"])

    return docs.select("text").mapInArrow(run, "cls binary, items binary").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, p: int) -> DataFrame:
    """(a, b, linked) by the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= p * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    one, two = (sets.select(F.col("cls").alias(c), F.col("items").alias(f"i{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ia", "ib").mapInArrow(run, "a binary, b binary, linked boolean")


def join(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, light_most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, classes and links.

    ``documents``: doc_id, n_shingles, cls (null without shingles), component_id.
    ``classes``: cls, n, least_id.  ``links``: (a, b) verified links between classes
    that span every component.  ``light_most`` sets the boundary between light and
    heavy sets, which is chosen by cost otherwise.
    """
    scratch = Scratch(spark, "jaccard")
    p = percent
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select("doc_id", "text")
    cells, sizes = _counts(docs, k, scratch)
    x = boundary(sizes, float(cells[cells > 0].mean()) if (cells > 0).any() else 0.0, p) if light_most is None else light_most
    log.info("light sets have at most %d shingles: %d of those up to %d", x, int(sizes[1 : x + 1].sum()), LIGHT_MOST)
    rows = scratch.save(_listed(docs, cells, x, k, p), "listed")
    members = scratch.save(rows.filter(F.col("key").isNull()).select("doc_id", "n", "cls"), "members")
    classes = rows.filter(F.col("key").isNull() & F.col("cls").isNotNull()).groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("least_id"))
    classes = scratch.save(classes, "classes")
    found = scratch.save(_scan(rows.filter(F.col("key").isNotNull()).select("key", "n", "cls"), p, partitions), "found")
    scratch.drop("listed")
    long = scratch.save(found.filter(F.col("key").isNotNull()).select("key", "a", "place", "size"), "long-0")
    pairs = scratch.save(_may_link(found.filter(F.col("key").isNull()).select("a", "b").distinct(), classes, p), "pairs")
    scratch.drop("found")
    wanted = pairs.select("a").unionAll(pairs.select("b")).unionAll(long.select("a")).distinct()
    sets = scratch.save(_full_sets(docs, _wanted(wanted), k), "sets")
    judged = [scratch.save(_verified(pairs, sets, p), "judged-0")]
    scratch.drop("pairs")
    in_long = scratch.save(classes.join(long.select(F.col("a").alias("cls")).distinct(), "cls", "left_semi"), "in-long")
    while True:
        every = judged[0]
        for j in judged[1:]:
            every = every.unionAll(j)
        turn = len(judged)
        labels = components(every.filter("linked"), scratch, f"labels-{turn}")
        long = scratch.save(_unsettled(long, labels), f"long-{turn}")
        scratch.drop(f"long-{turn - 1}")
        no = every.filter("NOT linked")
        refuted = no.select("a", "b").unionAll(no.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.collect_list("b").alias("no"))
        extra = 0 if turn == 1 else min(4 << (turn - 1), MORE)  # rounds grow, so that stubborn lists need few of them
        more = scratch.save(_forest_edges(long, in_long, labels, refuted, p, partitions, extra), f"more-{turn}")
        n_more = more.count()
        if not n_more:
            break
        own = sets
        if n_more <= FEW:
            names = more.select(F.col("a").alias("cls")).unionAll(more.select("b")).distinct()
            own = sets.join(F.broadcast(names), "cls", "left_semi")
        judged.append(scratch.save(_verified(more, own, p), f"judged-{turn}"))
        scratch.drop(f"more-{turn}")
    named = classes.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "least_id", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = scratch.save(named.join(least, "root").select("cls", "component_id"), "named")
    out = members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "cls").join(named, "cls", "left")
    out = scratch.save(out.select("doc_id", "n_shingles", "cls", F.coalesce("component_id", "doc_id").alias("component_id")), "out")
    links = scratch.save(every.filter("linked").select("a", "b"), "links")
    kinds = scratch.save(classes.select("cls", "n", "least_id"), "kinds")
    scratch.drop("counts", "members", "classes", "long-0", f"long-{turn}", "in-long", "sets", "named", *(f"judged-{i}" for i in range(turn)), f"more-{turn}", *scratch.left("labels-"))
    return out, kinds, links


def _unsettled(long: DataFrame, labels: DataFrame) -> DataFrame:
    """The long lists whose sets are not all of one component yet."""
    roots = long.join(labels, F.col("a") == F.col("node"), "left")
    roots = roots.groupBy("key").agg(F.min(F.coalesce("root", "a")).alias("low"), F.max(F.coalesce("root", "a")).alias("high"), F.max("size").alias("most"))
    slices = roots.filter("low <> high").select("key", F.explode(F.sequence(F.lit(0), F.floor((F.col("most") - 1) / SLICE))).alias("slice"))
    dealt = long.withColumn("slice", F.floor(F.col("place") / SLICE))  # a long list meets its verdict in many tasks
    return dealt.join(slices, ["key", "slice"], "left_semi").select("key", "a", "place", "size")


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one of each component.

    The least id stays; rows that repeat it are one document.  Rows without an id and
    documents without words stay.
    """
    found, _, _ = join(spark, docs, k, percent)
    gone = found.filter(F.col("cls").isNotNull() & F.col("doc_id").isNotNull() & (F.col("doc_id") > F.col("component_id"))).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)

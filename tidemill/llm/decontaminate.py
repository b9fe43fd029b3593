"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Method.  Texts become lower-case words of letters and digits (any byte past ASCII
counts as a letter).  Karp-Rabin hashes of every run of ``seed`` words of all items
meet those of a text: the shared seeds.  An item whose words the shared seeds do not
cover to the share asked for cannot be covered by tiles and goes no further.  For
the others the longest run of words that both texts hold unmarked is found by
halving the length, each length's runs being compared by running hashes that are
renamed to exact ranks when they double; it is marked as a tile, and so on with
what is unmarked until none of ``seed`` words is left.  No pair of places is ever
listed, so texts and items that repeat themselves cost no more than others.
The tiles' share of the item's words is its coverage in the text; as tiles
may lie anywhere, an item whose sentences were reordered is still covered.
Words are compared by 64-bit hashes.

A text is judged where it lies, against all items: no shuffle, and no pair becomes
a row before it shares a seed.  The items go out in blocks of bounded bytes
(``block_bytes``), one pass over the texts for each: meant for benchmarks of
megabytes to a gigabyte.

Defined results: null or empty texts and items share nothing; an item of fewer
than ``seed`` words is a seed of its own length; repeated rows are judged each;
ties between matches go to the earlier place in the item, then in the text; an
empty table on either side gives an empty result; other columns are kept in
``clean`` and not read in ``contamination``.  Ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.llm.common import as_bytes, shingle_hashes, text_parts, word_hashes

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.uint8)
SEED = 5
#: Share of an item's words that tiles cover in a text that leaks it.
COVERAGE = 0.6


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column and the first word of each row (n + 1 values)."""
    at, raw = as_bytes(pc.utf8_lower(column))
    words, _, first = word_hashes(at, raw, IS_WORD, FOLD)
    return words, first


class Items:
    """A block of benchmark items with the index of their seeds."""

    def __init__(self, ids: list, column: pa.Array, seed: int):
        self.ids = ids
        self.words, self.first = text_words(column)
        size = np.diff(self.first)
        self.index: dict[int, tuple[np.ndarray, ...]] = {}  # by length of seeds: seeds, first place of each, items, places
        for k in sorted({min(seed, n) for n in size.tolist()} - {0}):
            own = np.flatnonzero(np.minimum(size, seed) == k)
            n = size[own] - k + 1
            item = np.repeat(own, n)
            at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            h = shingle_hashes(self.words, k)[self.first[item] + at]
            order = np.lexsort((at, item, h))
            seeds, start = np.unique(h[order], return_index=True)
            self.index[k] = seeds, np.append(start, len(h)), item[order], at[order]

    def item(self, i: int) -> np.ndarray:
        return self.words[self.first[i] : self.first[i + 1]]

    def found(self, words: np.ndarray, first: np.ndarray, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item, tiles) for each row of a batch and item that tiles cover to the share asked for."""
        for k, (seeds, start, item, at) in self.index.items():
            if len(words) < k:
                continue
            h = shingle_hashes(words, k)
            to = np.searchsorted(seeds, h)
            to[to == len(seeds)] = 0
            hit = np.flatnonzero(seeds[to] == h)
            row = np.searchsorted(first, hit, side="right") - 1
            inside = hit + k <= first[row + 1]
            pair = np.unique(row[inside] * len(seeds) + to[hit[inside]])  # each seed once a row
            row, own = pair // len(seeds), pair % len(seeds)
            n = start[own + 1] - start[own]
            edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(row)], strict=True) if len(row) else ():
                place = np.arange(int(n[s:e].sum())) + np.repeat(start[own[s:e]] - (np.cumsum(n[s:e]) - n[s:e]), n[s:e])
                order = np.lexsort((at[place], item[place]))
                i, x = item[place][order], at[place][order]
                new = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                gap = np.full(len(i), k)
                gap[:-1] = np.where(i[1:] == i[:-1], np.minimum(k, x[1:] - x[:-1]), k)
                covered = np.add.reduceat(gap, new)
                size = self.first[i[new] + 1] - self.first[i[new]]
                text = words[first[row[s]] : first[row[s] + 1]]
                for it in i[new][covered >= coverage * size].tolist():
                    tiles = tiling(self.item(it), text, k)
                    if sum(t[2] for t in tiles) >= coverage * len(self.item(it)):
                        yield int(row[s]), it, tiles


def _ranks(sequence: np.ndarray, most: int) -> list[np.ndarray]:
    """By powers of two up to ``most``: a number for the run of so many words at each place, equal for equal runs."""
    out = [np.unique(sequence, return_inverse=True)[1].astype(np.int64)]
    while (1 << len(out)) <= most:
        last, half = out[-1], 1 << (len(out) - 1)
        pair = last[: len(last) - half] * (len(sequence) + 1) + last[half:]
        out.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
    return out


def _free(used: np.ndarray) -> np.ndarray:
    """Unmarked words from each place on."""
    place = np.arange(len(used))
    stop = np.where(used, place, len(used))
    return np.minimum.accumulate(stop[::-1])[::-1] - place


def tiling(item: np.ndarray, text: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, words) of k words and more: longest first, then by place in the item and the text."""
    n = len(item)
    if min(n, len(text)) < k:
        return []
    seeds = np.flatnonzero(np.isin(shingle_hashes(text, k), shingle_hashes(item, k)))
    near = np.zeros(len(text) + 1, np.int64)  # words that some shared seed covers; the others cannot lie in a tile
    np.add.at(near, seeds, 1)
    np.add.at(near, seeds + k, -1)
    kept = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    if not len(kept):
        return []
    other = np.insert(kept, np.flatnonzero(np.diff(kept) > 1) + 1, -1)
    back = np.concatenate([np.arange(n), [-1], other])
    used = back < 0  # breaks
    sequence = np.concatenate([item, text[:1], text[np.maximum(other, 0)]])
    ranks = _ranks(sequence, n)
    tiles: list[tuple[int, int, int]] = []

    def runs(length: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in the item and in the text where unmarked runs of this length begin, and their numbers."""
        level = length.bit_length() - 1
        place = np.flatnonzero(free[: len(ranks[level])] >= length)
        code = ranks[level][place] * len(back) + ranks[level][place + length - (1 << level)]
        cut = np.searchsorted(place, n)
        return place[:cut], place[cut:], code[:cut], code[cut:]

    most = n
    while most >= k:
        free = _free(used)
        low, high = k - 1, min(most, int(free.max()))
        while low < high:  # the greatest length at which both share a run
            mid = (low + high + 1) // 2
            _, _, own, other = runs(mid, free)
            if np.isin(own, other).any():
                low = mid
            else:
                high = mid - 1
        if low < k:
            break
        at, to, own, other = runs(low, free)
        shared = np.isin(own, other)
        order = np.argsort(other, kind="stable")
        other, to = other[order], to[order]
        first = np.searchsorted(other, own[shared])
        last = np.searchsorted(other, own[shared], side="right")
        next_: dict[int, int] = {}
        end = -1
        for i, code, s, e in zip(at[shared].tolist(), own[shared].tolist(), first.tolist(), last.tolist(), strict=True):
            if i < end:
                continue
            s = next_.get(code, s)
            while s < e and (used[to[s]] or used[to[s] + low - 1]):
                s += 1
            if s < e:
                j = int(to[s])
                used[i : i + low] = used[j : j + low] = True
                tiles.append((i, int(back[j]), low))
                end = i + low
                s += 1
            next_[code] = s
        most = low - 1
    return tiles


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], pa.Array]]:
    """The items in blocks of about so many bytes: each is bounded, whatever their number."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total) // block_bytes + 1
    rows = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    for b in range(n):
        part = (rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows).toArrow()
        if part.num_rows:
            yield part.column("item_id").to_pylist(), part.column("text").combine_chunks()


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile, tiles: a row for each text that leaks an item."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, coverage double, n_tiles long, longest_tile long, tiles string"
    out = None
    for ids, texts in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, seed)
            for b in text_parts(batches):
                words, first = text_words(b.column(1))
                rows = []
                for r, item, tiles in items.found(words, first, coverage):
                    share = sum(n for _, _, n in tiles) / len(items.item(item))
                    rows.append((r, items.ids[item], share, len(tiles), max(n for _, _, n in tiles), " ".join(f"{i}:{j}:{n}" for i, j, n in sorted(tiles))))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int32(), item_kind, pa.float64(), pa.int64(), pa.int64(), pa.string())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(arrays[0]), *arrays[1:]], names=["doc_id", "item_id", "coverage", "n_tiles", "longest_tile", "tiles"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents that leak no item, each judged where it lies."""
    at = docs.schema.names.index("text")
    for ids, texts in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, seed)
            for b in text_parts(batches, at):
                words, first = text_words(b.column(at))
                keep = np.ones(b.num_rows, bool)
                for r, _, _ in items.found(words, first, coverage):
                    keep[r] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

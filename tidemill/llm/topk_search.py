"""Exact top-k by integer inner product, bounded coarse to fine from segment statistics.

Method.  A vector is cut into segments; of each, the mean and the deviation are
kept at several resolutions.  With m and d those of a segment of w components,
x.y <= w * (mx * my + dx * dy) in each segment, as the rests around the means are
orthogonal to them (Cauchy-Schwarz); summed over the segments this bounds the
product from above (and the distance from below).  A bound is itself an inner
product of feature vectors.  For a block of candidates the coarsest bound is taken
for all queries; a query's k best by that bound are computed exactly and give its
threshold; what stays under it is dismissed, coarse to fine; survivors are
computed exactly.  Bounds are widened by a rounding margin, so none is lost.

Queries go out in blocks of bounded size (``query_block`` vectors), each against
every candidate where it lies: no pair is ever a row.  A task sends k rows a query;
these meet in one aggregation by query.  Components too large for that are summed
as whole numbers, and again only the k best of a query leave a task.  Results are checked with integers: sums
that 64-bit floats hold exactly, or Python integers where components are larger.

Defined results: vectors that are null or hold a null or non-finite component take
no part, on either side; vectors of another length than the query's score nothing
with it; a query without candidates has no rows; a null id takes no part; repeated
ids are rows of their own, but the query's own id is never a candidate; ties go to
the smaller id, and equal rows of a repeated id are ranked one after the other;
empty vectors score 0 with one another; scores past 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch

#: Segments of the bounds, coarse to fine.
RESOLUTIONS = (4, 16)
#: Sums below this are exact in 64-bit floats.
EXACT = 2.0**53


def quantised(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(256 * x) for each component; vectors of one length."""
    return np.floor(256.0 * np.stack(vectors).astype(np.float64))


def features(q: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of the vectors from above."""
    n, dim = q.shape
    if dim == 0:
        return np.zeros((n, 1))
    cuts = np.linspace(0, dim, min(segments, dim) + 1).astype(int)
    widths = np.diff(cuts)
    means = np.add.reduceat(q, cuts[:-1], axis=1) / widths
    rest = q - np.repeat(means, widths, axis=1)
    spread = np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1) / widths)
    root = np.sqrt(widths)
    return np.hstack([means * root, spread * root])


def best_of_block(queries, ids, vectors, k: int, floor: np.ndarray):
    """For each query the candidates of one block that may be among its k best, with exact scores.

    ``queries``: (ids, quantised vectors, features by resolution, exact in floats).
    ``floor`` holds each query's k-th score so far in this task and is raised here.
    Yields (query numbers, candidate ids, scores).
    """
    q_ids, q, q_features = queries
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
    margin = 1e-9 * norms + 1e-6
    levels = [features(vectors, s) for s in RESOLUTIONS]
    bound = q_features[0] @ levels[0].T + margin
    own = q_ids[:, None] == ids[None, :]
    bound[own] = -np.inf
    n = vectors.shape[0]
    first = min(k, n)
    top = np.argpartition(-bound, first - 1, axis=1)[:, :first]
    seed = np.einsum("qkd,qd->qk", vectors[top], q)
    seed[np.take_along_axis(own, top, 1)] = -np.inf
    if first == k:
        np.maximum(floor, np.sort(seed, axis=1)[:, 0], out=floor)
    at, to = np.nonzero(bound >= floor[:, None])
    live = bound[at, to] > -np.inf
    at, to = at[live], to[live]
    chunk = 1 << 18
    found_q, found_c, found_s = [], [], []
    for i in range(0, len(at), chunk):
        a, t = at[i : i + chunk], to[i : i + chunk]
        for fine_q, fine in zip(q_features[1:], levels[1:], strict=True):
            keep = np.einsum("nd,nd->n", fine_q[a], fine[t]) + margin[a, t] >= floor[a]
            a, t = a[keep], t[keep]
        s = np.einsum("nd,nd->n", q[a], vectors[t])
        keep = s >= floor[a]
        found_q.append(a[keep])
        found_c.append(t[keep])
        found_s.append(s[keep])
    a, t, s = (np.concatenate(x) if x else np.zeros(0, int) for x in (found_q, found_c, found_s))
    return a, t, s


def keep_best(q, ids, scores, k: int):
    """The k best rows of each query number: highest score, then smallest id."""
    order = np.lexsort((ids, ~scores if scores.dtype == np.int64 else -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    keep = rank < k
    return q[keep], ids[keep], scores[keep]


def _valid(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vector = F.col(vector_col).cast("array<double>")
    return frame.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))


def search(spark: SparkSession, frame: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``frame`` for each row of ``queries``."""
    scratch = Scratch(spark, "topk")
    rows = _valid(frame, id_col, vector_col)
    asked = scratch.save(_valid(queries, id_col, vector_col), "queries")
    names = asked.withColumn("block", F.spark_partition_id()).groupBy("block", F.size("v").alias("dim")).count().collect()  # by file, not by row
    parts = []
    for dim in sorted({r["dim"] for r in names}):
        own = asked.filter(F.size("v") == dim)
        total = sum(r["count"] for r in names if r["dim"] == dim)
        n_blocks = -(-total // query_block)
        if n_blocks > 1:  # a block is a range of hashes, re-cut until it fits
            own = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
        for b in range(n_blocks):
            got = (own.filter(F.col("b") == b) if n_blocks > 1 else own).select("id", "v").toArrow()
            for at in range(0, got.num_rows, query_block):
                parts.append(scratch.save(_one_block(spark, rows, got.slice(at, query_block), dim, k), f"part{len(parts)}"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _one_block(spark: SparkSession, rows: DataFrame, queries: pa.Table, dim: int, k: int) -> DataFrame:
    q_ids = queries.column("id").to_numpy()
    q = quantised([np.asarray(v, np.float64) for v in queries.column("v").to_pylist()])
    shared = spark.sparkContext.broadcast((q_ids, q, [features(q, s) for s in RESOLUTIONS]))  # at most query_block vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, feats = shared.value
        floor = np.full(len(q_ids), -np.inf)
        best = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        wide = float(np.abs(q).max(initial=0))
        large = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))
        exact = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape) if len(q) else q
        for b in batches:
            ids = b.column(0).to_numpy()
            at, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            right = np.flatnonzero(np.diff(at) == dim)
            for i in range(0, len(right), 1024):
                part = right[i : i + 1024]
                v = np.floor(256.0 * flat[at[part][:, None] + np.arange(dim)[None, :]])
                huge = np.abs(v).max(axis=1, initial=0) * wide * max(dim, 1) >= EXACT
                for j in np.flatnonzero(huge).tolist():  # components so large that only whole numbers are exact
                    score = exact @ np.array([int(x) for x in v[j]], object) if dim else np.zeros(len(q), object)
                    other = np.flatnonzero(q_ids != ids[part[j]])
                    score = np.array([int(score[i]) for i in other], np.int64)  # past 64 bits: an error
                    large = keep_best(np.concatenate([large[0], other]), np.concatenate([large[1], np.full(len(other), ids[part[j]])]), np.concatenate([large[2], score]), k)
                part, v = part[~huge], v[~huge]
                if not len(part):
                    continue
                a, t, s = best_of_block((q_ids, q, feats), ids[part], v, k, floor)
                best = keep_best(np.concatenate([best[0], a]), np.concatenate([best[1], ids[part][t]]), np.concatenate([best[2], s]), k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q_ids)) == k)
                if len(full):
                    ends = np.searchsorted(best[0], full, side="right") - 1
                    floor[full] = np.maximum(floor[full], best[2][ends])
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[1]), pa.array(best[2].astype(np.int64))], names=["query_id", "vec_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[large[0]]), pa.array(large[1]), pa.array(large[2])], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

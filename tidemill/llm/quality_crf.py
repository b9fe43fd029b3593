"""Document quality from a linear-chain conditional random field over lines.

Method.  Every line of a text is a place of a chain with two states, bad and good.
A line's features are shares of kinds of characters and words in it, repetition
within it and against the line before, and the same of its two neighbouring lines.
Forward-backward gives each line's marginal probability of good; weighted with the
lines' lengths they add up to the document's score.

Labels are of whole documents, while lines have labels of their own that nobody has
given.  In training a document's label counts as a noisy copy of each of its lines'
labels (wrong with probability ``NOISE``), and the likelihood sums over all label
paths of its lines.  So a line of junk in a good document may be learnt as what it is.
Training is bounded: at most ``TRAIN_DOCS`` documents a class, taken in the order of
a hash of their id, and of those as many whole texts as ``TRAIN_BYTES`` hold.  Only
that bounded list of ids is broadcast.  Scoring covers every line of every text,
where it lies: no shuffle, and chains of a batch advance side by side.

Defined results: null or empty text is one empty line and gets a score like any
other; without any labels of both classes every score is the share of label 1
among those there are, or 0.5; repeated rows are scored each; rows of ``labels`` that
are null, repeated or without a document do no harm; an empty table gives an empty
result; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import as_bytes, mix, text_parts, word_spans

TRAIN_DOCS = 1500
TRAIN_BYTES = 8 << 20
ROUNDS = 120
#: Chance that a line's own label is not its document's.
NOISE = 0.1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_WORD = ~_SPACE
_PLAIN = np.arange(256, dtype=np.uint8)


def _kinds() -> list[np.ndarray]:
    kinds = [np.zeros(256, np.uint8) for _ in range(7)]
    letter, upper, digit, stop, bang, sign, wide = kinds
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    upper[65:91] = 1
    digit[48:58] = 1
    stop[[ord(c) for c in ".,;:'\"-()?"]] = 1
    bang[ord("!")] = 1
    sign[[ord(c) for c in "|#$%&*<>{}[]\\/=+_~^@`"]] = 1
    wide[128:] = 1
    return kinds


_KINDS = _kinds()
#: Features of a line by itself.
OWN = len(_KINDS) + 7
#: With those of both neighbours, two flags for the ends of a text, and a constant.
WIDTH = 3 * OWN + 3


def line_features(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line (with neighbours), lengths of the lines, and each text's first line (n + 1 values)."""
    n_texts = len(offsets) - 1
    newline = np.flatnonzero(raw == 10)
    per_text = np.diff(np.searchsorted(newline, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    start = np.empty(first[-1], np.int64)
    opening = np.zeros(first[-1], bool)
    opening[first[:-1]] = True
    start[opening] = offsets[:-1]
    start[~opening] = newline + 1
    end = np.empty_like(start)
    closing = np.zeros(first[-1], bool)
    closing[first[1:] - 1] = True
    end[closing] = offsets[1:]
    end[~closing] = newline
    size = end - start
    own = np.zeros((len(start), OWN), np.float32)
    some = np.maximum(size, 1)
    for k, kind in enumerate(_KINDS):
        total = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
        own[:, k] = (total[end] - total[start]) / some
    hashes, begin, stop, _ = word_spans(offsets, raw, _IS_WORD, _PLAIN)
    at, to = np.searchsorted(begin, start), np.searchsorted(begin, end)
    words = to - at
    line = np.repeat(np.arange(len(start)), words)
    again = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        again[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))
    key = hashes ^ mix(line.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    _, example = np.unique(key, return_index=True)
    distinct = np.bincount(line[example], minlength=len(start)) if len(line) else np.zeros(len(start), int)
    letters = np.concatenate([[0], np.cumsum(stop - begin)])
    k = len(_KINDS)
    several = np.maximum(words, 1)
    own[:, k] = (again[to] - np.minimum(again[np.minimum(at + 1, to)], again[to])) / several
    own[:, k + 1] = distinct / several
    own[:, k + 2] = (letters[to] - letters[at]) / several / 8
    own[:, k + 3] = np.log1p(size) / 6
    own[:, k + 4] = np.log1p(words) / 4
    own[:, k + 5] = size == 0
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes, dtype=np.uint64)])
    line_sum = sums[to] - sums[at]
    own[1:, k + 6] = (line_sum[1:] == line_sum[:-1]) & ~opening[1:] & (words[1:] > 0)
    full = np.zeros((len(start), WIDTH), np.float32)
    full[:, :OWN] = own
    full[1:, OWN : 2 * OWN][~opening[1:]] = own[:-1][~opening[1:]]
    full[:-1, 2 * OWN : 3 * OWN][~closing[:-1]] = own[1:][~closing[:-1]]
    full[:, -3], full[:, -2], full[:, -1] = opening, closing, 1
    assert len(first) == n_texts + 1
    return full, size, first


def marginals(good: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once.

    ``good`` is the log-odds of good by line, ``transitions`` 2 x 2 log-weights.
    Returns the probability of good by line, the expected counts of transitions
    summed over all chains, and the sum of the chains' log-partition values.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    at, length = first[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]
    alpha = np.zeros((len(good), 2))
    beta = np.zeros((len(good), 2))
    for t in range(steps):
        n = live[t]
        i = at[:n] + t
        if t == 0:
            alpha[i, 1] = good[i]
            continue
        p = alpha[i - 1]
        for y in (0, 1):
            alpha[i, y] = np.logaddexp(p[:, 0] + transitions[0, y], p[:, 1] + transitions[1, y]) + y * good[i]
    ends = at + length - 1
    z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    expected = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        i = at[:n] + t
        nxt = beta[i + 1] + np.stack([np.zeros(n), good[i + 1]], 1)
        for y in (0, 1):
            beta[i, y] = np.logaddexp(nxt[:, 0] + transitions[y, 0], nxt[:, 1] + transitions[y, 1])
            for x in (0, 1):
                expected[y, x] += np.exp(alpha[i, y] + transitions[y, x] + nxt[:, x] - z[:n]).sum()
    owner_z = np.empty(len(first) - 1)
    owner_z[order] = z
    by_line = np.repeat(owner_z, np.diff(first))
    return np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - by_line, 0)), expected, float(z.sum())


class Model:
    """Weights of the field; ``constant`` instead where there was nothing to learn from."""

    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.weights, self.transitions = np.zeros(WIDTH), np.zeros((2, 2))

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Model:
        """Ascend the log-likelihood of the documents' labels, the lines' labels summed out."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.mean[-1], self.scale[-1] = 0, 1
        x = (x - self.mean) / self.scale
        lines = np.diff(first)
        y = np.repeat(labels, lines).astype(float)
        theta = np.zeros(WIDTH + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        told = (2 * y - 1) * np.log((1 - NOISE) / NOISE)  # log-odds of good from the document's label alone
        for k in range(1, rounds + 1):
            odds, transitions = x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
            p, expected, _ = marginals(odds, transitions, first)
            q, given, _ = marginals(odds + told, transitions, first)
            slope = np.concatenate([x.T @ (q - p), (given - expected).ravel()]) / len(y) - 1e-3 * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.weights, self.transitions = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        return self

    def lines(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good by line, lengths of the lines, each text's first line."""
        x, size, first = line_features(*as_bytes(column))
        if self.constant is not None:
            return np.full(len(x), self.constant), size, first
        p, _, _ = marginals(((x - self.mean) / self.scale) @ self.weights, self.transitions, first)
        return p, size, first

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        p, size, first = self.lines(column)
        weight = size + 1.0
        return np.clip(np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents and the labels (doc_id, quality) that may be learnt from."""
    labels = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for q in (0, 1):
        part = labels.filter(F.col("quality") == q).withColumn("h", h).orderBy("h", "doc_id").limit(TRAIN_DOCS)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 * TRAIN_DOCS ids
    before = F.sum(F.octet_length("text")).over(_by_hash().rowsBetween(Window.unboundedPreceding, -1))
    got = texts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < TRAIN_BYTES // 2).select("text", "quality").toArrow()
    y = got.column("quality").to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    x, _, first = line_features(*as_bytes(got.column("text")))
    return Model().fit(x, first, y)


def _by_hash():
    return Window.partitionBy("quality").orderBy("h", "doc_id", "text")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")

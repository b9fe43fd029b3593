import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import quality_crf as Q
from tidemill.llm.common import as_bytes
from tidemill.llm.language_id import held_out

RNG = random.Random(9)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    first = np.cumsum([0, 3, 1, 5, 2])
    good, trans = rng.normal(size=11), rng.normal(size=(2, 2))
    p, expected, z = Q.marginals(good, trans, first)
    want, count, total = np.zeros(11), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(first):
        paths = list(itertools.product((0, 1), repeat=b - a))
        w = np.array([np.exp(sum(y * g for y, g in zip(s, good[a:b], strict=True)) + sum(trans[u, v] for u, v in itertools.pairwise(s))) for s in paths])
        total += np.log(w.sum())
        for s, x in zip(paths, w / w.sum(), strict=True):
            want[a:b] += x * np.array(s)
            for u, v in itertools.pairwise(s):
                count[u, v] += x
    assert np.allclose(p, want) and np.allclose(expected, count) and np.isclose(z, total)


def test_features_of_odd_lines():
    texts = ["", "a", "\n", "A A B\n\nA A B\nA A B", "É!\n", None, "x" * 10]
    x, size, first = Q.line_features(*as_bytes(pa.array(texts)))
    assert first.tolist() == [0, 1, 2, 4, 8, 10, 11, 12]
    assert size.tolist() == [0, 1, 0, 0, 5, 0, 5, 5, 3, 0, 0, 10]
    k = len(Q._KINDS)
    assert x[4, k] == pytest.approx(1 / 3) and x[4, k + 1] == pytest.approx(2 / 3)
    assert x[7, k + 6] == 1 and x[6, k + 6] == 0 and x[4, 1] == pytest.approx(3 / 5)
    assert (x[6, Q.OWN : 2 * Q.OWN] == x[5, : Q.OWN]).all() and (x[7, 2 * Q.OWN : 3 * Q.OWN] == 0).all()


def text(q):
    words = [RNG.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(RNG.randrange(5, 60))]
    if not q:
        words = [w.upper() + "!!" for w in words]
    return "".join(w + RNG.choice("    \n") for w in words)


def test_operator(spark, make_docs):
    rows = [(i, text(i % 2)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, None), (None, 1), (7, 1), (99999, 0)], "doc_id long, quality int")
    docs = make_docs([*rows, (400, None), (401, ""), (402, "\n" * 3000), (None, text(1)), (3, text(1))], extra="score")
    model = Q.fit(docs, labels)
    got = Q.score(docs, model).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.5) == r.doc_id % 2 for r in got if r.doc_id is not None and 200 <= r.doc_id < 300) >= 98
    assert Q.score(docs.limit(0), model).count() == 0
    assert {r.score for r in Q.score(docs, Q.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert Q.fit(docs.limit(0), labels).constant == 0.5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels.filter(~held_out(3, 1)))
    got = Q.score(docs, model).join(labels.filter(held_out(3, 1)), "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) >= 0.97 * len(got)


def test_half_junk_gets_both_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels.filter(~held_out(3, 1)))
    rows = docs.join(labels.filter(held_out(3, 1)), "doc_id").filter("length(text) BETWEEN 300 AND 3000").orderBy("doc_id").select("text", "quality").collect()
    good, bad = ([r.text for r in rows if r.quality == q] for q in (1, 0))
    both = [(g, b) for g, b in zip(good, bad, strict=False)][:30]
    p, size, first = model.lines(pa.array([g + "\n" + b for g, b in both]))
    right = 0
    for i, (g, _) in enumerate(both):
        k, own, w = g.count("\n") + 1, p[first[i] : first[i + 1]], size[first[i] : first[i + 1]] + 1
        right += np.average(own[:k], weights=w[:k]) >= 0.5 > np.average(own[k:], weights=w[k:])
    assert len(both) >= 10 and right >= 0.85 * len(both)

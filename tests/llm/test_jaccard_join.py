import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import jaccard_join as J
from tidemill.llm.common import Scratch
from tidemill.llm.components import components

RNG = random.Random(21)


def reference_components(rows, k, p):
    """(set size, component) by brute force."""
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= p * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def prose(n):
    return [RNG.choice("abcdefgh") + RNG.choice("ijklmnop") + str(RNG.randrange(60)) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[RNG.randrange(len(words))] = "new" + str(RNG.randrange(10**6))
    return words


def corpus():
    texts = [None, "", " \n", "A", "a", "a b", "A  B", "é É", "\x1c a b"]
    for n in (3, 5, 8, 12, 13, 20, 21, 22, 30, 60, 200):
        base = prose(n)
        for _ in range(7):
            texts.append(" ".join(edited(base, RNG.randrange(0, 1 + n // 40))))
            texts.append(" ".join(base[: n - RNG.randrange(0, 1 + n // 9)]))
    near = prose(120)
    texts += [" ".join(edited(near, RNG.randrange(4))) for _ in range(60)]  # a long list
    texts += [" ".join(near).upper()] * 5
    passage = prose(25)
    texts += [" ".join(prose(30) + passage + prose(30)) for _ in range(30)]
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("k", "p", "block"), [(3, 90, 2048), (5, 80, 2048), (3, 90, 8)])
def test_matches_brute_force(spark, make_docs, monkeypatch, k, p, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus()
    found, _, links = J.join(spark, make_docs(rows, extra="cls"), k, p)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == reference_components(rows, k, p)
    assert links.count() > 0


def test_repeats_null_ids_and_empty_table(spark, make_docs):
    t = " ".join(prose(40))
    found, _, _ = J.join(spark, make_docs([(4, t), (4, t), (None, t), (9, t), (2, "x y z"), (None, "q")]), 3, 90)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in found.collect() if r.n_shingles > 1)
    assert got == [(-1, 4), (4, 4), (4, 4), (9, 4)]
    assert J.join(spark, make_docs([]), 3, 90)[0].count() == 0
    kept = J.keep_one(spark, make_docs([(4, t), (7, t), (None, "q"), (1, ""), (2, "")], extra="a"), 5, 80)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 2, 4]


def test_light_keys_lose_nothing():
    for p in (80, 90):
        for x in (5, 12, 20):
            for a in range(1, x + 1):
                for b in range(a, x + 1):
                    c = J.need(a, b, p)
                    assert (c <= a) == (100 * a >= p * b)
                    if c <= a:
                        assert c in J.subset_sizes(a, x, p) and c in J.subset_sizes(b, x, p)
    assert J.subset_count(10, 10, 90) == sum(math.comb(10, c) for c in J.subset_sizes(10, 10, 90))


def test_boundary_follows_the_cost():
    sizes = np.zeros(J.LIGHT_MOST + 1, np.int64)
    sizes[5:40] = 100
    assert J.boundary(sizes, 0.0, 90) < J.boundary(sizes, 500.0, 90)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (100, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_a_proper_subset_links(spark, make_docs):
    words = prose(12)
    rows = [(1, " ".join(words)), (2, " ".join(words[:11])), (3, " ".join(prose(12)))]  # ten shingles and nine of them
    assert 9 in J.subset_sizes(10, 12, 90)
    assert reference_components(rows, 3, 90) == {1: (10, 1), 2: (9, 1), 3: (10, 3)}
    sets = [J.word_sets(pa.array([t]), 3)[0] for _, t in rows]
    assert [len(J._keys(s, np.arange(J.CELLS), 12, 90)) for s in sets] == [J.subset_count(len(s), 12, 90) for s in sets]  # no lists
    found, _, _ = J.join(spark, make_docs(rows), 3, 90, light_most=12)
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 1, 3: 3}


def test_words_made_to_collide_in_a_polynomial_hash(spark, make_docs):
    a = "a"
    for _ in range(11):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    rows = [(1, f"x {a} y z"), (2, f"x {b} y z"), (3, f"x {a} y z"), (4, "lorem " * 200_000)]
    got = {r.doc_id: r.component_id for r in J.join(spark, make_docs(rows), 3, 90)[0].collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}

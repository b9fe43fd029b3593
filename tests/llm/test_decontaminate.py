import random

from tidemill.llm import decontaminate as D

RNG = random.Random(8)


def words(n, tag=""):
    return [RNG.choice("abcdefghij") + RNG.choice("klmnopqrst") + str(RNG.randrange(90)) + tag for _ in range(n)]


def brute_tiling(item, text, k):
    """Greedy string tiling as it is defined: every pass looks at all pairs of places."""
    ui, ut, tiles = [0] * len(item), [0] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not ui[i + n] and not ut[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return sum(t[0] for t in tiles)
        tiles.append(best)
        for x in range(n):
            ui[i + x] = ut[j + x] = 1


def test_tiling_matches_brute_force():
    import numpy as np

    for _ in range(150):
        item = np.array([RNG.randrange(3) for _ in range(RNG.randrange(2, 18))], np.uint64)
        text = np.array([RNG.randrange(3) for _ in range(RNG.randrange(2, 30))], np.uint64)
        tiles = D.tiling(item, text, 2)
        assert len({x for i, _, n in tiles for x in range(i, i + n)}) == sum(n for *_, n in tiles) == len({x for _, j, n in tiles for x in range(j, j + n)})
        assert sum(n for *_, n in tiles) == brute_tiling(item.tolist(), text.tolist(), 2)


def test_repetitive_texts_take_no_pairs_of_places():
    import time

    import numpy as np

    began = time.process_time()
    assert sum(n for *_, n in D.tiling(np.full(5000, 7, np.uint64), np.full(25_000, 7, np.uint64), 5)) == 5000
    two = np.tile(np.array([1, 2, 3], np.uint64), 1700)
    assert sum(n for *_, n in D.tiling(two[:5000], np.concatenate([two[1:4001], [9], two[:900], [8], two[2:1000]]).astype(np.uint64), 5)) >= 4995
    assert time.process_time() - began < 4


def test_string_ids_repeats_ties_and_long_repetitive_text(spark):
    a, b = " ".join(words(12)), " ".join(words(12))
    docs = spark.createDataFrame([("x", a + " " + b + " " + a), ("x", a), ("y", "na " * 150_000), ("z", None)], "doc_id string, text string")
    bench = spark.createDataFrame([("i", a), ("i", a), ("j", b), ("k", "na " * 900), (None, b)], "item_id string, text string")
    got = sorted((r.doc_id, r.item_id or "-", r.n_tiles) for r in D.contamination(docs, bench).collect())
    assert got == sorted([("x", "i", 1), ("x", "i", 1), ("x", "j", 1), ("x", "-", 1), ("x", "i", 1), ("x", "i", 1), ("y", "k", 1)])
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == ["z"]


def test_operator(spark, make_docs):
    item = words(40)
    short = ["tiny", "item"]
    half = item[:20]
    rows = [
        (0, " ".join(words(100, "x") + item + words(30, "x"))),
        (1, " ".join(words(9, "x") + item[20:] + words(50, "x") + half)),  # reordered
        (2, " ".join(item[:12] + words(80, "x"))),
        (3, " ".join(words(3000, "x"))),
        (4, None),
        (5, ""),
        (6, "A TINY, item!"),
        (7, ", ".join(item).upper()),
    ]
    docs = make_docs(rows, extra="item_id")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, ""), (5, " ".join(words(30, "y")))], "item_id long, text string")
    for size in (4 << 20, 50):
        got = {(r.doc_id, r.item_id) for r in D.contamination(docs, bench, block_bytes=size).collect()}
        assert got == {(0, 1), (1, 1), (6, 2), (7, 1)}
        kept = D.clean(docs, bench, block_bytes=size)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == docs.columns
    assert D.contamination(docs, bench.limit(0)).count() == 0
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == len(rows)

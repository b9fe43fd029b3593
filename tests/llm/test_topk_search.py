import math
import random

from tidemill.llm import topk_search as T


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ok if i != qi and len(v) == len(q))[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(map(tuple, T.search(spark, df, df.filter("vec_id % 50 = 0"), **kw).collect()))


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(13)]) for i in range(400)]
    rows += [(i, rows[i - 400][1]) for i in range(400, 460)]  # ties
    rows += [(500, None), (550, [None] * 13), (501, [float("nan")] * 13), (502, [float("inf")] + [0.0] * 12), (503, []), (600, []), (504, [1.0] * 7), (None, [1.0] * 13)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, query_block=3) == brute(rows)


def test_large_components_and_few_rows(spark):
    rows = [(0, [3e6 + 0.37, -2e6]), (1, [2.5e6, 1e6]), (2, [0.5, 0.25])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_many_large_vectors_leave_k_rows_a_task(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-4e6, 4e6) for _ in range(4)]) for i in range(200)] + [(7, [1e6] * 4), (50, [2e6] * 4)]
    want = [r for r in brute(rows) if r[0] != 50]
    assert [r for r in run(spark, rows) if r[0] != 50] == want
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    plan = T.search(spark, df.withColumn("score", df.vec_id), df.filter("vec_id = 0"))
    assert plan.count() == 5

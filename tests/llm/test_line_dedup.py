import hashlib
import random

from tidemill.llm import line_dedup as L
from tidemill.llm.common import Scratch


def reference_rows(rows, least_chars=40, least_docs=5):
    """The contract by brute force."""
    table = str.maketrans({c: c + 32 for c in range(65, 91)})
    key = lambda x: x.strip(L.BLANK).translate(table)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_matches_brute_force(spark, make_docs):
    rng = random.Random(3)
    lines = ["x" * 39, " " + "Y" * 40 + "\t", "é" * 40, "É" * 40, "", "a b c " * 9, "z" * 45]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for i in range(40)] + [(50, None), (51, "")]
    rows.append((60, "\n".join(lines * 3)))
    out = L.dedup_lines(spark, make_docs(rows, extra="n_lines")).collect()
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out}
    assert got == reference_rows(rows)


def test_nulls_repeats_and_empty_table(spark, make_docs):
    long = "w" * 50
    rows = [(None, long)] + [(i, long) for i in range(5)] + [(4, long)]
    out = L.dedup_lines(spark, make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in out if r.doc_id is not None) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (4, 0)]
    assert [r.n_dropped for r in out if r.doc_id is None] == [1]
    assert L.dedup_lines(spark, make_docs([])).count() == 0


def test_repeated_ids_are_one_document(spark, make_docs):
    long = "v" * 50
    rows = [(1, long)] * 4 + [(2, long)]
    assert [r.n_dropped for r in L.dedup_lines(spark, make_docs(rows)).collect()] == [0] * 5
    rows += [(3, long), (4, long), (5, long)]
    got = sorted((r.doc_id, r.n_dropped) for r in L.dedup_lines(spark, make_docs(rows)).collect())
    assert got == [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 1), (5, 0)]


def test_string_ids_and_very_long_text(spark):
    long = "w" * 50
    big = "\n".join([long, *(f"line {i} of a very long text, number {i}" for i in range(60_000)), long])
    docs = spark.createDataFrame([("b", long), ("a", long), ("e", "x\n" + long), ("d", big), ("c", long), (None, long)], "doc_id string, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in L.dedup_lines(spark, docs).collect()}
    assert got == {"a": (1, 1), "b": (1, 1), "c": (1, 1), "d": (60_002, 2), "e": (2, 0), None: (1, 1)}


def test_runs_compact_and_anti_join(spark):
    runs = L.LineRuns(Scratch(spark, "t"), fanout=2)
    keys = lambda lo, hi: spark.range(lo, hi).selectExpr("id AS doc_id", "CAST(concat('k', id % 7) AS binary) AS key")
    assert runs.unseen(keys(0, 3)).count() == 3
    for i in reversed(range(4)):
        runs.add(keys(i * 5, i * 5 + 5))
    assert sum(runs.read(runs.names()).groupBy("key").count().filter("count > 1").count() for _ in "x") == 0  # a key is in one run
    assert runs.unseen(keys(0, 20)).count() == 0
    assert {bytes(r.key): r.last_doc for r in runs.verdict(3).collect()} == {f"k{m}".encode(): max(x for x in range(20) if x % 7 == m) for m in range(7) if len([x for x in range(20) if x % 7 == m]) >= 3}
    runs.drop()


def test_the_anti_join_decides(spark, monkeypatch, make_docs):
    hold = {"a": (22, 23, 24, 35), "b": (3, 9, 14, 28, 39), "c": range(40)}  # batches are of ten documents
    rows = [(i, "\n".join(c * 45 for c in "abc" if i in hold[c])) for i in range(40)]
    run = lambda: {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in L.dedup_lines(spark, make_docs(rows)).collect()}
    assert run() == reference_rows(rows)
    monkeypatch.setattr(L.LineRuns, "unseen", lambda self, batch: batch)
    assert run() != reference_rows(rows)

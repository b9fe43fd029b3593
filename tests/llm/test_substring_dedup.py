import hashlib
import random

import pytest

from tidemill.llm import substring_dedup as S

RNG = random.Random(12)


def reference_rows(rows, length=50):
    """The contract by brute force."""
    least = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            least[s] = min(least.get(s, i), i)
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if least[data[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def prose(n):
    return " ".join("".join(RNG.choice("abcdeé ") for _ in range(RNG.randint(2, 9))) for _ in range(n))


def run(spark, docs):
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in S.removals(spark, docs).collect()]


@pytest.mark.parametrize(("copies", "hot", "most", "held"), [(1 << 20, 2048, 1 << 30, 200_000), (0, 1, 1 << 18, 5), (1 << 20, 6, 1 << 30, 50)])
def test_matches_brute_force(spark, make_docs, monkeypatch, copies, hot, most, held):
    for name, x in (("COPIES_BROADCAST", copies), ("HOT", hot), ("FILTER_MOST", most), ("HELD", held)):
        monkeypatch.setattr(S, name, x)
    passages = [prose(k) for k in (8, 9, 10, 20, 60)]
    rows = []
    for i in range(120):
        rows.append((i * 3 % 121, "".join(RNG.choice([prose(RNG.randrange(12)), RNG.choice(passages), RNG.choice(passages)[RNG.randrange(20):]]) for _ in range(RNG.randrange(5)))))
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, "Ha " * 90), (203, "Ha " * 60 + "x"), (204, "x" * 49), (205, "x" * 50), (206, "x" * 51), (207, None), (208, "")]
    rows += [(209, "a" * 30 + "b" * 300), (210, "c" + "b" * 120)]
    assert dict(run(spark, make_docs(rows, extra="kept"))) == reference_rows(rows)


def test_repeated_ids_null_ids_and_empty_table(spark, make_docs):
    a, b = prose(30), prose(30)
    rows = [(5, a), (5, a), (5, b + a), (None, a), (9, "q" + a + "q")]
    got = run(spark, make_docs(rows))
    n = len(a.encode())
    assert sorted(x[1] for i, x in got if i == 5) == [0, 0, 0]
    assert [x[1] for i, x in got if i is None] == [0]
    assert [x[1] for i, x in got if i == 9] == [n]
    assert run(spark, make_docs([])) == []

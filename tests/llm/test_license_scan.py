import random

from tidemill.llm import license_scan as L

RNG = random.Random(4)


def noise(n):
    return " ".join(RNG.choice(["alpha", "beta", "gamma", "licence", "the", "version", "under"]) for _ in range(n))


def changed(text, share):
    w = text.split()
    for i in RNG.sample(range(len(w)), int(share * len(w))):
        w[i] = "changed"
    return " ".join(w)


def brute(rows, threshold=0.8):
    out = set()
    for i, t in rows:
        own = set(L.shingles_of(t or ""))
        for name, text in L.TEMPLATES.items():
            want = set(L.shingles_of(text))
            if len(own & want) / len(want) >= threshold:
                out.add((i, name, len(own & want), len(want)))
    return out


def test_matches_brute_force(spark, make_docs):
    rows = [(0, None), (1, ""), (2, "license"), (3, noise(400))]
    for k, text in enumerate(L.TEMPLATES.values()):
        rows.append((10 + k, noise(RNG.randrange(300)) + " " + text.upper() + " " + noise(50)))
        rows.append((30 + k, noise(70) + ".\n" + changed(text, 0.03) + "; " + noise(9)))
        rows.append((50 + k, text + noise(3) + changed(text, 0.5)))
    rows.append((90, " ".join(L.TEMPLATES.values()) + noise(5000)))
    got = {(r.doc_id, r.license, r.n_found, r.n_shingles) for r in L.scan_licenses(make_docs(rows, extra="h")).collect()}
    assert got == brute(rows)
    assert len({i for i, *_ in got if 10 <= i < 30}) == len(L.TEMPLATES)


def test_sieve_loses_nothing():
    chosen = L.sieve_words(L.TEMPLATES, 0.8)
    for text in L.TEMPLATES.values():
        s = set(L.shingles_of(text))
        assert sum(not any(w in x.split() for w in chosen) for x in s) < 0.8 * len(s)


def test_empty_and_repeated(spark, make_docs):
    assert L.scan_licenses(make_docs([])).count() == 0
    assert L.scan_licenses(make_docs([(None, "Released under the MIT License."), (7, "released under the mit license")] * 2)).count() == 4

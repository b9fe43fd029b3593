import random

from tidemill.llm import language_id as L

RNG = random.Random(6)
SYLLABLES = {"aa": ["ba", "bo", "ki"], "bb": ["tru", "sé", "zim"], "cc": ["ба", "ко", "ли"]}


def prose(lang, n):
    return " ".join("".join(RNG.choice(SYLLABLES[lang]) for _ in range(RNG.randint(1, 4))) for _ in range(n)).capitalize()


def phrases(train, text):
    """Cross-parsing by plain substring search."""
    n, at = 0, 0
    while at < len(text):
        to = at + 1
        while to <= len(text) and text[at:to] in train:
            to += 1
        n, at = n + 1, max(to - 1, at + 1)
    return n


def test_long_texts_are_parsed_whole():
    texts = {k: prose(k, 400) for k in SYLLABLES}
    m = L.Model(texts)
    mixed = lambda n: " ".join(prose(RNG.choice(list(SYLLABLES)), 3) for _ in range(n))
    given = [mixed(500)[:5000], mixed(6000)[:50_000], "".join(RNG.choice("abc ωtru") for _ in range(9000)), texts["aa"] * 3, "a" * 5000, "ω" * 3000, ""]
    cost, _ = m.costs(given, m.fold_table())
    for t, row in zip(given, cost, strict=True):
        plain = L.folded(t)
        while "  " in plain:
            plain = plain.replace("  ", " ")
        for k, lang in enumerate(m.languages):
            train = " ".join(L.folded(texts[lang]).split())[: L.TRAIN_CHARS]
            known = set(train)
            assert round(row[k] / m.bits[k]) == phrases(train, "".join(c if c in known or c == " " else "\0" for c in plain))


def test_ties_go_to_the_first_language():
    m = L.Model({"b": "lorem ipsum dolor", "a": "lorem ipsum dolor"})
    cost, _ = m.costs(["lorem dolor sit"], m.fold_table())
    assert cost[0, 0] == cost[0, 1] and m.languages[cost.argmin()] == "a"


def test_many_letters_make_no_large_table():
    m = L.Model({"zh": "".join(chr(0x4E00 + RNG.randrange(4000)) for _ in range(20_000)), "en": prose("aa", 2000)})
    assert m.alphabet > 3000 and sum(x.nbytes for a in m.automata for x in (a.owner, a.next)) < 4 << 20


def test_costs_are_those_of_plain_cross_parsing():
    texts = {k: prose(k, 60) for k in SYLLABLES}
    m = L.Model(texts)
    given = [prose(RNG.choice(list(SYLLABLES)), RNG.randrange(1, 40)) + RNG.choice(["", " 12!", "  ω"]) for _ in range(60)] + ["", "12 34", "ß"]
    cost, letters = m.costs(given, m.fold_table())
    for t, row, n in zip(given, cost, letters, strict=True):
        plain = L.folded(t)
        while "  " in plain:
            plain = plain.replace("  ", " ")
        for k, lang in enumerate(m.languages):
            train = " ".join(L.folded(texts[lang]).split())
            known = set(train)
            # separators are symbol 0 and unknown letters symbol 1, which no training text holds
            assert round(row[k] / m.bits[k]) == phrases(train, "".join(c if c in known or c == " " else "\0" for c in plain)), (t, lang)
        assert n == sum(c.isalpha() for c in t)


def test_operator(spark, make_docs):
    rows = [(i, prose(k, RNG.randrange(3, 60))) for i, k in enumerate(list(SYLLABLES) * 40)]
    lang = {i: list(SYLLABLES)[i % 3] for i, _ in rows}
    labelled = spark.createDataFrame([(i, t, lang[i]) for i, t in rows] + [(900, "x", None), (901, None, "aa")], "doc_id long, text string, lang string")
    model = L.fit(labelled.filter(~L.held_out(5, 0)))
    docs = make_docs([*rows, (500, None), (501, ""), (502, "123 !?"), (503, prose("bb", 4000)), (None, prose("cc", 9)), (503, prose("bb", 5))], extra="score")
    got = {}
    for r in L.identify(docs, model).collect():
        assert 0 <= r.score <= 1
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert got[500] == got[501] == got[502] == ["und"] and got[503] == ["bb", "bb"] and got[None] == ["cc"]
    assert sum(got[i] == [lang[i]] for i in lang) >= 0.95 * len(lang)
    assert L.identify(docs.limit(0), model).count() == 0
    nothing = L.fit(labelled.filter("lang = 'zz'"))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = L.held_out(5, 0)
    got = L.identify(docs, L.fit(docs.filter(~held))).join(docs.filter(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)

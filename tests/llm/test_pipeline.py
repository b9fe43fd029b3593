import random

import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute_tiling
from test_jaccard_join import reference_components

import corpus_pipeline
from tidemill.llm import decontaminate, line_dedup

RNG = random.Random(17)


def prose(n):
    return [RNG.choice("abcdefgh") + RNG.choice("ijklmnop") + RNG.choice("qrstuv") + str(RNG.randrange(9)) for _ in range(n)]


def lines_kept(rows):
    holders = {}
    key = lambda x: x.strip(line_dedup.BLANK)  # noqa: E731  the fixture has no capitals in lines
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    return [(i, t and "\n".join(x for x in t.split("\n") if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i)) for i, t in rows]


def brute(rows, items):
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = lines_kept(rows)
    groups = reference_components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if not t.split() or groups[i][1] == i]
    return {i: t for i, t in rows if all(brute_tiling(m.split(), t.split(), min(5, len(m.split()))) < decontaminate.COVERAGE * len(m.split()) for m in items)}


def test_pipeline_matches_brute_force(spark, tmp_path):
    items = [" ".join(prose(24)), " ".join(prose(30))]
    shared = " ".join(prose(14))
    rows = [(i, " ".join(prose(RNG.randrange(1, 60)))) for i in range(40)]
    rows += [(40 + i, shared + "\n" + " ".join(prose(30))) for i in range(7)]
    base = prose(80)
    rows += [(50 + i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(9)]
    w = items[0].split()
    rows += [(60, None), (61, ""), (62, "12 34 !"), (63, " ".join(prose(20) + w[12:] + prose(9) + w[:12])), (64, items[1]), (65, " ".join(items[1].split()[:9] + prose(40))), (66, "\n".join([shared] * 2))]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(rows, items)
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == corpus_pipeline.COLUMNS, name
    assert {r.doc_id: r.text for r in now.collect()} == want
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(want)


def test_unexplained_texts_go_and_missing_labels_are_filled_in(spark, tmp_path):
    rows = [(i, " ".join(prose(30)), "en") for i in range(20)] + [(30, "ωψξ жщю " * 40, None), (31, " ".join(prose(30)), None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    assert got == {i: "en" for i in range(20)} | {31: "en"}
    with pytest.raises(ValueError, match="language"):
        corpus_pipeline.STAGES[0][1](spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path))


def test_repeated_ids_and_empty_benchmark(spark, tmp_path):
    rows = [(i // 2, " ".join(prose(30))) for i in range(12)] + [(7, " ".join(prose(30) * 1000))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got if r.piece == 0) == sorted(i for i, _ in rows)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

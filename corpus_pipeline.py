"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that its predecessor kept; its output is written as Parquet
and read again as the next one's documents.  All but the last return the columns of
``documents``.

1. ``language_id`` drops documents of which no language can be told: those without
   letters, and those that no language known explains (under ``EXPLAINED`` letters a
   phrase of the best one).  Where ``lang`` is null, the language told is filled in.
   Without any labelled row there is nothing to tell languages by, and the stage fails.
2. ``line_dedup`` drops lines that five documents share from all but the last one.
3. ``jaccard_join`` keeps one document of each group of near copies (five-word
   shingles, similarity of 0.8 or more).
4. ``decontaminate`` drops documents that leak an item of ``benchmark``.
5. ``best_fit_packing`` packs what is left into sequences of 4096 tokens.

Defined results: nulls, empty and very long texts, repeated rows and empty tables
are handled as the operators' docstrings say; columns past those of ``documents``
are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from tidemill.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL for tokenisation and best fit; tests hold the pipeline against brute force.
ORACLE_SQL = None


#: Letters that a phrase of the cross-parse must have on the average.
EXPLAINED = 1.25


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    model = language_id.fit(docs)
    if not model.languages and not docs.isEmpty():
        raise ValueError("no row of the documents has a language to learn from")
    labelled = language_id.label(docs, model)
    told = labelled.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("phrase_letters") >= EXPLAINED))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def _jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(spark, docs.select(COLUMNS), k=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", _language_id),
    ("line_dedup", _line_dedup),
    ("jaccard_join", _jaccard_join),
    ("decontaminate", _decontaminate),
    ("best_fit_packing", _best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"{k}-{name}")
            if k:
                scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs

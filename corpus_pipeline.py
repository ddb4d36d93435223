"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verispark.llm import decontam, langid, ngram_join, packing, quality
from verispark.llm.sampling import remainder
from verispark.llm.tables import store, table


def _filtered(docs: DataFrame, judged: Column, condition: Callable[[Column], Column]) -> DataFrame:
    """The rows of `docs` whose judgement meets the condition; its column has a name that `docs` has not."""
    name = "_judged"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, judged).filter(condition(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text or no letter in it, or a score below that of all held-out texts.

    The model learns from rows with crc32(doc_id) mod 3 <> 1, the bound comes from all others (`langid.least_score`).
    Where no row has a language, all documents with a letter stay. Repeated rows and null ids are judged each for
    itself; an empty table gives none; all columns stay, whatever their names.
    """
    text = F.col("text").cast("string")
    known = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"))
    model = langid.train(known.filter(remainder("doc_id", 3) != 1))
    if model is None:
        return docs.filter(text.rlike(r"\p{L}"))
    least = langid.least_score(model, known.filter(remainder("doc_id", 3) == 1))
    return _filtered(docs, langid.judged(text, model), lambda j: (j["lang_pred"] != langid.UNKNOWN) & (j["score"] >= least))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier predicts as label 0.

    A null text counts as empty; without any label all documents stay. Repeated rows and null ids are judged each for
    itself; an empty table gives none; all columns stay, whatever their names.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(remainder("doc_id", 5) != 0)
    net = quality.train(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    return _filtered(docs, quality.judged(F.col("text").cast("string"), net), lambda j: j["predicted"] == 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays.

    Null and empty texts link with nothing; rows that repeat an id are cut to one, rows without an id all stay.
    """
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; rows without an id and those with a null or empty text stay."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place; a null or empty text is the separator alone."""
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", packed),
]

# Learned classifiers and the packing have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

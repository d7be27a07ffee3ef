"""From raw documents to pieces: five stages, each a DataFrame to a DataFrame. Every stage sees all that the one before kept.

Rows may repeat, and any column may be null or extra; stages keep the columns of their input (the last adds its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common, decontaminate, language, pieces, simhash, substring_dedup

#: A language is taken from this posterior on; texts without a letter have none.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language that the model knows for sure. It learns from the stage's own rows with a language;
    where no row has one there is no model, and only texts without a letter are rejected."""
    columns = docs.columns
    model = language.train(language.bounded(docs.where("lang is not null"), "doc_id"))
    if not model[0]:
        return docs.where(r"text rlike '\\p{L}'")
    return language.predict(docs, model).where(f"lang_pred != 'und' and score >= {LEAST_SCORE}").select(columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return simhash.deduplicated(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what repeats an earlier passage of LENGTH bytes or more; n_chars follows the text."""
    return substring_dedup.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, give or take its error budget."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds sampled pieces, and whether they decode to the text."""
    both = pieces.decoded(pieces.encode(docs))
    return both.withColumn("lossless", F.expr("decoded <=> text")).drop("decoded")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", segmentation),
]

#: Trained models, fingerprints, suffix arrays, edit distances and sampled lattices are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`. Each stage's rows are written to the shared folder and read again, so that the next one,
    which reads them several times, doesn't work them out several times."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = common.written(docs, f"stage-{k}")
    return docs

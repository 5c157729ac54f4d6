"""The corpus pipeline: quality, near duplicates, benchmark passages, packing.

Every stage takes tables with nulls in any column, empty and very long texts,
repeated rows and columns of any names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from keyfold.llm import fm_index, minhash, packing, quality
from keyfold.llm.common import Scratch, free_name, scratch_scope
from keyfold.session import table

#: A document goes if its quality score is lower.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the attention classifier does not reject; columns as they come.

    Null and empty texts are scored like others; repeated rows share their score.
    """
    model, score = quality.train(docs, table(spark, sf_dir, "labels")), free_name(docs.columns, "score")
    return quality.score_documents(docs, model, columns=tuple(docs.columns), score=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest key.

    The decision is a row's own: repeated and null keys hide no copy. Texts
    without words are in no group and all stay.
    """
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every benchmark passage: merged spans of ten words and more are cut out of the text.

    All rows stay, null texts as they are; ``n_chars``, if there, is counted again.
    """
    hits = fm_index.clean_texts(docs, table(spark, sf_dir, "benchmark"))
    return hits.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hits


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens of what is left; null and empty texts are one piece of the end id."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: SQL can express neither the learned classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written and read again; what a stage wrote on its way is freed then."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch_scope():
            done = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)

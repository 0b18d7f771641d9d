"""Corpus pipeline: five stages applied one after another to ``documents``.

Every stage but the last returns rows with the columns of ``documents``; the
last returns the packed pieces of what the others kept.

Defined cases, of every stage: nulls may stand in any column; rows are told
apart by doc_id and text, so null and repeated ids are rows like others; extra
columns may have any name and come through; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataframe.llm import exact_dedup, jaccard_join, langid, packing, pii
from strataframe.llm._common import drop_stages, stage_mark, stage_table, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay; null and empty texts and those without letters go."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the largest doc_id stays, in one row; a null id only where no copy has one."""
    return exact_dedup.keep_one_per_text(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the least doc_id stays, in one row; texts without words are no copies."""
    return jaccard_join.keep_one_per_class(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind; every row stays."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; every row is packed, a null text as its end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("pii", private), ("best_fit_packing", packed)]

#: The tokenizer, the LSH forest and the fitted models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), stage_mark()
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        # what this stage read and made on its way is not read again
        drop_stages(spark, before, stage_mark() - 1)
        before = stage_mark() - 1
    return STAGES[-1][1](spark, docs, sf_dir)

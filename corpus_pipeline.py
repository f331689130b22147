"""A training corpus from ``documents``: five stages, each written and read again before the next.

Every stage but the last returns the columns of ``documents``.  Texts that
quality rules or language identification reject go; one document of each
near-duplicate class stays; words of passages that occurred before are removed
(a document that loses all of them goes); what is left is packed.

Columns beyond those of ``documents`` are carried along, whatever their names.
A null or wordless text fails the quality rules; of rows that repeat a doc_id
and text one stays; an empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import language, near_dup, packing, quality, repeats
from quillframe.llm.catalog import tokenizer
from quillframe.llm.common import materialise, table, unwrap


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(docs, layout=True).filter(F.col("n_words") > F.col("n_removed"))
    left = unwrap(rows, docs.columns, text="kept_text")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Expectation-maximisation, a trained network and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

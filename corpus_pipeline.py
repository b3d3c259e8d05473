"""Documents to training tokens: toxicity, quality rules, near-duplicates, mixing, BPE.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the next stage's
docs, so every stage works on all rows that its predecessor kept. All stages but the last return the columns of the
documents table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayzero.llm import bpe, mixing, near_text, quality, toxicity
from dayzero.llm.common import read, ready, written

BPE_FILE = "word_bpe_49k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model of the labelled ones among them."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    graded = toxicity.grade_documents(docs, model, carried=docs.columns)
    return graded.where(~F.col("toxic")).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed limits and are no outliers of their language and source."""
    return quality.judge_quality(docs, carried=docs.columns).where("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles at a similarity of 0.8.

    Rows that share an id are one document and stay or go together.
    """
    ready(spark)
    judged = near_text.near_duplicates(docs, width=5, percent=80)
    gone = written(judged.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")), "duplicates")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those that it does not take go."""
    mixed = mixing.mix(docs, carried=docs.columns).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and digests of the ids and of the text that they decode to, for each row of the mix."""
    ready(spark)
    coded = bpe.encode_documents(docs, public_tokenizers.path(BPE_FILE), carried=["doc_id"], with_ids=True)
    return coded.select("row.doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Only single stages can be written in SQL; the tests compare run() with a brute-force version of the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

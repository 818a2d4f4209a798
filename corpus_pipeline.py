"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. The first four return the columns of ``documents`` as they are, with any
others, whatever their names; the last returns the pieces of the packed
sequences. Null and empty texts, very long ones, ties, repeated rows, null ids
and empty tables have a defined result in each, which the stage names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectrail.llm import near_dup, packing, quality_qda, quality_rules, secret_ledger
from vectrail.session import materialise, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant takes for junk go. Without labels of both classes all stay.

    Null and empty texts have a score like any other; a score at the limit stays; repeated rows go or stay together.
    """
    return quality_qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def adaptive_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond the fences of their language and source go.

    A null text counts as '', null languages and sources are groups of their own; a value at a threshold stays; repeated rows go or stay together.
    """
    return quality_rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    Rows that agree in id and text count as one and stay once; null texts and texts without words are nobody's duplicates; ties go to the smaller id, a null id is the last.
    """
    return near_dup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their rule; every document stays.

    Null texts stay null; texts are rewritten whole, repeated rows each.
    """
    return secret_ledger.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences they are packed into.

    Documents without words, null texts among them, give no row; repeated rows are packed each; ties in length go by id and text.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", adaptive_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's matrices, the banding and the search for packings can't be put into SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
            release(before)
    return docs

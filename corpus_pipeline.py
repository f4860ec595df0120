"""A corpus pipeline: each stage reads what the stage before it wrote.

A stage is a function of (spark, docs, sf_dir); all but the last return the columns
of ``documents``, further columns of ``docs`` included. Null and empty texts, null
ids, repeated rows and empty tables pass every stage without an error; what each does with
them stands in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revdiff.llm import decontaminate, minhash, packing, quality, secret_scan
from revdiff.llm.storage import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are judged by their statistics, repeated rows alike; rows with a
    null id are judged and not learned from.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near duplicates.

    Null and empty texts are like nothing and stay, and so do rows with a null id; of rows
    equal in id and text one stays, and texts that only share an id are judged apart.
    """
    return minhash.keep_first(docs, shingle=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by passages of ``benchmark``.

    Null and empty texts have no words and stay; each row is judged by its own text, whatever
    its id. Without items all rows stay.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked.

    Null texts stay null; every row stays.
    """
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 1024 tokens, in pieces with their token ids.

    A null text is an empty one, which is its end alone; repeated rows are packed each.
    """
    return packing.pack_documents(docs, size=1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokeniser; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

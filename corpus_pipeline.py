"""A training-text pipeline over ``documents``: toxic texts go, one of each group of near-duplicates stays, personal data is
replaced, sources are mixed to their weights, and the texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; n_chars follows the text where a stage changes it. Defined cases are those of the operators: null and empty texts are
kept by the first stages (as one of them in the second), and are not taken by the mix, which takes words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm import mixing, pieces, pii, shingles, toxicity
from junctura.llm.common import remove, shared_dir, table


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [("toxicity", harmless), ("near_duplicates", distinct), ("pii", private), ("mixing", mixed), ("sentencepiece", encoded)]
#: No stage but the mix can be written in SQL; tests hold each stage against plain versions, and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again, and goes when the next is written."""
    import uuid

    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{n}-{name}")
        if n:
            remove(spark, f"{folder}/{n - 1}-{STAGES[n - 1][0]}")
        docs = spark.read.parquet(path)
    return docs

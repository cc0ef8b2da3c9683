"""Training-data pipeline over ``documents``: five stages, each one operator.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet in the shared folder and read again as the next stage's
``docs``: executors may be lost at any time, and a stage starts from files.
All stages but the last return the columns of ``documents``.

1. ``toxicity``: documents scored at 0.3 or more go.
2. ``ngram_join``: of each class of near copies one document stays.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``secrets``: spans are replaced by their kind, ``n_chars`` is set anew.
5. ``packing``: the rest is tokenised and packed; one row per piece.

Rows with a null text count as empty and stay (they pack to one end id);
rows with a null id stay; empty tables give empty results; further columns of
``documents`` are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlytics.llm import decontaminate, ngram_join, packing, secrets, toxicity
from meterlytics.llm.common import cut, prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: scores and token ids are beyond SQL; the tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

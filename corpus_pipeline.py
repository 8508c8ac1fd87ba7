"""Corpus preparation: five stages, each calling one operator of ``souk.llm``.

Every stage function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.llm import stages
from souk.sources.staging import stage

STAGES = stages.STAGES

#: No SQL form: language models, fingerprints and encoders are not SQL; the
#: pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return docs

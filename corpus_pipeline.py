"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.

Stages and what their decisions do:

* quality_rules: documents that the bounds or the outlier test reject go;
* near_dedup: one document of each near-duplicate group stays (five-word
  shingles, similarity 0.8 or more);
* decontamination: documents of which one word in twenty or more stands in a
  window of a benchmark item go;
* secret_scan: every secret found is masked in the text, ``n_chars`` follows;
* packing: what is left becomes pieces of 1024-token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolegrid.llm import decontaminate, minhash, packing, quality_rules, secret_scan
from rolegrid.llm.common import write_once
from rolegrid.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", pack),
]

# Near-duplicate components and the trained scan are beyond SQL; tests/llm
# holds a brute-force version of the whole pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

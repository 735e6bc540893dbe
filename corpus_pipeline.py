"""Corpus preparation: the stages of the training-data pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with the
columns of ``documents``; the last returns packed pieces. ``run`` writes every stage's
result as Parquet in the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlab.llm import decontaminate, lm_quality, ngram_join, packing, secret_scan
from spanlab.llm.common import table, written

# Texts travel to Python workers in Arrow batches; at the default of 10,000 rows and 64 MB,
# what JVM and workers hold at a time follows the length of the texts.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = str(4 << 20)

STAGES = [
    ("quality_lm", lm_quality.stage_quality),
    ("near_duplicates", ngram_join.stage_near_duplicates),
    ("decontaminate", decontaminate.stage_decontaminate),
    ("secret_scan", secret_scan.stage_secrets),
    ("packing", packing.stage_packing),
]

# No SQL states a language model, least squares or a tokenizer; tests/llm/test_pipeline.py
# checks each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage has run when it returns."""
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(BATCH, before)
    return docs

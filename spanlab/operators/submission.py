"""Submission rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import text as T

SUBMISSION_COLUMNS = ["tweet_id", "predicted_class", "span_start", "span_end", "span"]


def submission_rows(df: DataFrame, task: str) -> DataFrame:
    """Class ``ADE`` rows of the shared-task file.

    Classification: rows whose prediction (dots stripped) equals ``adverse event
    problem`` (case-sensitive), offsets ``'0'`` and span ``-``. Extraction: drop
    ``none``, locate the span case-insensitively (B13), drop spans not found.
    """
    p = T.normalise_prediction("predicted_text", lower=False)
    x = df.withColumn("predicted_text", p)
    if task == "classification":
        return x.filter(F.col("predicted_text") == F.lit(T.POSITIVE_CLASS_TEXT)).select(
            "tweet_id",
            F.lit("ADE").alias("predicted_class"),
            F.lit("0").alias("span_start"),
            F.lit("0").alias("span_end"),
            F.lit("-").alias("span"),
        )
    found = x.filter(T.has_span("predicted_text")).select(
        "tweet_id",
        F.lit("ADE").alias("predicted_class"),
        T.span_start("tweet", "predicted_text").cast("string").alias("span_start"),
        T.span_end("tweet", "predicted_text").cast("string").alias("span_end"),
        F.col("predicted_text").alias("span"),
    )
    return found.filter(F.col("span_start") != F.lit("-1"))


def dropped_spans(df: DataFrame) -> DataFrame:
    """Count of extraction rows dropped by B14 because the predicted span is not found
    in the text (the reference drops them silently); one row ``n_dropped``."""
    p = T.normalise_prediction("predicted_text", lower=False)
    x = df.withColumn("predicted_text", p).filter(T.has_span("predicted_text"))
    return x.agg(F.count_if(T.span_start("tweet", "predicted_text") == F.lit(-1)).alias("n_dropped"))

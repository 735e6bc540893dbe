"""Small analysis aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import text as T


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequencies of a column, descending (ties by value); nulls dropped as pandas does."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def avg_words(df: DataFrame, col: str) -> DataFrame:
    """E5: mean whitespace-token count of a text column (0 for blank texts)."""
    return df.agg(F.avg(T.word_count(col).cast("double")).alias("avg_words"), F.count(F.col(col)).alias("n_texts"))


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    """Size of the distinct set."""
    return df.agg(F.count_distinct(F.col(col)).alias("n_distinct"))

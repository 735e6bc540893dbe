"""Error analysis per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import joins


def class_errors(runs: DataFrame, gold: DataFrame, key: str = "tweet_id") -> DataFrame:
    """K1: each prediction row with ``class`` (B12 of the prediction), ``label`` (B12 of the
    gold, null when the id has no gold) and ``error_kind`` ``fp`` / ``fn`` / null.

    The gold is binarised *before* the left join, so a row without gold stays null
    and is neither kind of error.
    """
    g = gold.select(key, T.binarise("target_text").alias("label"))
    x = runs.withColumn("class", T.binarise("predicted_text")).join(g, key, "left")
    kind = (
        F.when((F.col("class") == "ADE") & (F.col("label") == "NoADE"), F.lit("fp"))
        .when((F.col("label") == "ADE") & (F.col("class") == "NoADE"), F.lit("fn"))
    )
    return x.withColumn("error_kind", kind)


def span_errors(runs: DataFrame, gold: DataFrame, key: str = "tweet_id") -> DataFrame:
    """K2: predictions (dots stripped, case kept) with the gold span and four flags.

    ``mismatch``: gold differs from the prediction, null-safe (a missing gold is a
    mismatch, as pandas ``!=``); ``fn``: gold has a span, prediction ``none``;
    ``fp``: gold ``none``, prediction has a span; ``partial``: both have a span and
    differ. A missing gold counts as "has a span" (pandas ``!= 'none'`` is true).
    """
    p = runs.withColumn("predicted_text", T.normalise_prediction("predicted_text", lower=False))
    x = joins.attach_gold(p, gold, key, "target_text", "gold_text")
    g, pr = F.col("gold_text"), F.col("predicted_text")
    gold_has = ~g.eqNullSafe(T.NEGATIVE_SPAN)
    pred_has = ~pr.eqNullSafe(T.NEGATIVE_SPAN)
    ne = ~g.eqNullSafe(pr)
    return x.select(
        "*",
        ne.alias("mismatch"),
        (gold_has & pr.eqNullSafe(T.NEGATIVE_SPAN)).alias("fn"),
        (g.eqNullSafe(T.NEGATIVE_SPAN) & pred_has).alias("fp"),
        (gold_has & pred_has & ne).alias("partial"),
    )


def errors_per_run(flags: DataFrame, kinds=("mismatch", "fn", "fp", "partial"), run: str = "model") -> DataFrame:
    """Row count per run for each error kind (one pass, partial aggregation)."""
    return flags.groupBy(run).agg(*[F.count_if(F.col(k)).alias(f"n_{k}") for k in kinds])


def nonnull_counts(df: DataFrame, by: str = "model") -> DataFrame:
    """Non-null count of every column per run, as a pandas ``groupby().count()``."""
    return df.groupBy(by).agg(*[F.count(F.col(c)).alias(c) for c in df.columns if c != by])


def error_example(flags: DataFrame, kind: str, run: str = "model", order: str = "tweet_id") -> DataFrame:
    """K3: per run, the first (by ``order``) text, prediction and gold among rows of ``kind``."""
    rows = flags.filter(F.col(kind))
    cols = [c for c in ("tweet", "predicted_text", "gold_text") if c in rows.columns]
    picked = rows.groupBy(run).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_e"))
    return picked.select(run, *[F.col("_e")[c].alias(c) for c in cols])

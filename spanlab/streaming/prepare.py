"""Stateless pipeline steps over streaming DataFrames (SURVEY §2.13, "Streaming-only operators").

The reference has no stream, watermark or state. Its per-row steps (cleaning,
prefix, target map, prompt fill, normalisation, submission rows) and the label
join against a static side are stateless, so the same column expressions run
unchanged on a ``readStream`` source; no state store is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import joins

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def text_stream(
    spark: SparkSession,
    directory: str,
    schema: str = DOCUMENT_SCHEMA,
    fmt: str = "parquet",
    glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """A file stream of documents (files of ``directory``, optionally matching ``glob``) as ``(tweet_id, tweet)``."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    s = r.load(directory)
    return s.select(F.col("doc_id").cast("string").alias("tweet_id"), F.col("text").alias("tweet"))


def prepare_stream(
    texts: DataFrame,
    labels: DataFrame,
    emoji_pairs=(),
    prefix: str = T.CLASS_PREFIX,
    targets=T.CLASS_TARGETS,
    default_label: str = T.DEFAULT_CLASS_LABEL,
) -> DataFrame:
    """Prepared rows (B7, B2, B3, B1) for a text stream joined to static labels.

    Labels are reduced to one row per id first (static side), so the stream-static
    left join stays one-to-one; the label side is small or broadcast by AQE.
    """
    lab = joins.first_per_key(labels, "tweet_id", ["label"])
    rows = texts.join(lab, "tweet_id", "left")
    return rows.select(
        "tweet_id",
        "tweet",
        F.lit(prefix).alias("prefix"),
        T.clean_text("tweet", emoji_pairs).alias("input_text"),
        T.map_target(T.fill_label("label", default_label), targets).alias("target_text"),
    )


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> None:
    """Drain a stream into an in-memory table ``name`` (tests and small tools)."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()

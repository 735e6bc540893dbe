"""Stateless steps run unchanged on a file stream."""

import tempfile

from pyspark.sql import functions as F

from spanlab.plans import testviews as V
from spanlab.streaming import prepare as ST


def test_prepare_stream_equals_batch(spark, sf_small):
    texts = ST.text_stream(spark, sf_small, glob="documents.parquet")
    labels = V.class_labels(spark, sf_small)
    stream = ST.prepare_stream(texts, labels, V.EMOJI_TABLE)
    ST.run_to_table(stream, "prepared_stream", tempfile.mkdtemp(prefix="spanlab-stream-"))
    got = sorted(tuple(r) for r in spark.table("prepared_stream").select("tweet_id", "input_text", "target_text").collect())
    batch = V.prepared_class(spark, sf_small).select("tweet_id", "input_text", "target_text")
    assert got == sorted(tuple(r) for r in batch.collect())
    assert len(got) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert F is not None

"""Nulls, missing runs, reordered headers, plan-time jobs: cases outside the driver tables."""

import pytest
from pyspark.sql import functions as F

from spanlab.operators import balance, encode, joins, predict, score
from spanlab.operators import match as MA
from spanlab.plans import testviews as V
from spanlab.sources import io


def test_exact_cuts_keep_null_ids_and_groups(spark):
    rows = [("a", "x"), ("b", "x"), (None, "x"), ("c", None), ("d", None), (None, None), ("a", "x")]
    df = spark.createDataFrame(rows, "tweet_id string, label string")
    split = balance.split_exact(df)
    assert split.count() == 7 and split.filter("split = 'val'").count() == 2
    half = balance.first_half(df, by="label").collect()
    assert len(half) == 7 and sum(r["_first"] for r in half if r["label"] == "x") == 2
    assert balance.undersample(df, "label").count() == 6
    over = balance.oversample(df, "label").groupBy("label").count().collect()
    assert sorted(r["count"] for r in over) == [4, 4]


def test_a_tiny_class_is_drawn_far_up_without_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(balance, "SALT_DRAWS", 100)
    rows = [(f"p{i}", "few") for i in range(3)] + [(f"n{i}", "many") for i in range(5000)]
    df = spark.createDataFrame(rows, "tweet_id string, label string")
    out = balance.oversample(df, "label")
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"few": 5000, "many": 5000}
    assert out.filter("draw IS NOT NULL").select("draw").distinct().count() == 4997
    monkeypatch.setattr(balance, "SALT_DRAWS", 1 << 16)
    same = balance.oversample(df, "label")
    key = F.struct("tweet_id", "draw")
    assert {r[0] for r in out.select(key).collect()} == {r[0] for r in same.select(key).collect()}


def test_encode_keeps_a_row_without_text(spark):
    df = spark.createDataFrame([("a", "p", "x y", "t"), ("b", "p", None, None)], "tweet_id string, prefix string, input_text string, target_text string")
    vocab = encode.vocab_from_corpus(df, "input_text")
    rows = {r["tweet_id"]: r for r in encode.encode_fixed(df, vocab, max_len=5).collect()}
    assert rows["b"]["input_ids"] == [1, 0, 0, 0, 0] and rows["b"]["labels"] == [1, -100, -100, -100, -100]
    assert sorted(r["id"] for r in vocab.collect()) == [3, 4]


def test_span_scores_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "gold_labels string, pred_labels string")
    matches = MA.eval_spans(empty, keep=())
    with pytest.raises(Exception, match="span scores need"):
        score.span_scores(matches).collect()
    rows = score.span_scores(matches, on_empty="null").collect()
    assert [r["precision"] for r in rows] == [None] * 3


def test_csv_columns_are_found_by_header(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("input_text,tweet_id,extra,target_text,prefix,tweet\ntxt,7,e,none,p,\"a\nb\"\n")
    row = io.read_csv(spark, str(path)).first()
    assert (row["tweet_id"], row["input_text"], row["tweet"]) == ("7", "txt", "a\nb")
    with pytest.raises(ValueError, match="predicted_text"):
        io.read_csv(spark, str(path), io.PREDICTION_SCHEMA)


def test_majority_counts_the_runs_that_exist(spark, tmp_path):
    for run, text in (("ner_a", "nausea"), ("ner_b", "none")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "test_predictions.csv").write_text(f"tweet_id,tweet,predicted_text\n1,t,{text}\n")
    from spanlab.operators import ensemble

    present = io.present_runs(spark, str(tmp_path), ["ner_a", "ner_b", "ner_c"])
    assert present == ["ner_a", "ner_b"]
    out = ensemble.run_ensemble(io.read_runs(spark, str(tmp_path), present), present)
    assert sorted(r["predicted_text"] for r in out.collect()) == ["nausea", "none"]


def counting(path):
    """A model factory; the model notes each text that it is asked about in a file."""

    def make():
        def model(texts):
            with open(path, "a") as f:
                f.write("x" * len(texts))
            return ["nausea"] * len(texts)

        return model

    return make


def test_predictions_are_made_once_and_targets_stay(spark, tmp_path):
    path = str(tmp_path / "calls")
    rows = [(str(i), "ner ade", "text", "Yes, the patient suffered from pain.") for i in range(5)]
    df = spark.createDataFrame(rows, "tweet_id string, prefix string, input_text string, target_text string")
    metrics = {name: (lambda d: d.groupBy("target_text").count()) for name in ("one", "two")}
    preds, tables = predict.evaluate_run(df, counting(path), prompt="prompt2", metrics=metrics)
    assert {r["target_text"] for r in preds.collect()} == {"Yes, the patient suffered from pain."}
    assert [r["target_text"] for t in tables.values() for r in t.collect()] == ["pain", "pain"]
    assert len(open(path).read()) == 5


def test_prediction_ships_one_column(spark, sf_small):
    df = predict.predict_batches(V.prepared_class(spark, sf_small), predict.rule_factory())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan


def test_attaching_labels_starts_no_job(spark, sf_small):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    joins.attach_labels(V.texts(spark, sf_small), V.class_labels(spark, sf_small), order=["label"])
    # reading parquet schemas may start a job; the join itself must not
    middle = len(tracker.getJobIdsForGroup(None))
    texts, labels = V.texts(spark, sf_small), V.class_labels(spark, sf_small)
    after = len(tracker.getJobIdsForGroup(None))
    joins.attach_labels(texts, labels, order=["label"])
    assert len(tracker.getJobIdsForGroup(None)) == after and middle >= before

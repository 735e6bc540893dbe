"""End-to-end pipelines on small TSV fixtures."""

import os
import tempfile

from pyspark.sql import functions as F

from spanlab.plans import pipelines as P
from spanlab.sources import io as IO


def _write(d, name, body):
    path = os.path.join(d, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)


def test_prepare_prompt_ensemble_submit(spark):
    root = tempfile.mkdtemp(prefix="spanlab-e2e-")
    task = os.path.join(root, "Task1b")
    tweets = "".join(f"{i}\tI had bad nausea today {i} http://t.co/x\n" for i in range(1, 12))
    _write(task, "train/train_tweets.tsv", tweets)
    _write(task, "train/train_spans.tsv", "1\tADE\t6\t12\tnausea\n1\tADE\t2\t5\tbad\n9\tADE\t0\t4\tnone9\n")
    _write(task, "valid/tweets.tsv", "20\tno pain, pain\n21\tI feel fine\n")
    _write(task, "valid/spans.tsv", "20\tADE\t3\t7\tpain\n")
    out = P.prepare_task(spark, task, "Task1b", os.path.join(root, "prepared"))
    assert out["train"].count() == 8 and out["val"].count() == 3 and out["test"].count() == 2
    test = {r.tweet_id: r.target_text for r in out["test"].collect()}
    assert test == {"20": "pain", "21": "none"}
    first = [r for r in IO.read_csv(spark, os.path.join(root, "prepared", "train.csv")).unionByName(
        IO.read_csv(spark, os.path.join(root, "prepared", "val.csv"))).collect() if r.tweet_id == "1"][0]
    assert first.target_text == "bad" and first.input_text == "I had bad nausea today 1"

    long = P.prompt_task(spark, {"test": os.path.join(root, "prepared", "test.csv")}, os.path.join(root, "prompts"))
    assert long.count() == 6

    runs_dir = os.path.join(root, "predictions")
    preds = IO.read_csv(spark, os.path.join(root, "prepared", "test.csv")).withColumn("predicted_text", F.col("target_text"))
    for run in ("ner_a", "ner_b", "ner_c"):
        IO.write_csv(preds, os.path.join(runs_dir, run, IO.PREDICTIONS_FILE))
    cfg = os.path.join(root, "cfg")
    IO.write_config(spark, cfg, runs_dir, ["ner_a", "ner_b", "ner_c"], "ner_ensemble")
    ens = {r.tweet_id: r.predicted_text for r in P.run_ensemble_config(spark, cfg).collect()}
    assert ens == {"20": "pain", "21": "none"}

    subs = P.submissions(spark, runs_dir, os.path.join(root, "subs"), ["ner_ensemble"])
    rows = [tuple(r) for r in subs["ner_ensemble"].collect()]
    assert rows == [("20", "ADE", "3", "7", "pain")]

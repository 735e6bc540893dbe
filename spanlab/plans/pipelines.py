"""End-to-end pipelines of the reference, as compositions of the operators.

- ``prepare_task``: A2 → D1 → B1 → B7 → B2 → B3 → G1 → A7 (train / val / test CSV)
- ``prompt_task``:  A3 → B8 → A7 (one folder per prompt and split)
- ``ensemble``:     A6 → A4 → B11 → J1 or J3 → D2 → A7
- ``submissions``:  A4 → B14 → A8 (one TSV folder per run)

Paths are arguments (the reference hard-codes several that do not agree). Each
pipeline is one lazy plan per sink; the shuffles are those of its operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import balance, ensemble, joins, prompts, submission
from spanlab.sources import io

PREPARED = ["tweet_id", "tweet", "prefix", "input_text", "target_text"]
# Per task, the prefix, the target map ('span' keeps the label), the
# label order that picks "the first" label row, and the default of a missing label.
TASK_SETTINGS = {
    "task1a": (T.CLASS_PREFIX, T.CLASS_TARGETS, ["label"], T.DEFAULT_CLASS_LABEL),
    "task1b": (T.SPAN_PREFIX, "span", ["begin", "end", "label"], T.NEGATIVE_SPAN),
}


def prepared_rows(texts: DataFrame, labels: DataFrame, task: str, emoji_pairs=()) -> DataFrame:
    """D1 → B1 → B7 → B2 → B3 for one split of a task."""
    prefix, targets, order, default = TASK_SETTINGS[task.lower()]
    rows = joins.attach_labels(texts, labels, order=order)
    return rows.select(
        "tweet_id",
        "tweet",
        F.lit(prefix).alias("prefix"),
        T.clean_text("tweet", emoji_pairs).alias("input_text"),
        T.map_target(T.fill_label("label", default), targets).alias("target_text"),
    )


def prepare_task(spark: SparkSession, data_dir: str, task: str, out_dir: str, emoji_pairs=(), seed: int = 25) -> dict[str, DataFrame]:
    """Read a task directory, prepare both splits, cut 20 % of train into val, write
    ``train.csv``, ``val.csv`` and ``test.csv`` folders; returns the three tables."""
    train_t, train_l, valid_t, valid_l = io.read_splits(spark, data_dir, task)
    train = prepared_rows(train_t, train_l, task, emoji_pairs)
    test = prepared_rows(valid_t, valid_l, task, emoji_pairs)
    split = balance.split_exact(train, "tweet_id", 0.2, seed)
    out = {
        "train": split.filter(F.col("split") == "train").select(*PREPARED),
        "val": split.filter(F.col("split") == "val").select(*PREPARED),
        "test": test.select(*PREPARED),
    }
    base = out_dir.rstrip("/")
    for name, df in out.items():
        io.write_csv(df, f"{base}/{name}.csv", PREPARED)
    return out


def prompt_task(spark: SparkSession, splits: dict[str, str], out_dir: str) -> DataFrame:
    """Apply the three prompt templates to each prepared split and write one folder
    per (prompt, split); returns the long table."""
    parts = [prompts.apply_prompts(io.read_csv(spark, path)).withColumn("split", F.lit(name)) for name, path in splits.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    io.write_csv(long, out_dir, ["prompt", "split", *PREPARED], partition_by=["prompt", "split"])
    return long


def run_ensemble_config(spark: SparkSession, cfg_path: str, out_root: str | None = None, seed: int = 25) -> DataFrame:
    """Config → selected runs → votes or span consensus → text back → CSV in
    ``<input_dir>/<output>`` (or ``out_root/<output>``)."""
    cfg = io.load_ensemble(spark, cfg_path)
    present = io.present_runs(spark, cfg["input_dir"], cfg["predictions"])
    runs = io.read_runs(spark, cfg["input_dir"], present)
    out = ensemble.run_ensemble(runs, present, seed=seed)
    cols = ["tweet_id", "predicted_text", "counts", "tweet"] if "counts" in out.columns else ["tweet_id", "predicted_text", "tweet"]
    target = f"{(out_root or cfg['input_dir']).rstrip('/')}/{cfg['output']}/{io.PREDICTIONS_FILE}"
    io.write_csv(out, target, cols)
    return out


def submissions(spark: SparkSession, predictions_dir: str, out_dir: str, runs: list[str]) -> dict[str, DataFrame]:
    """One submission TSV folder per run folder; the task comes from the run name."""
    out = {}
    for run in runs:  # a handful of run folders, one lazy plan each
        df = io.read_runs(spark, predictions_dir, [run])
        rows = submission.submission_rows(df, T.task_of(run))
        io.write_submission(rows, f"{out_dir.rstrip('/')}/{run}.tsv")
        out[run] = rows
    return out

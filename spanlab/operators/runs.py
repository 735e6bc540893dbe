"""Checkpoint choice over progress logs.

The early-stopping rule is a sequential fold whose state (best value, patience
counter) depends on every earlier evaluation, with a non-monotone threshold when
``delta`` is not 0. It is run as a streaming fold: rows are hash-partitioned by run
and sorted inside the partition, and one ``mapInPandas`` pass walks each run in
order carrying only the fold state, so memory is O(batch), never O(run length).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.session import ship_package

SUMMARY_SCHEMA = "run string, n_evals bigint, best_step bigint, best_value double, stop_step bigint"


def _fold(
    minimize: bool, delta: float, patience: int, use_early_stopping: bool, consider_epochs: bool
):
    def run_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        cur = None
        st = None

        def flush():
            if cur is not None:
                out.append((cur, st["step"], st["best_step"], st["best"], st["stop"]))

        for b in batches:
            runs = b["run"].tolist()
            vals = b["value"].tolist()
            ends = b["is_epoch_end"].tolist()
            for run, v, end in zip(runs, vals, ends):
                if run != cur:
                    flush()
                    cur = run
                    st = {"step": 0, "best": None, "best_step": None, "count": 0, "stop": None}
                if st["stop"] is not None:
                    continue
                st["step"] += 1
                step = st["step"]
                if not st["best"]:  # unset, or exactly 0: this value becomes best (and is saved)
                    st["best"] = v
                    st["best_step"] = step
                if st["best"] and minimize:
                    improved = v - st["best"] < delta
                else:
                    improved = v - st["best"] > delta
                if improved:
                    st["best"] = v
                    st["best_step"] = step
                    st["count"] = 0
                elif use_early_stopping and (consider_epochs or not end):
                    if st["count"] < patience:
                        st["count"] += 1
                    else:
                        st["stop"] = step
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=["run", "n_evals", "best_step", "best_value", "stop_step"])
                out.clear()
        flush()
        if out:
            yield pd.DataFrame(out, columns=["run", "n_evals", "best_step", "best_value", "stop_step"])

    return run_fold


def best_checkpoint(
    log: DataFrame,
    metric: str = "eval_loss",
    order=("ts", "event_id"),
    run: str = "run",
    epoch_col: str | None = "is_epoch_end",
    minimize: bool = True,
    delta: float = 0.0,
    patience: int = 3,
    use_early_stopping: bool = True,
    consider_epochs: bool = False,
) -> DataFrame:
    """M1: per run, evaluations read before stopping, the best (saved) step and value,
    and the step at which early stopping ends the run (null if it never does).

    Quirks kept: the first value becomes best and is then compared with itself (at
    delta 0 it counts as non-improving); a best of exactly 0 is replaced by the next
    value and switches the comparison to the maximising form; end-of-epoch
    evaluations count toward patience only with ``consider_epochs``.
    """
    ship_package(log.sparkSession)
    ordered = log.select(
        F.col(run).alias("run"),
        *[F.col(c) for c in order],
        F.col(metric).cast("double").alias("value"),
        F.coalesce((F.col(epoch_col) if epoch_col else F.lit(False)).cast("boolean"), F.lit(False)).alias("is_epoch_end"),
    ).filter(F.col("run").isNotNull())
    ordered = ordered.repartition("run").sortWithinPartitions("run", *order)
    fold = _fold(minimize, float(delta), int(patience), bool(use_early_stopping), bool(consider_epochs))
    return ordered.select("run", "value", "is_epoch_end").mapInPandas(fold, SUMMARY_SCHEMA)

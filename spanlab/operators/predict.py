"""Batch prediction with a pluggable model, and run evaluation.

The model is a plug-in: a picklable factory that returns a callable
``list[str] -> list[str]`` (or ``list[list[str]]`` for k outputs per input). The
factory is called once per task; inputs reach it as Arrow batches cut into
sub-batches of ``batch_size``. Nothing is collected to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from spanlab.functions import text as T
from spanlab.operators import match as MA
from spanlab.operators import prompts as PR
from spanlab.operators import score as SC
from spanlab.session import materialize, ship_package

Predictor = Callable[[list[str]], list]


def predict_batches(
    df: DataFrame,
    predictor_factory: Callable[[], Predictor],
    batch_size: int = 8,
    k: int = 1,
    source=None,
    out: str = "predicted_text",
) -> DataFrame:
    """L1: add ``out`` (string, or array<string> when ``k > 1``) from the model input B9.

    Only the model input goes to Python, in Arrow batches; the other columns stay in the
    JVM. Each task makes its model once.
    """
    ship_package(df.sparkSession)
    src = source if source is not None else T.model_input("prefix", "input_text")
    out_type = StringType() if k == 1 else ArrayType(StringType())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = predictor_factory()
        for b in batches:
            texts = b.tolist()
            preds: list = []
            for i in range(0, len(texts), batch_size):
                preds.extend(model(texts[i : i + batch_size]))
            yield pd.Series(preds, dtype=object)

    # a model may be random: its calls are neither repeated nor moved by the optimizer
    predict = pandas_udf(run, out_type).asNondeterministic()
    return df.withColumn(out, predict(src))


class RulePredictor:
    """A deterministic stand-in model for tests and benches.

    ``task='classification'``: ``adverse event problem`` when the md5 of the input
    starts with 0–3, else ``healthy okay``. ``task='prompt'``: the positive answer
    of the prompt template when the md5 starts with 0–7, with three words of the text
    (without prefix and template) at a place that the md5 names, else the negative
    sentence.
    """

    def __init__(self, task: str = "classification", prompt: str = "prompt2"):
        self.task = task
        self.prompt = next(p for p in PR.PROMPTS if p["prompt"] == prompt)
        before, _, after = self.prompt["input_tpl"].partition(PR.SLOT)
        self.before, self.after = f"{T.SPAN_PREFIX}: {before}", after

    def __call__(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            h = hashlib.md5(t.encode("utf-8")).hexdigest()
            if self.task == "classification":
                out.append(T.POSITIVE_CLASS_TEXT if h[0] in "0123" else T.NEGATIVE_CLASS_TEXT)
            else:
                words = t.removeprefix(self.before).removesuffix(self.after).split(" ")
                at = int(h[1:9], 16) % max(1, len(words) - 2)
                if h[0] in "01234567":
                    out.append(self.prompt["pos_tpl"].replace(PR.SLOT, " ".join(words[at : at + 3])))
                else:
                    out.append(self.prompt["neg_tpl"])
        return out


def evaluate_run(
    df: DataFrame,
    predictor_factory: Callable[[], Predictor],
    prompt: str | None = None,
    metrics: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    batch_size: int = 8,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """L3: predict (L1) once, then unwrap prompt answers (B10) for prompts 1–3 and take the
    named metrics (L2). Returns the prediction table (the input rows as they were plus
    ``predicted_text``) and the metric tables.

    The predictions are written once in the shared checkpoint folder, so every metric
    scores those that were returned. Metrics see ``target_text`` and ``predicted_text``
    unwrapped, the prediction table keeps ``target_text`` as it came."""
    preds = predict_batches(df, predictor_factory, batch_size)
    scored_target = F.col("target_text")
    if prompt in {p["prompt"] for p in PR.PROMPTS}:
        marker = next(p["marker"] for p in PR.PROMPTS if p["prompt"] == prompt)
        preds = preds.withColumn("predicted_text", T.unwrap_prompt("predicted_text", marker))
        scored_target = T.unwrap_prompt("target_text", marker)
    preds = materialize(preds)
    if metrics is None:
        metrics = {
            "span_scores": lambda d: SC.span_scores(
                MA.eval_spans(MA.gold_pred_table(d), "gold_labels", "pred_labels"), on_empty="null"
            )
        }
    return preds, SC.with_metrics(preds.withColumn("target_text", scored_target), **metrics)


def rule_factory(task: str = "classification", prompt: str = "prompt2") -> Callable[[], Predictor]:
    def make() -> Predictor:
        return RulePredictor(task, prompt)

    return make

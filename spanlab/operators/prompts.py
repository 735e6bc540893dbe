"""Prompt templates.

The templates are a three-row table joined to every row by a broadcast of a
literal (a bounded side), so a corpus becomes one long table with a ``prompt``
column; writing it with ``partitionBy('prompt')`` gives one folder per prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import text as T

# The three prompt templates (``{}`` marks the slot) and the marker
# sentence of each positive answer.
PROMPTS = [
    {
        "prompt": "prompt1",
        "input_tpl": "Is there a negative drug effect in: {}",
        "neg_tpl": "There isn't a negative drug effect.",
        "pos_tpl": "{} is a negative drug effect.",
        "marker": " is a negative drug effect",
    },
    {
        "prompt": "prompt2",
        "input_tpl": "Did the patient suffer from a side effect? {}",
        "neg_tpl": "No, the patient didn’t suffer from a side effect.",
        "pos_tpl": "Yes, the patient suffered from {}.",
        "marker": "Yes, the patient suffered from ",
    },
    {
        "prompt": "prompt3",
        "input_tpl": "{} Did the patient suffer from a side effect?",
        "neg_tpl": "No, the patient didn’t suffer from a side effect.",
        "pos_tpl": "Yes, the patient suffered from {}.",
        "marker": "Yes, the patient suffered from ",
    },
]
SLOT = "{}"


def _fill(tpl, value):
    """Python ``tpl.format(value)`` for a one-slot template: the slot only, one pass."""
    return F.replace(tpl, F.lit(SLOT), value)


def apply_prompts(df: DataFrame, prompts=None, prefix: str = T.SPAN_PREFIX) -> DataFrame:
    """Every row once per prompt: input filled into the template; target = negative
    sentence for ``none``, else the positive template filled with the span.

    The prompts are a literal array exploded per row (no join needed); the prompt
    count is fixed, so the output grows with the input only.
    """
    rows = prompts or PROMPTS
    tpl = F.explode(
        F.array(*[F.struct(*[F.lit(p[k]).alias(k) for k in ("prompt", "input_tpl", "neg_tpl", "pos_tpl")]) for p in rows])
    )
    x = df.withColumn("_tpl", tpl)
    target = F.when(F.col("target_text") == F.lit(T.NEGATIVE_SPAN), F.col("_tpl.neg_tpl")).otherwise(
        _fill(F.col("_tpl.pos_tpl"), F.col("target_text"))
    )
    return x.select(
        F.col("_tpl.prompt").alias("prompt"),
        *[c for c in df.columns if c not in ("prefix", "input_text", "target_text")],
        F.lit(prefix).alias("prefix"),
        _fill(F.col("_tpl.input_tpl"), F.col("input_text")).alias("input_text"),
        target.alias("target_text"),
    )


def marker_of(prompt_col: str = "prompt", prompts=None):
    """The marker sentence of a prompt name (a CASE over the fixed prompt list)."""
    rows = prompts or PROMPTS
    expr = None
    for p in rows:
        cond = F.col(prompt_col) == F.lit(p["prompt"])
        expr = F.when(cond, F.lit(p["marker"])) if expr is None else expr.when(cond, F.lit(p["marker"]))
    return expr


def unwrap(df: DataFrame, cols=("target_text",), prompt_col: str = "prompt", prompts=None) -> DataFrame:
    """B10 over a table with a ``prompt`` column; rows of other prompts keep their text."""
    marker = marker_of(prompt_col, prompts)
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(marker.isNotNull(), T.unwrap_prompt(c, marker)).otherwise(F.col(c)))
    return out

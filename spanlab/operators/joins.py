"""Joins of the pipeline.

All are equi-joins on an id or a text; the planner picks broadcast or
sort-merge at run time (AQE measures the shuffled side first). Labels are reduced
to one row per id *before* the join, so the join stays one-to-one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions.text import SPAN_SEPARATOR


def first_per_key(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The first row per key in ``order`` (then by the remaining columns), one row per key.

    ``min_by`` over a struct is a partial aggregate: duplicates collapse before the
    shuffle, so a key holding many rows costs no more than its partial results.
    """
    cols = [c for c in (cols or df.columns) if c != key]
    order_key = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in cols if c not in order])
    picked = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order_key).alias("_first"))
    return picked.select(key, *[F.col("_first")[c].alias(c) for c in cols])


def dedupe_by_key(df: DataFrame, key: str, col: str) -> DataFrame:
    """One row per ``key`` with the smallest ``col`` (a partial aggregate; the join on the
    same key that follows needs no further shuffle)."""
    return df.groupBy(key).agg(F.min(col).alias(col))


def attach_labels(
    texts: DataFrame,
    labels: DataFrame,
    key: str = "tweet_id",
    order: Sequence[str] = ("label",),
    policy: str = "first",
    text_col: str = "tweet",
    label_col: str = "label",
) -> DataFrame:
    """Left join of labels on texts, one row per text id.

    ``policy='first'`` keeps the first label row per id in ``order`` (the reference
    keeps the first in file order); ``policy='join'`` joins all label texts of an id
    with ``'; '`` in ``order``, the form the span scorer reads. Labels without a
    text vanish; duplicate text ids keep their smallest text.
    """
    labels = labels.filter(F.col(key).isNotNull())
    if policy == "first":
        lab = first_per_key(labels, key, list(order))
    elif policy in ("join", "both"):
        # ``both``: the first label (``label``) and all labels joined (``label_joined``)
        # from one aggregation, so one attachment serves both forms.
        rest = [c for c in labels.columns if c != key and c not in order]
        parts = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest], F.col(label_col).alias("_l"))))
        joined = F.array_join(F.transform(F.col("_parts"), lambda x: x["_l"]), SPAN_SEPARATOR)
        lab = labels.groupBy(key).agg(parts.alias("_parts"))
        if policy == "join":
            lab = lab.select(key, joined.alias(label_col))
        else:
            lab = lab.select(key, F.element_at("_parts", 1)["_l"].alias(label_col), joined.alias(f"{label_col}_joined"))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    uniq = dedupe_by_key(texts.filter(F.col(key).isNotNull()), key, text_col)
    return uniq.join(lab, key, "left")


def attach_text(
    votes: DataFrame, runs: DataFrame, key: str = "tweet_id", text_col: str = "tweet", first_run: str | None = None
) -> DataFrame:
    """Bring the text back from "run 0" (the lowest run name); duplicates there fan out.

    With ``first_run`` (known from a listing or a config) the run is a literal filter,
    which prunes the other runs' files; else the lowest name is looked up.
    """
    lowest = F.lit(first_run) if first_run is not None else runs.agg(F.min("run")).scalar()
    run0 = runs.filter(F.col("run") == lowest).select(key, text_col)
    return votes.join(run0, key, "left")


def attach_gold(
    preds: DataFrame, gold: DataFrame, key: str = "tweet_id", gold_col: str = "target_text", out: str = "gold_text"
) -> DataFrame:
    """D3: left join of the gold column on the id, renamed so it does not clash."""
    return preds.join(gold.select(key, F.col(gold_col).alias(out)), key, "left")


def without_majority(counts: DataFrame, majority: DataFrame | None = None, key: str = "tweet_id", n_runs: int | None = None) -> DataFrame:
    """Rows of ``counts`` whose id has no majority row.

    With a ``majority`` table: an anti join on its distinct ids. With ``n_runs``: an id
    has a majority row exactly when ``2 · max(counts) >= n_runs`` over its rows, so a
    window partitioned by id answers it in one pass over ``counts`` (no self-join
    that would compute the counts twice).
    """
    if majority is not None:
        return counts.join(majority.select(key).distinct(), key, "left_anti")
    if n_runs is None:
        raise ValueError("pass the majority table or n_runs")
    from pyspark.sql import Window

    top = F.max("counts").over(Window.partitionBy(key))
    return counts.withColumn("_top", top).filter(F.col("_top") * 2 < F.lit(int(n_runs))).drop("_top")


def drop_known(new: DataFrame, existing: DataFrame, new_col: str = "input_text", existing_col: str = "input_text") -> DataFrame:
    """Reject rows whose text equals an existing text (hash anti join on the text)."""
    known = existing.select(F.col(existing_col).alias("_known")).distinct()
    return new.join(known, new[new_col] == known["_known"], "left_anti")

"""Scores: span scores, classification report, pluggable metrics.

Each score reduces a per-row table to a handful of rows with partial aggregation,
so the shuffle carries one partial row per task and group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import similarity as S

LEVELS = ("partial", "exact", "strict")


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def span_scores(matches: DataFrame, by: Sequence[str] | str | None = None, on_empty: str = "error") -> DataFrame:
    """Per level, counts of COR / INC / PAR / MIS / SPU, then precision, recall, F1.

    POS = cor+inc+par+mis, ACT = cor+inc+par+spu; on the partial level a PAR counts
    half. POS = 0 or ACT = 0 raises (``on_empty='error'``, as the reference) or gives
    null metrics (``on_empty='null'``). F1 is 0 when P + R = 0 (the reference divides
    by zero there).
    """
    by = _by(by)
    # one aggregation for all levels; without groups an empty table still gives its row
    names = {"correct": S.COR, "incorrect": S.INC, "partial": S.PAR, "missed": S.MIS, "spurius": S.SPU}
    totals = matches.groupBy(*by).agg(
        *[F.count_if(F.col(lv) == code).alias(f"_{lv}_{name}") for lv in LEVELS for name, code in names.items()]
    )
    levels = F.array(
        *[F.struct(F.lit(lv).alias("level"), *[F.col(f"_{lv}_{name}").alias(name) for name in names]) for lv in LEVELS]
    )
    counts = totals.select(*by, F.inline(levels))
    pos = F.col("correct") + F.col("incorrect") + F.col("partial") + F.col("missed")
    act = F.col("correct") + F.col("incorrect") + F.col("partial") + F.col("spurius")
    hit = F.when(F.col("level") == "partial", F.col("correct") + F.lit(0.5) * F.col("partial")).otherwise(
        F.col("correct").cast("double")
    )
    empty = (pos == 0) | (act == 0)
    if on_empty == "error":
        guard = lambda c: F.when(empty, F.raise_error(F.lit("span scores need at least one gold and one predicted span"))).otherwise(c)
    elif on_empty == "null":
        guard = lambda c: F.when(empty, F.lit(None).cast("double")).otherwise(c)
    else:
        raise ValueError(on_empty)
    p = guard(hit / act).alias("precision")
    r = guard(hit / pos).alias("recall")
    out = counts.select("*", p, r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * ((F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall")))
    )
    return out.withColumn("f1_score", f1)


def classification_report(
    df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] | str | None = None
) -> DataFrame:
    """Per class precision, recall, F1 and support; accuracy; macro and weighted averages.

    Classes are those seen as label or prediction; zero divisions give 0. The
    accuracy row holds the accuracy in ``f1_score`` and the row count in ``support``,
    as the printed report does. Rows: ``(class, precision, recall, f1_score, support)``.
    """
    by = _by(by)
    conf = df.groupBy(*by, F.col(label).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    roles = F.explode(
        F.array(
            F.struct(F.col("_t").alias("c"), F.col("_n").alias("t"), F.lit(0).cast("bigint").alias("p"),
                     F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("tp")),
            F.struct(F.col("_p").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("_n").alias("p"),
                     F.lit(0).cast("bigint").alias("tp")),
        )
    )
    per = (
        conf.select(*by, roles.alias("_r"))
        .select(*by, "_r.*")
        .filter(F.col("c").isNotNull())
        .groupBy(*by, "c")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("npred"), F.sum("tp").alias("tp"))
    )
    prec = F.when(F.col("npred") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("npred"))
    rec = F.when(F.col("support") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("support"))
    per = per.select(*by, F.col("c").alias("class"), prec.alias("precision"), rec.alias("recall"), "support", "tp")
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        (F.lit(2.0) * F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall"))
    )
    per = per.withColumn("f1_score", f1)
    # Group totals (one row per group) and the class rows come from the same per-class
    # table; the summary rows are a second, tiny aggregation of it.
    tot = per.groupBy(*by).agg(
        F.sum("tp").alias("_tp"), F.sum("support").alias("_n"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1_score").alias("_mf"),
        F.sum(F.col("precision") * F.col("support")).alias("_wp"),
        F.sum(F.col("recall") * F.col("support")).alias("_wr"),
        F.sum(F.col("f1_score") * F.col("support")).alias("_wf"),
    )

    def row(cls, p, r, f, sup):
        return F.struct(cls.alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"), sup.alias("support"))

    null = F.lit(None).cast("double")
    summary = F.array(
        row(F.lit("accuracy"), null, null, F.col("_tp") / F.col("_n"), F.col("_n")),
        row(F.lit("macro avg"), F.col("_mp"), F.col("_mr"), F.col("_mf"), F.col("_n")),
        row(F.lit("weighted avg"), F.col("_wp") / F.col("_n"), F.col("_wr") / F.col("_n"), F.col("_wf") / F.col("_n"), F.col("_n")),
    )
    own = per.select(*by, "class", "precision", "recall", "f1_score", "support")
    return own.unionByName(tot.filter(F.col("_n").isNotNull()).select(*by, F.inline(summary)))


def with_metrics(df: DataFrame, **metrics: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """L2: named metrics over a (label, prediction) table; each metric is ``DataFrame -> DataFrame``."""
    return {name: fn(df) for name, fn in metrics.items()}


def scores_long(scores: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    """A9 over span scores: ``<level>_<measure>`` keys."""
    by = _by(by)
    measures = ["correct", "incorrect", "partial", "missed", "spurius", "precision", "recall", "f1_score"]
    pairs = F.explode(
        F.array(*[F.struct(F.concat(F.col("level"), F.lit("_" + m)).alias("metric"), F.col(m).cast("double").alias("value")) for m in measures])
    )
    return scores.select(*by, pairs.alias("_m")).select(*by, "_m.metric", "_m.value")

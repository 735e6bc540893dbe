"""Span matching and evaluation.

Gold and predicted spans of one text are a few phrases, so each text is matched
inside its own row: the gold × prediction pairs (D7) are scored, sorted by
(−similarity, gold index, prediction index) and folded greedily one-to-one, then
the match rows are exploded. No shuffle is needed for matching.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import similarity as S
from spanlab.functions import text as T

_MATCH_TYPE = "array<struct<gold:string,pred:string,partial:string,exact:string,strict:string>>"


def gold_pred_pairs_sql(g: str, p: str) -> str:
    """All (gold, prediction) index pairs of a row with their similarity key.

    The match masks of a prediction are made once and meet every gold span.
    """
    sim = S.similarity_sql("_gt", "_pt.t", "_pt.m")
    preds = f"transform({p}, _pp -> named_struct('t', _pp, 'm', IF(length(_pp) > 0, {S.masks_sql('_pp')}, NULL)))"
    return (
        f"IF(size({g}) = 0 OR size({p}) = 0, CAST(array() AS array<struct<ns:int,gi:int,pj:int>>), "
        f"transform(array({preds}), _pa -> flatten(transform({g}, (_gt, _gi) -> transform(_pa, "
        f"(_pt, _pj) -> named_struct('ns', -{sim}, 'gi', _gi, 'pj', _pj)))))[0])"
    )


def _used_sql(words: str, k: str) -> str:
    """Whether bit ``k`` of a bit vector is set."""
    return f"(shiftright(element_at({words}, CAST({k} DIV {S.BITS} AS INT) + 1), {k} % {S.BITS}) & 1L) = 1L"


def _use_sql(words: str, k: str) -> str:
    """The bit vector with bit ``k`` set."""
    return (
        f"transform({words}, (_uw, _ui) -> IF(_ui = CAST({k} DIV {S.BITS} AS INT), "
        f"_uw | shiftleft(1L, {k} % {S.BITS}), _uw))"
    )


def _greedy_sql(g: str, p: str) -> str:
    """I3 fold: take pairs in sorted order while neither side is used.

    Used sides are bits, so a pair that is passed over costs two look-ups whatever the sizes.
    """

    def none_used(x: str) -> str:
        return f"array_repeat(0L, CAST(size({x}) DIV {S.BITS} AS INT) + 1)"

    return (
        f"aggregate(array_sort({gold_pred_pairs_sql(g, p)}), "
        f"named_struct('ug', {none_used(g)}, 'up', {none_used(p)}, "
        f"'m', CAST(array() AS array<struct<gi:int,pj:int>>)), "
        f"(_acc, _x) -> IF({_used_sql('_acc.ug', '_x.gi')} OR {_used_sql('_acc.up', '_x.pj')}, _acc, "
        f"named_struct('ug', {_use_sql('_acc.ug', '_x.gi')}, 'up', {_use_sql('_acc.up', '_x.pj')}, "
        f"'m', concat(_acc.m, array(named_struct('gi', _x.gi, 'pj', _x.pj))))))"
    )


def _row(gold: str, pred: str, partial: str, exact: str) -> str:
    return f"named_struct('gold', {gold}, 'pred', {pred}, 'partial', {partial}, 'exact', {exact}, 'strict', {exact})"


def match_rows_sql(g: str, p: str, fold: str) -> str:
    """I3 rows: matched pairs with their status, then leftover gold (MIS) and predictions (SPU)."""
    ge, pe = "element_at(" + g + ", _q.gi + 1)", "element_at(" + p + ", _q.pj + 1)"
    matched = f"transform({fold}.m, _q -> {_row(ge, pe, S.partial_status_sql(ge, pe), S.exact_status_sql(ge, pe))})"
    left_g = (
        f"transform(filter(sequence(0, size({g}) - 1), _k -> NOT {_used_sql(fold + '.ug', '_k')}), "
        f"_k -> {_row(f'element_at({g}, _k + 1)', repr(T.NEGATIVE_SPAN), repr(S.MIS), repr(S.MIS))})"
    )
    left_p = (
        f"transform(filter(sequence(0, size({p}) - 1), _k -> NOT {_used_sql(fold + '.up', '_k')}), "
        f"_k -> {_row(repr(T.NEGATIVE_SPAN), f'element_at({p}, _k + 1)', repr(S.SPU), repr(S.SPU))})"
    )
    return f"concat({matched}, {left_g}, {left_p})"


def eval_spans(df: DataFrame, gold: str = "gold_labels", pred: str = "pred_labels", keep=("tweet_id",)) -> DataFrame:
    """I4: one output row per match (columns ``gold, pred, partial, exact, strict``).

    Per text: no gold and no prediction → one COR row; gold only → one MIS row for
    the whole text; prediction only → one SPU row; both → greedy matching (I3).
    Texts are lower-cased and null counts as ``none``.
    """
    keep = [c for c in keep if c in df.columns]
    low_g = F.coalesce(F.lower(F.col(gold)), F.lit(T.NEGATIVE_SPAN))
    low_p = F.coalesce(F.lower(F.col(pred)), F.lit(T.NEGATIVE_SPAN))
    x = df.select(
        *keep,
        low_g.alias("_g"),
        low_p.alias("_p"),
        T.split_spans(gold).alias("_gs"),
        T.split_spans(pred).alias("_ps"),
    )
    both = (F.size("_gs") > 0) & (F.size("_ps") > 0)
    x = x.withColumn("_fold", F.when(both, F.expr(_greedy_sql("_gs", "_ps"))))
    single = lambda status: F.array(
        F.struct(
            F.col("_g").alias("gold"),
            F.col("_p").alias("pred"),
            F.lit(status).alias("partial"),
            F.lit(status).alias("exact"),
            F.lit(status).alias("strict"),
        )
    )
    rows = (
        F.when((F.size("_gs") == 0) & (F.size("_ps") == 0), single(S.COR))
        .when(F.size("_ps") == 0, single(S.MIS))
        .when(F.size("_gs") == 0, single(S.SPU))
        .otherwise(F.expr(match_rows_sql("_gs", "_ps", "_fold")))
    )
    return x.select(*keep, F.inline(rows.cast(_MATCH_TYPE)))


def gold_pred_table(df: DataFrame, gold: str = "target_text", pred: str = "predicted_text", keep=("tweet_id",)) -> DataFrame:
    """The (gold_labels, pred_labels) table the scorer reads; one table, so lengths agree."""
    keep = [c for c in keep if c in df.columns]
    return df.select(*keep, F.col(gold).alias("gold_labels"), F.col(pred).alias("pred_labels"))

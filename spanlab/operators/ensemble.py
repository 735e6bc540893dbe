"""Votes and span consensus over many runs.

Plan shape: runs → partial count per (id, text) → shuffle by (id, text) → final
count → partial top-1 / candidate list per id → shuffle by id. Per id the rows are
at most one per run and distinct text, so every per-id list is bounded by the
number of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import similarity as S
from spanlab.functions import text as T
from spanlab.operators import joins

ID, TEXT = "tweet_id", "predicted_text"


def normalise_runs(runs: DataFrame, col: str = TEXT, lower: bool = True) -> DataFrame:
    """B11 over a run table."""
    return runs.withColumn(col, T.normalise_prediction(col, lower))


def vote_counts(runs: DataFrame, key: str = ID, col: str = TEXT) -> DataFrame:
    """Rows per (id, text) over all runs; null keys drop out as a pandas group-by does."""
    return (
        runs.filter(F.col(key).isNotNull() & F.col(col).isNotNull())
        .groupBy(key, col)
        .agg(F.count(F.lit(1)).alias("counts"))
    )


def majority_texts(counts: DataFrame, n_runs: int) -> DataFrame:
    """E2 + C5: texts with ``counts >= n_runs / 2`` (inclusive, integer form)."""
    return counts.filter(F.col("counts") * 2 >= F.lit(int(n_runs)))


def candidate_spans(counts: DataFrame, key: str = ID, col: str = TEXT) -> DataFrame:
    """Sorted list of distinct non-``none`` texts per id."""
    return (
        counts.filter(T.has_span(col))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(col)).alias("all_spans"))
    )


def majority_vote(runs: DataFrame, key: str = ID, col: str = TEXT) -> DataFrame:
    """Most frequent text per id with its count; ties → the smallest text."""
    counts = vote_counts(runs, key, col)
    best = counts.groupBy(key).agg(
        F.min_by(F.struct(F.col(col), F.col("counts")), F.struct(-F.col("counts"), F.col(col))).alias("_b")
    )
    return best.select(key, F.col("_b")[col].alias(col), F.col("_b.counts").alias("counts"))


def span_pairs_sql(spans: str) -> str:
    """Unordered pairs (i < j) of an array column, in combination order."""
    return (
        f"IF(size({spans}) < 2, array(), flatten(transform(sequence(0, size({spans}) - 2), "
        f"_pi -> transform(sequence(_pi + 1, size({spans}) - 1), "
        f"_pj -> named_struct('a', element_at({spans}, _pi + 1), 'b', element_at({spans}, _pj + 1), 'o', _pi * size({spans}) + _pj)))))"
    )


def common_span(spans_df: DataFrame, spans: str = "all_spans", key: str = ID, seed: int = 25, out: str = TEXT) -> DataFrame:
    """J2, ``mode='longest'``: consensus span of a candidate list.

    For each pair, the longest common block (case-insensitive, cut from the first
    span) counts if it has at least 5 characters. The block contained (case-
    sensitively) in most spans wins; ties go to the earliest pair. With no block,
    the span with the lowest ``md5(seed:id:span)`` wins (the reference draws at
    random), so a lone candidate wins.
    """
    pairs = F.expr(span_pairs_sql(f"`{spans}`"))
    df = spans_df.withColumn("_pairs", pairs)
    df = df.withColumn(
        "_blocks",
        F.expr(
            "filter(transform(_pairs, _q -> named_struct('m', "
            + S.common_block_sql("_q.a", "_q.b")
            + ", 'o', _q.o)), _q -> length(_q.m) >= "
            + str(S.MIN_COMMON_BLOCK)
            + ")"
        ),
    )
    df = df.withColumn(
        "_scored",
        F.expr(f"transform(_blocks, _q -> named_struct('c', size(filter(`{spans}`, _s -> contains(_s, _q.m))), 'o', _q.o, 'm', _q.m))"),
    )
    # Highest count, then earliest pair: sort by (-count, order).
    best = F.expr("element_at(array_sort(transform(_scored, _q -> named_struct('nc', -_q.c, 'o', _q.o, 'm', _q.m))), 1).m")
    fallback = F.expr(
        f"element_at(array_sort(transform(`{spans}`, _s -> named_struct('h', md5(concat('{seed}', ':', `{key}`, ':', _s)), 's', _s))), 1).s"
    )
    res = df.withColumn(out, F.when(F.size("_blocks") > 0, best).otherwise(fallback))
    return res.drop("_pairs", "_blocks", "_scored")


def span_ensemble(runs: DataFrame, n_runs: int, key: str = ID, col: str = TEXT, seed: int = 25) -> DataFrame:
    """Majority rows (``none`` too, several per id on ties) ∪ consensus of the
    non-``none`` spans of ids without a majority. Ids with neither vanish.

    One shuffle by (id, text) for the counts and one by id for the rest: majority
    texts and candidate list come from the same per-id aggregation, and the
    consensus is computed only for ids without a majority, so the result is one
    ``explode`` over one pass (no union that would run the upstream twice).
    """
    counts = vote_counts(runs, key, col)
    maj = F.col("counts") * 2 >= F.lit(int(n_runs))
    per_id = counts.groupBy(key).agg(
        F.collect_list(F.when(maj, F.col(col))).alias("_maj"),
        F.sort_array(F.collect_list(F.when(T.has_span(col), F.col(col)))).alias("_all"),
    )
    need = (F.size("_maj") == 0) & (F.size("_all") > 0)
    x = per_id.withColumn("all_spans", F.when(need, F.col("_all")))
    x = common_span(x, "all_spans", key, seed, "_cons")
    texts = (
        F.when(F.size("_maj") > 0, F.col("_maj"))
        .when(F.col("_cons").isNotNull(), F.array(F.col("_cons")))
        .otherwise(F.array().cast("array<string>"))
    )
    return x.select(key, F.explode(texts).alias(col))


def run_ensemble(runs: DataFrame, runs_selected: list[str] | None = None, seed: int = 25) -> DataFrame:
    """Runs (already read) → B11 → J1 or J3 by task → D2.

    ``runs_selected`` are the runs that take part; their number sets the majority, so
    pass the configured runs that exist (``sources.io.present_runs``), as the reference
    counts the folders it finds. The task comes from the run names; a mix of
    classification and extraction runs raises (the reference silently takes the last
    folder's task).
    """
    if not runs_selected:
        raise ValueError("pass the run names (see sources.io.load_ensemble and present_runs)")
    tasks = {T.task_of(r) for r in runs_selected}
    if len(tasks) > 1:
        raise ValueError("runs mix classification and extraction")
    runs = runs.filter(F.col("run").isin(list(runs_selected)))
    norm = normalise_runs(runs)
    if tasks == {T.CLASSIFICATION}:
        out = majority_vote(norm)
    else:
        out = span_ensemble(norm, len(set(runs_selected)), seed=seed)
    return joins.attach_text(out, runs, first_run=min(runs_selected))

"""Exact rank cuts and dense numbering without a global window.

A ``Window.orderBy`` with no partition pulls every row into one task. Here the order is a
hex key (``md5`` of a seed and the row id) plus tie-break columns.

*Cuts* (the first k rows of a group) are found by distributed selection:

1. one pass over the input writes the narrow table of (group, key, tie-break);
2. a histogram of key prefixes (``BUCKET_DIGITS`` hex digits, partial aggregation) and a
   running sum over it give each group the prefix that holds its k-th row; while more than
   ``RANK_ROWS`` rows share it, the histogram is refined by ``BUCKET_DIGITS`` more digits of
   those rows alone;
3. the rows of that one prefix are ranked, which gives one exact *bound* (key, tie-break)
   per group;
4. one filter pass over the input compares each row with its group's bound. Without groups
   the bound is a literal; with groups it is joined from a written table of one row per
   group, whose known size decides how. Rows are not shuffled for the cut.

When rows that are alike in key and tie-break straddle the cut, those rows alone are
numbered, so the size stays exact.

*Dense numbering* needs every row's rank: a count table per (group, bucket) with a running
sum gives each bucket's offset, and rows are ranked inside their bucket.

The answers equal ``row_number() over (partition by group order by key, tie-break)`` for
any partitioning, which is also the oracle's formulation. No row is lost: a null key stands
after all others (``LAST_KEY``), nulls of a tie-break column come first, and groups are
matched null-safe.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.session import remove_path, write_once

BUCKET_DIGITS = 4
RANK_ROWS = 1 << 20  # rows of one prefix that are ranked without another histogram
LAST_KEY = "~"  # sorts after every hex digit


def _cols(xs) -> list[str]:
    if xs is None:
        return []
    if isinstance(xs, str):
        return [xs]
    return list(xs)


def _same(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """Join on the group columns (null groups match) and, if both have it, the bucket."""
    keys = [*by, "_xb"] if "_xb" in left.columns and "_xb" in right.columns else by
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in keys])


def _bucket_table(keyed: DataFrame, by: list[str]) -> DataFrame:
    counts = keyed.groupBy(*by, "_xb").agg(F.count(F.lit(1)).alias("_xn"))
    w = Window.partitionBy(*by).orderBy("_xb").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_xbefore", F.coalesce(F.sum("_xn").over(w), F.lit(0)).cast("bigint"))


def _bounds(df: DataFrame, key: Column, k, by: list[str], tiebreak: list[str]) -> DataFrame:
    """One row per group that the cut divides or holds whole: the group's columns ``_g*``,
    ``_bound`` (key and tie-break of its k-th row; null: the whole group), and of the rows
    equal to the bound the number that is taken and the number there is (``_need``, ``_have``)."""
    spark = df.sparkSession
    g, t = [f"_g{i}" for i in range(len(by))], [f"_t{i}" for i in range(len(tiebreak))]
    narrow = df.select(
        *[F.col(c).alias(n) for c, n in zip(by, g)],
        F.coalesce(key, F.lit(LAST_KEY)).alias("_key"),
        *[F.col(c).alias(n) for c, n in zip(tiebreak, t)],
    )
    keys, path = write_once(narrow, "cut-keys")
    made = [path]
    try:
        digits, inside = BUCKET_DIGITS, None  # inside: the prefix of each group that is refined
        while True:
            at = F.substring("_key", 1, digits)
            rows = keys.withColumn("_b", at)
            if inside is not None:
                rows = _within(rows, inside, g, digits - BUCKET_DIGITS)
            carried = ["_left"] if inside is not None else []
            hist = rows.groupBy(*g, "_b", *carried).agg(F.count(F.lit(1)).alias("_n"))
            group = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
            before = F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
            table = hist.withColumn("_before", F.coalesce(before, F.lit(0)))
            if inside is None:
                totals = hist.groupBy(*g).agg(F.sum("_n").alias("_total"))
                table = _with_k(table, totals, k, by, g)
            crosses = (F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_n"))
            whole = F.col("_left") >= F.col("_total") if inside is None else F.lit(False)
            cut = table.filter(crosses | whole).select(
                *g, F.when(~whole, F.col("_b")).alias("_prefix"), (F.col("_left") - F.col("_before")).alias("_left"), F.col("_n")
            )
            cuts, path = write_once(cut.dropDuplicates([*g, "_prefix"]), "cut-prefix")
            made.append(path)
            if inside is None:
                wholes = cuts.filter("_prefix is null").select(*g).distinct()
            inside = cuts.filter("_prefix is not null").select(*g, "_prefix", "_left")
            most = cuts.filter("_prefix is not null").agg(F.max("_n"), F.max(F.length("_prefix"))).first()
            # a prefix that is shorter than its digits is a whole key: nothing to refine
            if most[0] is None or most[0] <= RANK_ROWS or most[1] < digits:
                break
            digits += BUCKET_DIGITS
        rows = _within(keys.withColumn("_b", F.substring("_key", 1, digits)), inside, g, digits)
        order = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
        like = Window.partitionBy(*g, "_key", *t)
        ranked = rows.select(
            *g, "_left", F.struct("_key", *t).alias("_bound"),
            F.row_number().over(order.orderBy("_key", *t)).alias("_r"),
            F.rank().over(order.orderBy("_key", *t)).alias("_low"),
            F.count(F.lit(1)).over(like).alias("_have"),
        )
        found = ranked.filter(F.col("_r") == F.col("_left")).select(
            *g, "_bound", (F.col("_left") - F.col("_low") + 1).cast("bigint").alias("_need"), "_have"
        )
        nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("_bound", "_need", "_have")]
        bounds, _ = write_once(found.unionByName(wholes.select(*g, *nothing)), "cut-bounds")
    finally:
        for path in made:
            remove_path(spark, path)
    return bounds


def _within(rows: DataFrame, inside: DataFrame, g: list[str], digits: int) -> DataFrame:
    """Rows whose key begins with their group's prefix of ``digits`` digits, with ``_left``."""
    side = inside.select(*[F.col(c).alias(f"_r{c}") for c in g], F.col("_prefix"), F.col("_left"))
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in g] + [F.substring("_key", 1, digits) == F.col("_prefix")]
    return rows.join(side, functools.reduce(lambda a, b: a & b, same)).drop("_prefix", *[f"_r{c}" for c in g])


def _with_k(table: DataFrame, totals: DataFrame, k, by: list[str], g: list[str]) -> DataFrame:
    """``table`` with its group's ``_total`` and the number of rows to take, ``_left``."""
    if isinstance(k, DataFrame):
        named = k.select(*[F.col(c).alias(f"_r{n}") for c, n in zip(by, g)], F.col("_k").cast("bigint").alias("_left"))
        same = [F.col(n).eqNullSafe(F.col(f"_r{n}")) for n in g]
        totals = totals.join(named, functools.reduce(lambda a, b: a & b, same), "left") if g else totals.withColumn("_left", named.scalar())
        totals = totals.drop(*[f"_r{n}" for n in g])
    elif callable(k):
        totals = totals.withColumn("_left", k(F.col("_total")).cast("bigint"))
    else:
        totals = totals.withColumn("_left", F.lit(int(k)).cast("bigint"))
    totals = totals.fillna(0, ["_left"]).select(*[F.col(c).alias(f"_r{c}") for c in g], "_total", "_left")
    if not g:
        # one row of totals: both numbers are scalars
        one = totals.agg(F.max(F.struct("_total", "_left")).alias("_one"))
        return table.withColumn("_one", one.scalar()).select("*", "_one.*").drop("_one")
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in g]
    return table.join(totals, functools.reduce(lambda a, b: a & b, same)).drop(*[f"_r{c}" for c in g])


def with_take_flag(
    df: DataFrame,
    key: Column,
    k: int | DataFrame | Callable[[Column], Column],
    by: Sequence[str] | str | None = None,
    tiebreak: Sequence[str] | str | None = None,
    flag: str = "_take",
) -> DataFrame:
    """Add boolean ``flag``: the row is among the first ``k`` of its group in (key, tiebreak) order.

    ``k`` is a number, a function of the group's size (a Column over the table of groups, so
    windows over all groups are allowed), or a DataFrame holding the group columns and a
    column ``_k`` (one row per group; a group missing from it takes nothing). The bounds are
    computed when this is called; the result is one pass over ``df``.
    """
    by, tiebreak = _cols(by), _cols(tiebreak)
    bounds = _bounds(df, key, k, by, tiebreak)
    place = F.struct(F.coalesce(key, F.lit(LAST_KEY)).alias("_key"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tiebreak)])
    if not by:
        row = bounds.first()
        if row is None or row["_bound"] is None:
            return df.withColumn(flag, F.lit(row is not None))
        bound = F.struct(*[F.lit(row["_bound"][f.name]).cast(f.dataType).alias(f.name) for f in bounds.schema["_bound"].dataType])
        split = row["_need"] < row["_have"]
        joined = df
        within = place < bound if split else place <= bound
        equal, need = place == bound, F.lit(row["_need"])
    else:
        renamed = bounds.select(F.lit(True).alias("_known"), *[c for c in bounds.columns])
        same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)])
        joined = df.join(renamed, same, "left")
        split = not bounds.filter("_need < _have").isEmpty()
        straddles = F.coalesce(F.col("_need") < F.col("_have"), F.lit(False))
        compared = F.when(straddles, place < F.col("_bound")).otherwise(place <= F.col("_bound"))
        within = F.when(F.col("_known").isNull(), F.lit(False)).when(F.col("_bound").isNull(), F.lit(True)).otherwise(compared)
        equal, need = straddles & (place == F.col("_bound")), F.col("_need")
    extra = [c for c in joined.columns if c not in df.columns]
    if not split:
        return joined.withColumn(flag, within).drop(*extra)
    # equal rows on both sides of the cut: only those are numbered
    equal = F.coalesce(equal, F.lit(False))
    first = Window.partitionBy(*by, *tiebreak).orderBy(F.lit(0))
    alike = joined.filter(equal).withColumn(flag, F.row_number().over(first) <= need)
    return joined.filter(~equal).withColumn(flag, within).unionByName(alike).drop(*extra)


def take_first(df: DataFrame, key: Column, k, by=None, tiebreak=None) -> DataFrame:
    """Rows among the first ``k`` per group."""
    return with_take_flag(df, key, k, by, tiebreak, "_take").filter("_take").drop("_take")


def dense_index(
    df: DataFrame,
    key: Column,
    by: Sequence[str] | str | None = None,
    tiebreak: Sequence[str] | str | None = None,
    out: str = "idx",
) -> DataFrame:
    """0-based position of each row inside its group in (key, tiebreak) order.

    The bucket offsets are joined on (group, bucket) and the rows are ranked inside
    their bucket; both use the same (group, bucket) partitioning, so the rows cross
    the network once.
    """
    by = _cols(by)
    tiebreak = _cols(tiebreak)
    keyed = df.withColumn("_xkey", F.coalesce(key, F.lit(LAST_KEY))).withColumn("_xb", F.substring("_xkey", 1, BUCKET_DIGITS))
    buckets = _bucket_table(keyed.select(*by, "_xb"), by).drop("_xn")
    joined = _same(keyed, buckets, by, "inner")
    w = Window.partitionBy(*by, "_xb").orderBy("_xkey", *tiebreak)
    return joined.withColumn(out, (F.col("_xbefore") + F.row_number().over(w) - 1).cast("bigint")).drop(
        "_xkey", "_xb", "_xbefore"
    )


def dense_order(df: DataFrame, order: Sequence[str | Column], out: str = "idx") -> DataFrame:
    """0-based position of each row of a whole table in ``order``, written once.

    Rows are dealt by range and sorted, and written with their partition and their place in
    it; a partition begins behind the rows of those before it (one row per partition). Rows
    cross the network once. ``order`` should tell rows apart; among equal ones any order holds.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    place = F.monotonically_increasing_id()  # partition in the upper bits, place in it below
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_xm", place)
    rows, _ = write_once(dealt, "dense-order")
    split = rows.withColumn("_xp", F.shiftright("_xm", 33))
    counts = split.groupBy("_xp").agg(F.count(F.lit(1)).alias("_xn"))
    before = Window.orderBy("_xp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_xp", F.coalesce(F.sum("_xn").over(before), F.lit(0)).alias("_xo"))
    within = F.col("_xm").bitwiseAND(F.lit((1 << 33) - 1))
    return split.join(offsets, "_xp").withColumn(out, (F.col("_xo") + within).cast("bigint")).drop("_xp", "_xm", "_xo")

"""Exact splits, over- and undersampling, two-stage balancing.

The reference's row order (file order) and its random generators are replaced by
seeded md5 keys, so every result is exact in size, repeatable, independent of
partitioning and checkable with SQL ``row_number``:

- order key of a row:       ``md5(seed ':' id)``
- i-th draw of a class:     ``md5(seed ':draw:' class ':' i)`` mod class size
- undersampling key:        ``md5(seed ':under:' id ':' draw)`` (draw -1 for originals)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions.keys import draw as seeded_draw
from spanlab.functions.keys import seeded_key
from spanlab.operators.exactk import dense_index, take_first, with_take_flag
from spanlab.session import materialize

# Rows of draws generated per task when a class is drawn up (bounds one task's work).
DRAW_CHUNK = 1 << 20
# Draws that one row of a class answers per salt.
SALT_DRAWS = 1 << 16


def order_key(seed, id_col: str):
    return seeded_key(seed, id_col)


def split_exact(df: DataFrame, id_col: str = "tweet_id", frac: float = 0.2, seed: int = 25, out: str = "split") -> DataFrame:
    """G1: ``ceil(frac · n)`` rows go to ``val``, the rest to ``train`` (shuffled, not stratified)."""
    x = with_take_flag(df, order_key(seed, id_col), lambda n: F.ceil(F.lit(float(frac)) * n), None, id_col, "_val")
    return x.withColumn(out, F.when(F.col("_val"), F.lit("val")).otherwise(F.lit("train"))).drop("_val")


def first_half(df: DataFrame, id_col: str = "tweet_id", seed: int = 25, by=None) -> DataFrame:
    """flag ``_first`` = the row is in the first ``n // 2`` rows (per group) in key order."""
    return with_take_flag(df, order_key(seed, id_col), lambda n: F.floor(n / 2), by, id_col, "_first")


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))


def oversample(df: DataFrame, label: str, id_col: str = "tweet_id", seed: int = 25) -> DataFrame:
    """Draw every smaller class up to the largest, with replacement; originals kept once.

    Output = input rows (``draw`` null) ∪ drawn copies (``draw`` = i, the i-th draw
    of its class). Draws are generated in chunks spread over tasks and joined to
    the class rows on (class, dense index), which spreads even one huge class
    over all partitions.
    """
    sizes = class_sizes(df, label)
    sizes = sizes.withColumn("_m", F.max("_n").over(Window.partitionBy()))  # small table: one row per class
    need = sizes.withColumn("_d", F.col("_m") - F.col("_n")).filter(F.col("_d") > 0)
    chunks = need.select(
        label, "_n", "_d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_d") / DRAW_CHUNK).cast("bigint") - 1)).alias("_c")
    )
    draws = chunks.repartition(label, "_c").select(
        label,
        "_n",
        F.explode(
            F.sequence(F.col("_c") * DRAW_CHUNK, F.least((F.col("_c") + 1) * DRAW_CHUNK, F.col("_d")) - 1)
        ).alias("draw"),
    )
    name = F.coalesce(F.col(label).cast("string"), F.lit(""))
    draws = draws.withColumn("idx", seeded_draw(seeded_key(seed, F.lit("draw"), name, F.col("draw")), F.col("_n")))
    indexed = dense_index(df, order_key(seed, id_col), label, id_col, "idx")
    # a class of few rows has few (class, idx) keys: its rows are copied once per salt and
    # the draws dealt over the salts, so no key holds more than about DRAW_CHUNK draws
    salts = need.select(
        F.col(label).alias("_l"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_d") / (F.col("_n") * SALT_DRAWS)).cast("bigint")).alias("_salts")
    )
    dealt = draws.join(salts, F.col(label).eqNullSafe(F.col("_l"))).select(
        F.col(label).alias("_l"), F.col("idx").alias("_idx"), "draw", F.pmod("draw", "_salts").alias("_s")
    )
    copies = indexed.join(salts, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)))
    same = F.col(label).eqNullSafe(F.col("_l")) & (F.col("idx") == F.col("_idx")) & (F.col("_salt") == F.col("_s"))
    picked = copies.join(dealt, same, "inner").drop("idx", "_idx", "_l", "_s", "_salt", "_salts")
    base = df.withColumn("draw", F.lit(None).cast("bigint"))
    return base.unionByName(picked.select(*base.columns))


def undersample(df: DataFrame, label: str, id_col: str = "tweet_id", seed: int = 25) -> DataFrame:
    """Cut every larger class to the smallest, without replacement (exact size)."""
    if "draw" not in df.columns:
        df = df.withColumn("draw", F.lit(None).cast("bigint"))
    key = seeded_key(seed, F.lit("under"), F.col(id_col), F.coalesce(F.col("draw"), F.lit(-1)))
    smallest = Window.partitionBy()  # over the table of class sizes
    return take_first(df, key, lambda n: F.min(n).over(smallest), label, [id_col, "draw"])


def balance_two_stage(df: DataFrame, label: str, negative: str, id_col: str = "tweet_id", seed: int = 25) -> DataFrame:
    """Positives + first half of negatives → oversample; add the other negatives → undersample.

    With P positives and N negatives each class ends with max(P, N // 2) rows. The
    input and the oversampled stage are each read by several passes, so both are
    checkpointed once.
    """
    df = materialize(df)
    neg = df.filter(F.col(label) == F.lit(negative))
    pos = df.filter(~F.col(label).eqNullSafe(F.lit(negative)))
    halves = first_half(neg, id_col, seed)
    stage1 = pos.unionByName(halves.filter("_first").drop("_first"))
    over = materialize(oversample(stage1, label, id_col, seed))
    rest = halves.filter(~F.col("_first")).drop("_first").withColumn("draw", F.lit(None).cast("bigint"))
    return undersample(over.unionByName(rest), label, id_col, seed)

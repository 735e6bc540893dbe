"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = least node reachable.

    Large-star and small-star steps alternate until the edges no longer change: a number
    of rounds logarithmic in the component size, also for long chains. A node's least
    neighbour is a partial aggregate, so a node with very many edges is summed before the
    exchange; its edges meet that one row in a join that Spark can split. Each round is
    written to the shared checkpoint folder. Null ends and loops are dropped; nodes and
    labels keep the type of ``a``.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    current = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-0")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour is tied to the least one
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "cc-large")
        # small star: the smaller neighbours and the node itself are tied to the least one
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = written(tied.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = _state(current)
        if now == state:
            break
        state = now
    labels = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return labels.unionByName(roots)


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]

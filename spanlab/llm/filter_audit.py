"""Filter interaction audit by min-plus removal ranks (operator 13).

Several filters run over the same documents. For every order of them the audit says what
each step removes, what it would have removed had an earlier filter not done so, and what
labelled documents it costs:

1. One pass over the whole texts gives each document its row of the *mask matrix* (which
   filters it fails) and the SHA-256 of its text. The duplicate filter needs the table: a
   document fails it when an equal text has a smaller doc_id.
2. Documents are counted by (part, mask row) with their labels as weights; equal rows of
   the mask matrix are one row from here on.
3. The mask matrix (0 where a filter fails, infinite elsewhere) is combined with the
   *position matrix* of all orders (the inverse permutations) by minimum instead of by
   sum: the least position of a failing filter is the step that removes the document.
4. The removal steps scatter the weights over (order, step); sums along the steps give
   what is kept, and failures less removals give what is redundant.

Steps 1 and 2 are Spark jobs over all documents; equal texts are counted in the map side
before a shuffle, so a text that a third of the rows share costs a few rows a task. Step 3
and 4 see one row per part with at most 2^filters counts.

Defined results: a null text is the empty text, a null source is the part of the empty
string. A null doc_id is neither smaller nor larger than another, so it never fails the
duplicate filter and makes no other document fail it, and it has no label. Rows that
repeat a doc_id are documents of their own; those that hold the smallest doc_id of their
text all pass the duplicate filter. A document is good (toxic) when any label row of its
doc_id says so. An empty table has no parts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab.llm.arrays import bytes_column
from spanlab.llm.common import table
from spanlab.session import ship_package

# The filters' letters and bounds.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
SYMBOL = re.compile(rb"[#$%&*|]")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))
DUPLICATE = 1 << LETTERS.index("E")

# Rows whose join key is null are dealt over so many partitions; they match nothing.
NULL_SALTS = 1009

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: bytes) -> int:
    """Failed filters of one text as bits, without the duplicate filter."""
    words = text.split()  # bytes split at exactly \x20 and \x09-\x0D
    points = len(text.translate(None, CONTINUATION))
    upper = len(text) - len(text.translate(None, UPPER))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * upper > MOST_UPPER * points,
        SYMBOL.search(text) is not None,
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def masked(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest) of every document; mask without the duplicate filter."""

    def rows(batches):
        for b in batches:
            texts = [t or b"" for t in bytes_column(b, "text")]
            masks = pa.array([text_mask(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), masks, digests], names=["doc_id", "part", "mask", "digest"])

    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.col("text"))
    return src.mapInArrow(rows, "doc_id long, part string, mask int, digest binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` of their doc_id (false without a label)."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).alias("salt")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS))).otherwise(0).cast("int")
    return rows.withColumn("salt", salt).join(marks, ["doc_id", "salt"], "left").na.fill(False, ["good", "toxic"])


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Documents by (part, mask): ``n``, ``good`` and ``toxic``, the duplicate filter included."""
    kind = ["part", "mask", "good", "toxic"]
    # co-located with the label join: equal rows of one doc_id become one
    each = labelled(masked(docs, part), labels).groupBy("doc_id", "salt", "digest", *kind).agg(F.count(F.lit(1)).alias("n"))
    least = F.struct("doc_id", "n")
    known = F.col("doc_id").isNotNull()
    texts = each.groupBy("digest", *kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(known, least)).alias("least"),
    )
    # a text has as many rows here as it has parts and labels
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    holds = F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    passing = F.coalesce(F.col("n_null") + holds, F.col("n_null"))
    texts = texts.select(*kind, "n", passing.alias("passing"))
    both = F.explode(
        F.array(
            F.struct(F.col("mask"), F.col("passing").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(DUPLICATE)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
        )
    )

    def weight(flag: Column) -> Column:
        return F.sum(F.when(flag, F.col("c.n")).otherwise(0))

    split = texts.select("part", "good", "toxic", both.alias("c")).filter("c.n > 0")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), weight(F.col("good")).alias("good"), weight(F.col("toxic")).alias("toxic")
    )


# ---------------------------------------------------------------- ranks


def positions(letters: str = LETTERS) -> tuple[list[str], np.ndarray]:
    """All orders and their inverse permutations: ``[order, filter]`` is the filter's place."""
    orders = list(itertools.permutations(range(len(letters))))
    return ["".join(letters[f] for f in o) for o in orders], np.argsort(np.array(orders), axis=1)


def removal_ranks(masks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Min-plus product of the mask matrix and the positions: ``[row, order]`` is the step
    (from 0) that removes the row, the number of filters where none does."""
    k = place.shape[1]
    never = np.where(masks[:, None] >> np.arange(k) & 1, 0, k)  # 0 where the filter fails
    return np.minimum((never[:, None, :] + place[None, :, :]).min(axis=2), k)


def audit_part(masks: np.ndarray, weights: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Counts ``[order, step]`` of one part; ``weights`` holds a row each for all, good and toxic."""
    n_orders, k = place.shape
    ranks = removal_ranks(masks, place)
    at = np.argsort(place, axis=1)  # the filter of each step
    lost = np.zeros((len(weights), n_orders, k + 1), np.int64)
    for w, out in zip(weights, lost):
        np.add.at(out, (np.arange(n_orders)[None, :], ranks), w[:, None])
    removed = lost[0, :, :k]
    fails = np.array([weights[0][masks >> f & 1 == 1].sum() for f in range(k)], np.int64)
    alone = np.array([weights[0][masks == 1 << f].sum() for f in range(k)], np.int64)
    shapley = np.take_along_axis(removed, place, axis=1).sum(axis=0)
    return {
        "kept": weights[0].sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": fails[at] - removed,  # all that fail here and are gone already
        "unique_fails": alone[at],
        "good_lost": lost[1, :, :k],
        "toxic_lost": lost[2, :, :k],
        "shapley": shapley[at],
    }


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``AUDIT`` rows: every part, order and step, zeros included."""
    names = [c.split()[0] for c in AUDIT.split(", ")]

    def rows(batches):
        orders, place = positions()
        k = len(LETTERS)
        for b in batches:
            for r in b.to_pylist():
                masks = np.array([c["mask"] for c in r["counts"]], np.int64)
                weights = np.array([[c[w] for c in r["counts"]] for w in ("n", "good", "toxic")], np.int64)
                counts = audit_part(masks, weights, place)
                cols = [np.repeat(orders, k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)), *[counts[c].reshape(-1) for c in names[3:]]]
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(cols[0]), pa.string()), *map(pa.array, cols)], names=names)

    # at most 2^filters counts a part
    per_part = mask_counts(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return per_part.mapInArrow(rows, AUDIT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over all documents, by source."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH texts AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT x.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic, [
      len(ws) < 50,
      100 * len(list_distinct(ws)) < 65 * len(ws),
      100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
      regexp_matches(t, '[#$%&*|]'),
      coalesce(min(x.doc_id) OVER (PARTITION BY t) < x.doc_id, false)] AS f
  FROM texts x LEFT JOIN marks m ON x.doc_id = m.doc_id
), counts AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (SELECT unnest(range(1, 6)) AS step
), removed AS (
  SELECT c.part, o.o, s.step, o.o[s.step] AS i, c.f, c.n, c.good, c.toxic,
         c.f[o.o[s.step]] AS failing,
         len(list_filter(o.o[1:s.step - 1], lambda j: c.f[j])) > 0 AS gone,
         len(list_filter(c.f, lambda x: x)) = 1 AS alone
  FROM counts c, orders o, steps s
), cells AS (
  SELECT part, o, step, i,
         sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failing AND alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM removed GROUP BY ALL
)
SELECT part, list_aggregate(list_transform(o, lambda j: substr('ABCDE', j, 1)), 'string_agg', '') AS filter_order,
       CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM cells
"""

"""Benchmark decontamination by spaced seeds (operator 1, native).

Words are runs of letters and digits, lower-cased. A mask such as ``1101`` hashes the
words at its ones and ignores those at its zeros, so a changed word under a zero does
not hide a passage. The hashes of all benchmark windows (training side) and of all
document windows are joined; around each hit the document is laid over the item on the
hit's diagonal, and the overlap counts when some window of ``window`` words (the whole
item if it is shorter) agrees in at least ``share`` of its words.

The default masks hit every such window of 13 words with up to two changed words (a
test tries all), so for items of 13 words or more the result does not depend on them.
An item shorter than the window is laid whole; it has masks of its own length that leave
none of its allowed changes unhit (``short_masks``), so items of any length are found.

Only built-in SQL runs here. Before the join, document windows are held against a bit
field of the benchmark's hashes (fixed size, at most ``MAX_BITS``; it changes the amount
of work only): windows that cannot match are never exploded or shuffled.

Defined results: null and empty texts match nothing; a null doc_id is kept in the
output; repeated documents are reported once each; repeated items are reported under
each of their ids (a null id: -1); empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import let, table, written
from spanlab.llm.secret_scan import blob_id

# Two masks of weight six that leave no window of 13 words with two changes unhit.
MASKS = ["11101011", "110100111"]
WINDOW = 13
SHARE = 0.8

MIN_BITS = 1 << 16
MAX_BITS = 1 << 23
BITS_PER_SEED = 128
PROBES = 3


def short_masks(length: int, share: float = SHARE) -> list[str]:
    """Masks as long as a short item: one of them ignores any set of words that ``share`` allows to change.

    With e changes the item is cut into e + 2 even parts and each mask ignores e of them.
    """
    changes = length - math.ceil(round(length * share, 9))
    parts = min(changes + 2, length)
    part = [k * parts // length for k in range(length)]
    return ["".join("0" if p in gone else "1" for p in part) for gone in combinations(range(parts), min(changes, parts - 1))]


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(w, lambda x: F.xxhash64(x))


def mask_hash(h: Column, i: Column, mask: str, number: int) -> Column:
    """Hash of the words of ``h`` under the ones of a mask laid at position ``i``."""
    ones = [k for k, c in enumerate(mask) if c == "1"]
    return F.xxhash64(*[F.get(h, i + k) for k in ones], F.lit(number))


def seeds(h: Column, masks: list[str] = MASKS, number: int = 0) -> Column:
    """All (position, hash) of all masks, numbered from ``number``, as one array."""

    def of(mask: str, number: int) -> Column:
        last = F.size(h) - len(mask)
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), mask_hash(h, i, mask, number).alias("hash")))

    return F.concat(*[of(m, number + k) for k, m in enumerate(masks)])


def _probe(hash_: Column, k: int, bits: int) -> Column:
    """The k-th bit position of a seed hash (bits is a power of two)."""
    return F.shiftrightunsigned(hash_, 20 * k).bitwiseAND(F.lit(bits - 1))


def bit_field(hashes: DataFrame, bits: int) -> DataFrame:
    """One row, one column: the bit field as an array of ``bits / 64`` longs.

    The group that collects it has at most ``bits / 64`` rows.
    """
    spots = hashes.select(F.explode(F.array(*[_probe(F.col("hash"), k, bits) for k in range(PROBES)])).alias("spot"))
    cells = spots.groupBy(F.shiftright("spot", 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("spot").bitwiseAND(F.lit(63)).cast("int"))).alias("v")
    )
    every = hashes.sparkSession.range(bits // 64).select(F.col("id").alias("cell"), F.lit(0).cast("bigint").alias("v"))
    whole = every.unionByName(cells).groupBy("cell").agg(F.bit_or("v").alias("v"))
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "v"))), lambda x: x["v"]).alias("field"))


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    masks: list[str] = MASKS,
    window: int = WINDOW,
    share: float = SHARE,
) -> DataFrame:
    """Benchmark overlaps: one row per document row and item.

    ``docs`` (doc_id, text), ``items`` (item_id, text). Returns doc_id, item_id, start
    (word position in the document at which the item's first word lies; may be negative
    when the item's head is missing), n_matched (agreeing words on that diagonal),
    n_best (agreeing words of the best window), n_item (words of the item); of several
    diagonals the one with most agreeing words (ties: the first).
    """
    bench = items.select(F.coalesce("item_id", F.lit(-1)).alias("item_id"), word_hashes(F.col("text")).alias("h"))
    bench = written(bench.filter(F.size("h") > 0).distinct(), "decon-items")
    # items shorter than the window: one group of masks for each length there is (fewer than the window)
    lengths = sorted(r["n"] for r in bench.select(F.size("h").alias("n")).filter(F.col("n") < window).distinct().collect())
    groups, number = {}, len(masks)
    for n in lengths:
        groups[n] = (short_masks(n, share), number)
        number += len(groups[n][0])
    laid_out = seeds(F.col("h"), masks)
    for n, (own, first) in groups.items():
        laid_out = F.when(F.size("h") == n, seeds(F.col("h"), own, first)).otherwise(laid_out)
    marks = written(
        bench.select("item_id", F.explode(laid_out).alias("s")).select(
            "item_id", F.col("s.pos").alias("item_pos"), F.col("s.hash").alias("hash")
        ),
        "decon-seeds",
    )
    # the field's size follows the number of seeds up to its bound
    wanted = marks.count() * BITS_PER_SEED
    bits = MIN_BITS
    while bits < wanted and bits < MAX_BITS:
        bits *= 2
    field = written(bit_field(marks.select("hash"), bits), "decon-field").scalar()

    def passes(s):
        test = F.lit(True)
        for k in range(PROBES):
            spot = _probe(s["hash"], k, bits)
            cell = F.get(F.col("field"), F.shiftright(spot, 6).cast("int"))
            test = test & (F.getbit(cell, spot.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return test

    def every(h):
        return F.concat(seeds(h, masks), *[seeds(h, own, first) for own, first in groups.values()])

    # one array element per document with a hit, none for the others: words and hits are computed once
    scanned = let(
        word_hashes(F.col("text")), lambda h: F.struct(h.alias("h"), F.filter(every(h), passes).alias("hits"))
    )
    hit = docs.select("doc_id", "text", field.alias("field")).select(
        "doc_id", F.explode(F.filter(F.array(scanned), lambda x: F.size(x["hits"]) > 0)).alias("x")
    )
    # few documents are left; the row number names a row once it is written
    hit = written(hit.select("doc_id", "x.h", "x.hits", F.monotonically_increasing_id().alias("row")), "decon-hits")
    found = hit.select("row", F.explode("hits").alias("s")).select("row", F.col("s.pos").alias("pos"), F.col("s.hash").alias("hash"))
    lines = (
        found.join(marks, "hash")
        .select("row", "item_id", (F.col("pos") - F.col("item_pos")).alias("start"))
        .distinct()
    )
    laid = lines.join(hit.select("row", "doc_id", "h"), "row").join(
        bench.select("item_id", F.col("h").alias("ih")), "item_id"
    )
    n_item = F.size("ih")
    first = F.greatest(F.lit(0), -F.col("start"))
    last = F.least(n_item, F.size("h") - F.col("start")) - 1
    same = F.transform(
        F.sequence(first, last), lambda k: (F.get("h", F.col("start") + k) == F.get("ih", k)).cast("int")
    )
    width = F.least(F.lit(window), n_item)
    best = let(
        same,
        lambda m: F.struct(
            F.aggregate(m, F.lit(0), lambda a, x: a + x).alias("n_matched"),
            F.when(
                F.size(m) >= width,
                F.array_max(
                    F.transform(
                        F.sequence(F.lit(1), F.size(m) - width + 1),
                        lambda s: F.aggregate(F.slice(m, s, width), F.lit(0), lambda a, x: a + x),
                    )
                ),
            ).otherwise(F.lit(0)).alias("n_best"),
        ),
    )
    scored = laid.select("row", "doc_id", "item_id", "start", n_item.alias("n_item"), width.alias("width"), best.alias("b"))
    kept = scored.filter(F.col("b.n_best") >= F.ceil(F.col("width") * share))
    pick = F.max_by(
        F.struct("doc_id", "start", F.col("b.n_matched").alias("n_matched"), F.col("b.n_best").alias("n_best"), "n_item"),
        F.struct(F.col("b.n_matched"), -F.col("start")),
    )
    return kept.groupBy("row", "item_id").agg(pick.alias("x")).select(
        "x.doc_id", "item_id", "x.start", "x.n_matched", "x.n_best", "x.n_item"
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark overlaps of every document."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that overlap a benchmark item go."""
    # a row goes for its own text: rows that share an id (or have none) may hold different texts
    leaks = overlaps(docs.select(blob_id(F.col("text")).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    # written first, so its size is known when the join is planned: a small list moves no text
    leaks = written(leaks.select(F.col("doc_id").alias("_blob")).distinct(), "decon-leaks")
    return docs.join(leaks, blob_id(docs["text"]) == leaks["_blob"], "left_anti").select(*docs.columns)


# Independent of the seeds: any window of 13 with two changes holds a run of four equal
# words, so every overlap is found from equal four-word runs. Items have 13 words or more.
ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM benchmark),
dg AS (SELECT doc_id, p, concat_ws(' ', w[p], w[p+1], w[p+2], w[p+3]) g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) p FROM dw)),
bg AS (SELECT item_id, p, concat_ws(' ', w[p], w[p+1], w[p+2], w[p+3]) g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) p FROM bw)),
lines AS (SELECT DISTINCT doc_id, item_id, dg.p - bg.p s FROM dg JOIN bg USING (g)),
laid AS (
  SELECT doc_id, item_id, s, len(bw.w) n_item, least(13, len(bw.w)) width,
    list_transform(range(greatest(0, -s), least(len(bw.w), len(dw.w) - s)), lambda k: CASE WHEN dw.w[s + k + 1] = bw.w[k + 1] THEN 1 ELSE 0 END) m
  FROM lines JOIN dw USING (doc_id) JOIN bw USING (item_id)),
scored AS (
  SELECT doc_id, item_id, s, n_item, width, list_sum(m) n_matched,
    coalesce(list_max(list_transform(range(1, len(m) - width + 2), lambda i: list_sum(m[i:i + width - 1]))), 0) n_best
  FROM laid),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, s) r FROM scored WHERE n_best >= ceil(width * 0.8))
SELECT doc_id, item_id, CAST(s AS INTEGER) AS start, CAST(n_matched AS INTEGER) AS n_matched, CAST(n_best AS INTEGER) AS n_best, CAST(n_item AS INTEGER) AS n_item FROM kept WHERE r = 1
"""

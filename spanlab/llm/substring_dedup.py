"""Substring dedup by earliest-source runs of repeated k-mers (operator 3).

This is not De Bruijn compaction: no node or degree is formed, and a run goes on over a
branching node as long as its earliest source goes on with it. What is removed depends on
which k-mers repeat an earlier one only, not on how they are grouped into runs. Repeated
k-mers (runs of ``K`` words) are found and joined so:

1. Every k-mer belongs to its minimizer, the least hash among the ``ANCHOR``-word runs
   inside it; equal k-mers have equal minimizers. First only the minimizers are dealt out
   (about one word in seven): those that occur once cannot lie in a repeated k-mer.
2. The k-mers with a repeated minimizer are dealt out by minimizer, so neighbours in a
   text mostly meet in one bucket. A bucket ties each k-mer to its source, the earliest
   occurrence that it holds (least doc_id, then least start), and glues k-mers that follow one another
   both in the document and at the source into runs: where the source's next
   k-mer is another one, the run ends.
3. The pieces of each document are joined on its id and glued across buckets where both
   coordinates go on. A run of ``m`` k-mers is a repeat of ``m + K - 1`` words at
   known coordinates in both places. K-mers are compared by 64 + 32 bits that come from the
   same 64-bit word hashes; the words of both places are not compared again.

Every task first keeps the earliest occurrence of each k-mer it has read and answers the
others itself (their source is that one; whether a k-mer occurs earlier at all does not
depend on how rows are dealt), so a passage in a third of all documents reaches its bucket once per task.
Documents without any repeat are never shuffled with their text: a bit field of fixed
size tells them apart in the scan (who passes it is joined exactly).

A document is an id with its text: where rows of one doc_id (or without one) differ in
text, a 64-bit hash of the text, ``copy``, tells them apart and orders them; it is 0 elsewhere.

Defined results: null and empty texts have no words; a null doc_id comes after all others.
Rows of one doc_id (or of null) with different texts are documents of their own, in the
order of their hashes: a word goes only where the row's own text repeats an earlier one.
Rows alike in id and text are one document, so both stay as they are. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.arrays import OTHER_STEP, WordHashes, bytes_column, has, id_filter, lean, pack, sliced, unpack, windows
from spanlab.llm.common import table, temporary, written
from spanlab.session import ship_package

K = 20
ANCHOR = 8
CHUNK = 400_000  # k-mers that a task compares before it sends them on
MEMO = 150_000  # words whose hash a task remembers
NOWHERE = np.iinfo(np.int64).max  # stands for a null doc_id

RUNS = "doc long, copy long, at long, edges long, source long, source_copy long, source_at long"


def shards(spark: SparkSession) -> int:
    """Buckets follow the number of shuffle partitions."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def minimizers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every anchor run, and for each k-mer the place of its least one (the first of equals)."""
    a = windows(h, ANCHOR, seed=1)
    if len(h) < K:
        return a, np.empty(0, np.int64)
    width = K - ANCHOR + 1
    return a, np.arange(len(h) - K + 1) + sliding_window_view(a, width).argmin(axis=1)


def differs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it in any column (the first does)."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def runs(doc, copy, at, source, source_copy, source_at) -> tuple[np.ndarray, ...]:
    """Single edges (any order) glued to runs that go on in the document and at the source."""
    order = np.lexsort((at, copy, doc))
    doc, copy, at, source, source_copy, source_at = (x[order] for x in (doc, copy, at, source, source_copy, source_at))
    # inside a run both coordinates go up by one with the row
    number = np.arange(len(doc))
    first = np.flatnonzero(differs(doc, copy, at - number, source, source_copy, source_at - number))
    size = np.diff(np.append(first, len(doc)))
    return doc[first], copy[first], at[first], size, source[first], source_copy[first], source_at[first]


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0))


def _batch(names: list[str], arrays: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, kinds)], names=names)


# ---------------------------------------------------------------- repeated minimizers

ANCHORS = "shard int, hashes binary, docs binary, copies binary, ats binary, flags binary"


def anchor_rows(docs: DataFrame, n: int) -> DataFrame:
    """Minimizer occurrences by shard; an occurrence known to be repeated is flagged.

    Of an anchor that a task has met several times one row (flag 2: repeated, already
    answered) goes to the anchor's shard; its occurrences go along with flag 1.
    """

    def one(batches):
        hashes = WordHashes(MEMO)
        held, size = [], 0
        for b in sliced(batches):
            for doc, copy, text in zip(b.column("doc").to_pylist(), b.column("copy").to_pylist(), bytes_column(b, "text")):
                a, least = minimizers(hashes.of((text or b"").split()))
                if len(least):
                    spots = np.unique(least)
                    held.append((a[spots], np.full(len(spots), doc, np.int64), np.full(len(spots), copy, np.int64), spots))
                    size += len(spots)
                if size > CHUNK:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def send(held):
        h, doc, copy, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, copy, doc, h))
        order = order[differs(h[order], doc[order], copy[order], at[order])]  # repeated rows are one place
        h, doc, copy, at = h[order], doc[order], copy[order], at[order]
        head = differs(h)
        size = np.diff(np.append(np.flatnonzero(head), len(h)))
        many = np.repeat(size > 1, size)
        shard = (h % np.uint64(n)).astype(np.int64)
        # occurrences met several times here are answers already: they travel by document
        out = []
        out.append((shard[head], h[head], doc[head], copy[head], at[head], np.where(many[head], 2, 0)))
        out.append((doc[many] % n, h[many], doc[many], copy[many], at[many], np.ones(many.sum(), np.int64)))
        s, h, doc, copy, at, flag = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((at, copy, doc, s))
        s, h, doc, copy, at, flag = s[order], h[order], doc[order], copy[order], at[order], flag[order]
        cut = np.flatnonzero(np.diff(s)) + 1
        rows = []
        for k, hh, dd, cc, aa, ff in zip(s[np.concatenate([[0], cut])], *(np.split(x, cut) for x in (h, doc, copy, at, flag))):
            rows.append((int(k), hh.tobytes(), pack(deltas(dd)), pack(cc), pack(aa.astype(np.uint32)), pack(ff.astype(np.uint8))))
        return _batch(["shard", "hashes", "docs", "copies", "ats", "flags"], list(zip(*rows)), [pa.int32(), *[pa.binary()] * 5])

    return docs.mapInArrow(lean(one), ANCHORS)


def repeated_anchors(rows: DataFrame, n: int) -> DataFrame:
    """doc, copy, at of every occurrence of a minimizer that occurs at two places or more."""
    kinds = [pa.int64(), pa.int64(), pa.int32()]

    def one(batches):
        held = []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("hashes", "docs", "copies", "ats", "flags")]
            for h, d, c, a, f in zip(*cols):
                h, d, c = np.frombuffer(h, np.uint64), np.cumsum(unpack(d, np.int64)), unpack(c, np.int64)
                a, f = unpack(a, np.uint32), unpack(f, np.uint8)
                answered = f == 1
                if answered.any():
                    yield _batch(["doc", "copy", "at"], [d[answered], c[answered], a[answered].astype(np.int32)], kinds)
                if not answered.all():
                    held.append((h[~answered], d[~answered], c[~answered], a[~answered], f[~answered]))
        if held:
            h, d, c, a, f = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, d, c, a, f = h[order], d[order], c[order], a[order], f[order]
            head = differs(h)
            group = np.cumsum(head) - 1
            other = differs(d, c, a) & ~head
            many = (np.bincount(group, weights=other + (f == 2)) > 0)[group] & (f == 0)
            yield _batch(["doc", "copy", "at"], [d[many], c[many], a[many].astype(np.int32)], kinds)

    return rows.repartition(n, "shard").mapInArrow(lean(one), "doc long, copy long, at int")


# ---------------------------------------------------------------- repeated edges

EDGES = "shard int, kmers binary, checks binary, docs binary, copies binary, ats binary, " + RUNS
EDGE_KINDS = [pa.int32(), *[pa.binary()] * 5, *[pa.int64()] * 7]


def edge_rows(docs: DataFrame, n: int) -> DataFrame:
    """Edges with a repeated minimizer by bucket, and finished runs (shard null) found within a task.

    ``docs`` has doc, copy, text and ats, the places of its repeated minimizers.
    """

    def one(batches):
        hashes = WordHashes(MEMO)
        held, size = [], 0
        for b in sliced(batches):
            for doc, copy, text, ats in zip(b.column("doc").to_pylist(), b.column("copy").to_pylist(), bytes_column(b, "text"), b.column("ats").to_pylist()):
                h = hashes.of((text or b"").split())
                a, least = minimizers(h)
                at = np.flatnonzero(np.isin(least, np.array(ats, np.int64)))
                if len(at):
                    held.append((windows(h, K)[at], windows(h, K, step=OTHER_STEP)[at].astype(np.uint32), np.full(len(at), doc, np.int64), np.full(len(at), copy, np.int64), at, a[least[at]]))
                    size += len(at)
                if size > CHUNK:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def send(held):
        e, check, doc, copy, at, anchor = (np.concatenate(x) for x in zip(*held))
        order, head, source = earliest(e, check, doc, copy, at)
        e, check, doc, copy, at, anchor = e[order], check[order], doc[order], copy[order], at[order], anchor[order]
        later = repeats(head, source, doc, copy, at)
        if later.any():
            yield run_batch(runs(*(x[later] for x in (doc, copy, at, doc[source], copy[source], at[source]))))
        e, check, doc, copy, at, s = e[head], check[head], doc[head], copy[head], at[head], (anchor[head] % np.uint64(n)).astype(np.int64)
        order = np.lexsort((at, copy, doc, s))
        e, check, doc, copy, at, s = e[order], check[order], doc[order], copy[order], at[order], s[order]
        cut = np.flatnonzero(np.diff(s)) + 1
        rows = []
        for k, ee, cc, dd, xx, aa in zip(s[np.concatenate([[0], cut])], *(np.split(x, cut) for x in (e, check, doc, copy, at))):
            rows.append((int(k), ee.tobytes(), cc.tobytes(), pack(deltas(dd)), pack(xx), pack(np.diff(aa, prepend=0).astype(np.int32))))
        cols = [*zip(*rows), *[[None] * len(rows)] * 7]
        yield _batch([f.split()[0] for f in EDGES.split(", ")], cols, EDGE_KINDS)

    def run_batch(found):
        size = len(found[0])
        cols = [[None] * size] * 6 + list(found)
        return _batch([f.split()[0] for f in EDGES.split(", ")], cols, EDGE_KINDS)

    return docs.mapInArrow(lean(one), EDGES)


def earliest(e, check, doc, copy, at):
    """Order by edge and place, the first of each edge, and (per ordered row) that first row."""
    order = np.lexsort((at, copy, doc, check, e))
    head = differs(e[order], check[order])
    return order, head, np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))


def repeats(head, source, doc, copy, at) -> np.ndarray:
    """Rows at another place than the first row of their edge."""
    return ~head & ((doc != doc[source]) | (copy != copy[source]) | (at != at[source]))


def bucket_runs(rows: DataFrame, n: int) -> DataFrame:
    """Runs (``RUNS``) of the edges that occur earlier in another task's documents."""

    def one(batches):
        held = []
        for b in batches:
            for e, c, d, x, a in zip(*[b.column(x).to_pylist() for x in ("kmers", "checks", "docs", "copies", "ats")]):
                places = np.cumsum(unpack(d, np.int64)), unpack(x, np.int64), np.cumsum(unpack(a, np.int32), dtype=np.int64)
                held.append((np.frombuffer(e, np.uint64), np.frombuffer(c, np.uint32), *places))
        if held:
            e, c, d, x, a = (np.concatenate(v) for v in zip(*held))
            held.clear()
            order, head, source = earliest(e, c, d, x, a)
            del e, c
            d, x, a = d[order], x[order], a[order]
            later = repeats(head, source, d, x, a)
            names = [f.split()[0] for f in RUNS.split(", ")]
            yield _batch(names, list(runs(*(v[later] for v in (d, x, a, d[source], x[source], a[source])))), [pa.int64()] * 7)

    return rows.repartition(n, "shard").mapInArrow(lean(one), RUNS)


# ---------------------------------------------------------------- paths and texts

PATHS = "doc long, copy long, starts array<long>, edges array<long>, sources array<long>, source_copies array<long>, source_starts array<long>"


def glued_paths(pieces: DataFrame) -> DataFrame:
    """Paths of each document (``PATHS``): its pieces, glued where document and source both go on."""
    names = [f.split()[0] for f in RUNS.split(", ")]

    def one(batches):
        for b in batches:
            out = [[] for _ in PATHS.split(", ")]
            for doc, copy, found in zip(b.column("doc").to_pylist(), b.column("copy").to_pylist(), b.column("pieces").to_pylist()):
                at, size, source, other, source_at = (np.array([p[c] for p in found], np.int64) for c in names[2:])
                order = np.lexsort((source_at, other, source, at))
                at, size, source, other, source_at = at[order], size[order], source[order], other[order], source_at[order]
                new = differs(source, other)
                new[1:] |= (at[1:] != at[:-1] + size[:-1]) | (source_at[1:] != source_at[:-1] + size[:-1])
                first = np.flatnonzero(new)
                for o, v in zip(out, (doc, copy, at[first], np.add.reduceat(size, first), source[first], other[first], source_at[first])):
                    o.append(v)
            yield _batch([f.split()[0] for f in PATHS.split(", ")], out, [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5])

    # a set: rows alike in id and text are one document, however many tasks answered for them
    grouped = pieces.groupBy("doc", "copy").agg(F.collect_set(F.struct(*names[2:])).alias("pieces"))
    return grouped.mapInArrow(lean(one), PATHS)


def keyed(docs: DataFrame, column: str) -> DataFrame:
    """doc, copy, text of each row; ids with several texts are found by one aggregation of hashes."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NOWHERE))).alias("doc")
    rows = docs.select(doc, F.col(column).alias("text")).withColumn("hash", F.xxhash64("text"))
    several = rows.groupBy("doc").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).filter("least <> most")
    several = written(several.select("doc", F.lit(True).alias("several")), "dedup-several")
    copy = F.when(F.col("several"), F.col("hash")).otherwise(F.lit(0).cast("bigint"))
    return rows.join(several, "doc", "left").select("doc", copy.alias("copy"), "text")


def passing(docs: DataFrame, field, wanted: bool) -> DataFrame:
    """Rows (doc, copy, text) whose id is (or is not) in a broadcast ``id_filter``."""

    def one(batches):
        for b in batches:
            mask = pa.array([has(field.value, d) == wanted for d in b.column("doc").to_pylist()], pa.bool_())
            yield b.filter(mask)

    return docs.mapInArrow(lean(one), "doc long, copy long, text string")


def repeated_spans(docs: DataFrame, column: str = "text") -> DataFrame:
    """Paths of every document that repeats something earlier (``PATHS``), written."""
    return spans_of(keyed(docs, column))


def spans_of(src: DataFrame) -> DataFrame:
    """``repeated_spans`` of rows (doc, copy, text)."""
    with temporary() as scope:
        return scope.keep(_repeated_spans(src))


def _repeated_spans(src: DataFrame) -> DataFrame:
    spark = src.sparkSession
    ship_package(spark)
    n = shards(spark)
    marked = repeated_anchors(anchor_rows(src, n), n).groupBy("doc", "copy").agg(F.collect_set("at").alias("ats"))
    marked = written(marked, "dedup-anchors")
    field = spark.sparkContext.broadcast(id_filter(marked, "doc"))
    some = passing(src, field, True).join(marked, ["doc", "copy"]).select("doc", "copy", "text", "ats")
    rows = written(edge_rows(some, n), "dedup-edges")
    names = [f.split()[0] for f in RUNS.split(", ")]
    pieces = bucket_runs(rows.filter("shard IS NOT NULL").select("shard", "kmers", "checks", "docs", "copies", "ats"), n)
    pieces = pieces.unionByName(rows.filter("shard IS NULL").select(*names))
    return written(glued_paths(pieces), "dedup-paths")


def removed_words(n: int, starts, edges) -> np.ndarray:
    """Mask of the words that the paths cover."""
    change = np.zeros(n + 1, np.int64)
    for s, m in zip(starts, edges):
        if s < n:
            change[s] += 1
            change[min(n, s + m + K - 1)] -= 1
    return np.cumsum(change[:n]) > 0


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept_rows(docs: DataFrame) -> DataFrame:
    """Digest of each row (doc, text, starts, edges)."""

    def one(batches):
        for b in sliced(batches):
            out = []
            cols = [b.column("doc").to_pylist(), bytes_column(b, "text"), b.column("starts").to_pylist(), b.column("edges").to_pylist()]
            for doc, text, starts, edges in zip(*cols):
                words = (text or b"").split()
                gone = 0
                kept = words
                if starts:
                    mask = removed_words(len(words), starts, edges)
                    gone = int(mask.sum())
                    kept = [w for w, m in zip(words, mask) if not m]
                out.append((None if doc == NOWHERE else doc, len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield _batch([f.split()[0] for f in RESULT.split(", ")], list(zip(*out)), [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return docs.mapInArrow(lean(one), RESULT)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document after each repeated 20-word window was removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs)


def deduplicated(docs: DataFrame, column: str = "text") -> DataFrame:
    """``RESULT`` for every row of ``docs``."""
    spark = docs.sparkSession
    src = keyed(docs, column)
    paths = spans_of(src).select("doc", "copy", "starts", "edges")
    field = spark.sparkContext.broadcast(id_filter(paths, "doc"))
    none = F.lit(None).cast("array<bigint>")
    clean = passing(src, field, False).select("doc", "text", none.alias("starts"), none.alias("edges"))
    rest = passing(src, field, True).join(paths, ["doc", "copy"], "left").select("doc", "text", "starts", "edges")
    return kept_rows(clean).unionByName(kept_rows(rest))


# Earlier occurrences of each window by a window function over all windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) m
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) n FROM k),
c AS (SELECT DISTINCT doc_id, p + o AS q FROM (SELECT doc_id, p FROM r WHERE n > 1), range(0, 20) t(o)),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) q FROM d),
y AS (SELECT x.doc_id, string_agg(x.w[x.q], ' ' ORDER BY x.q) kept, count(*) n FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.q = x.q WHERE c.q IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(y.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""

"""N-gram Jaccard join by vertical partitioning (operator 4).

Every document is the set of its distinct five-word shingles (64-bit hashes). All
shingles stand in one global order, rare ones first, which is cut into ``FRAGMENTS``
fragments of about equal weight. A pair's intersection is counted fragment by fragment,
each in its own task, and the partial counts are summed per pair.

Steps:

1. One pass gives each document its set's size and class (equal sets share one class, so
   copies are never paired) and counts shingles in ``BUCKETS`` cells; the order of the
   cells by count, then hash, is the global order. It is of fixed size and exact in the
   only thing that matters, that all documents sort by the same order.
2. The first ``n - ceil(0.8 n) + 1`` shingles of each class go to the shingle's list: two
   sets that link share one of them. Lists with one class are dropped.
3. In each list, the class with the least share of shingles of its own before this one is
   the hub, and every other class is paired with it; pairs that meet in several lists are
   counted over the fragments, and links give first components. A group of near copies
   collapses here with about one pair per member.
4. All pairs of a list that are still in *different* components are then paired, subject to
   two exact bounds: the first common shingle of two sets that link stands so early in both
   that what follows it can still make up the overlap, and so can what follows the prefix
   that ends first together with the shingles that both still have in lists. Those not
   counted yet are counted.
   Pairs inside one component cannot change it, so no link between components is lost and
   no group is paired all with all.

Defined results: a document without words (null, blank) has an empty set, links with
nothing and is its own component; fewer than five words are one shingle (their whole
sequence); a null doc_id takes part and never names a component (null only if all
members are null); repeated rows are copies; extra columns are ignored. Two different
shingles or sets are taken for equal with a chance of about ``m^2 / 2^65`` for ``m`` of
them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab.llm.arrays import bytes_column, give_back, has, id_filter, lean, summed_vector, vector_rows, windows, word_hashes
from spanlab.llm.common import table, temporary, written
from spanlab.llm.graph import connected_components
from spanlab.llm.secret_scan import blob_id
from spanlab.session import ship_package

SHINGLE = 5
GROUP = 1 << 17  # bytes of texts that are hashed together
PERCENT = 80
BUCKET_BITS = 22
BUCKETS = 1 << BUCKET_BITS
FRAGMENTS = 4


def shingle_sets(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters in lower case.

    Texts are hashed together, about ``GROUP`` bytes at a time.
    """
    group, size = [], 0
    for text in texts:
        group.append(text or b"")
        size += len(group[-1])
        if size >= GROUP:
            yield from _group_sets(group)
            group, size = [], 0
    yield from _group_sets(group)


def _group_sets(group: list[bytes]) -> Iterator[np.ndarray]:
    h, first = word_hashes(group, GROUP)
    runs = windows(h, SHINGLE)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a < SHINGLE:
            yield windows(h[a:z], z - a, seed=z - a) if a < z else h[:0]
        else:
            yield distinct(runs[a : z - SHINGLE + 1])


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values of a non-empty array."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def set_class(s: np.ndarray) -> int:
    """Signed 64-bit class of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def text_key(text: bytes) -> int:
    """Signed 64-bit key of a whole text."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def buckets_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def set_rows(docs: DataFrame, column: str = "text", mark: str | None = None) -> DataFrame:
    """doc_id, n (set size), cls (class, null if empty), txt (key of the text), and rows of the shingle counts (chunk, cells).

    ``mark``: a binary column that goes along with each row.
    """
    names = ["doc_id", "n", "cls", "txt", "chunk", "cells"] + ([mark] if mark else [])

    def one(batches: Iterator[pa.RecordBatch]):
        counts, once = np.zeros(BUCKETS, dtype=np.int32), np.int32(1)
        for b in batches:
            n, cls, texts = [], [], bytes_column(b, column)
            for s in shingle_sets(texts):
                n.append(len(s))
                cls.append(set_class(s) if len(s) else None)
                np.add.at(counts, buckets_of(s), once)
            rows, txt = len(n), [text_key(x) if k else None for x, k in zip(texts, n)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(txt, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
                + ([b.column(mark)] if mark else []),
                names=names,
            )
        v = vector_rows(counts)
        if v:
            k = len(v)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64())] * 4 + [pa.array([c for c, _ in v], pa.int32()), pa.array([x for _, x in v], pa.binary())]
                + ([pa.nulls(k, pa.binary())] if mark else []),
                names=names,
            )

    marks = [F.col(mark)] if mark else []
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column), *marks)
    return src.mapInArrow(lean(one), "doc_id long, n long, cls long, txt long, chunk int, cells binary" + (f", {mark} binary" if mark else ""))


class Order:
    """The global order: rank of each cell, and the fragment that its shingles fall into."""

    def __init__(self, counts: np.ndarray, fragments: int = FRAGMENTS):
        # count and cell in one number, sorted in place: the driver holds few arrays of this length
        key = counts << BUCKET_BITS
        key |= np.arange(len(key), dtype=np.uint32)
        key.sort()
        cells = len(key) - 1
        self.rank = np.empty(len(key), dtype=np.uint32)
        self.fragment = np.empty(len(key), dtype=np.uint8)
        total, before, part = max(1, int(counts.sum())), 0, 1 << 16
        for at in range(0, len(key), part):
            cell, count = key[at : at + part] & cells, key[at : at + part] >> BUCKET_BITS
            mass = before + np.cumsum(count)
            self.rank[cell] = np.arange(at, at + len(cell), dtype=np.uint32)
            self.fragment[cell] = np.minimum(fragments - 1, ((mass - count / 2) / total * fragments).astype(np.uint8))
            before = int(mass[-1])


def prefix_rows(docs: DataFrame, order, column: str = "text") -> DataFrame:
    """token, cls, n, pos of the prefix of every class (once per task)."""

    def one(batches):
        seen, rank = set(), order.value.rank
        for b in batches:
            out = [[], [], [], []]
            for s in shingle_sets(bytes_column(b, column)):
                n = len(s)
                if not n or (cls := set_class(s)) in seen:
                    continue
                seen.add(cls)
                p = n - (PERCENT * n + 99) // 100 + 1
                # by rank, then hash: the set is sorted, so its places stand for the hashes
                at = rank[buckets_of(s)].astype(np.uint64) << np.uint64(32)
                at |= np.arange(n, dtype=np.uint64)
                at.sort()
                first = (at[:p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                out[0].append(s[first].view(np.int64))
                out[1].append(np.full(p, cls, np.int64))
                out[2].append(np.full(p, n, np.int32))
                out[3].append(np.arange(p, dtype=np.int32))
            if out[0]:
                cols = [pa.array(np.concatenate(c)) for c in out]
                whole = pa.RecordBatch.from_arrays(cols, names=["token", "cls", "n", "pos"])
                for at in range(0, whole.num_rows, 1 << 16):
                    yield whole.slice(at, 1 << 16)

    return docs.select(column).mapInArrow(lean(one), "token long, cls long, n int, pos int")


def segment_rows(docs: DataFrame, wanted, order, column: str = "text") -> DataFrame:
    """cls, f, tokens: the fragments of the texts whose key is in the bit field ``wanted`` (once per task).

    Only those texts are cut into shingles.
    """

    def one(batches):
        seen, fragment, field = set(), order.value.fragment, wanted.value

        def picked(texts):
            for text in texts:
                if text and has(field, key := text_key(text)) and key not in seen:
                    seen.add(key)
                    yield text

        for b in batches:
            out_c, out_f, out_t = [], [], []
            for s in shingle_sets(picked(bytes_column(b, column))):
                if not len(s):
                    continue
                cls, f = set_class(s), fragment[buckets_of(s)]
                for k in np.unique(f):
                    out_c.append(cls)
                    out_f.append(int(k))
                    out_t.append(s[f == k].view(np.int64))
                if len(out_c) >= 4096:
                    yield _segments(out_c, out_f, out_t)
                    out_c, out_f, out_t = [], [], []
            if out_c:
                yield _segments(out_c, out_f, out_t)

    return docs.select(column).mapInArrow(lean(one), "cls long, f int, tokens array<long>")


def _segments(c, f, t) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in t])]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(t)))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(f, pa.int32()), tokens], names=["cls", "f", "tokens"])


def counted_links(pairs: DataFrame, docs: DataFrame, sets: DataFrame, order, column: str = "text") -> DataFrame:
    """The pairs (a, b, na, nb) that link: partial overlaps per fragment, summed per pair.

    Only the classes in ``pairs`` are cut into fragments, each from one of its texts: a bit
    field of fixed size picks those texts in the scan, the join after it is exact.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    ends = written(sets.join(ends, "cls", "left_semi").groupBy("cls").agg(F.min("txt").alias("txt")), "join-classes")
    wanted = spark.sparkContext.broadcast(id_filter(ends, "txt"))
    segments = segment_rows(docs, wanted, order, column).join(ends, "cls", "left_semi")
    segments = written(segments.groupBy("cls", "f").agg(F.first("tokens").alias("tokens")), "join-segments")
    wanted.destroy()
    left = segments.select(F.col("cls").alias("a"), "f", F.col("tokens").alias("ta"))
    right = segments.select(F.col("cls").alias("b"), "f", F.col("tokens").alias("tb"))
    # both joins have the keys of a fragment, so one exchange of the fragments serves both
    parts = pairs.withColumn("f", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))))
    partial = parts.join(left, ["a", "f"]).join(right, ["b", "f"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("part")
    )
    both = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
    linked = both.filter(100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common")))
    return written(linked.select("a", "b"), "join-links")


def may_link(x: str, y: str, before) -> Column:
    """Exact bounds for two rows of one list: sizes, and what can still be common.

    ``before`` bounds the common shingles ahead of this one (0 if it is the first). Common
    shingles up to the end of the prefix that ends first stand in lists of both classes.
    """

    def c(side, name):
        return F.col(f"{side}.{name}")

    def after_prefix(side):
        return F.ceil(PERCENT * c(side, "n") / 100) - 1

    def enough(common):
        return (100 + PERCENT) * common >= PERCENT * (c(x, "n") + c(y, "n"))

    room = before + 1 + F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) - 1
    listed = before + 1 + F.least(c(x, "later"), c(y, "later")) + F.greatest(after_prefix(x), after_prefix(y))
    near = 100 * F.least(c(x, "n"), c(y, "n")) >= PERCENT * F.greatest(c(x, "n"), c(y, "n"))
    return near & enough(room) & enough(listed)


def ordered_pair(x: str, y: str) -> list[Column]:
    """a, b, na, nb of two rows, the lesser class first."""
    swap = F.col(f"{y}.cls") < F.col(f"{x}.cls")

    def pick(name, first, second):
        return F.when(swap, F.col(f"{first}.{name}")).otherwise(F.col(f"{second}.{name}"))

    return [pick("cls", y, x).alias("a"), pick("cls", x, y).alias("b"), pick("n", y, x).alias("na"), pick("n", x, y).alias("nb")]


def labelled_sets(docs: DataFrame, column: str = "text", mark: str | None = None) -> DataFrame:
    """doc_id, n, cls and label (a class of the component) for every row of ``docs``, written.

    ``mark``: a binary column of ``docs`` that the result carries too.
    """
    spark = docs.sparkSession
    ship_package(spark)
    marks = [mark] if mark else []
    both = written(set_rows(docs, column, mark), "join-sets")
    sets = both.filter("chunk IS NULL").select("doc_id", "n", "cls", *marks)
    keys = both.filter("cls IS NOT NULL").select("cls", "txt")
    order = Order(summed_vector(both.filter("chunk IS NOT NULL").select("chunk", "cells"), BUCKETS))
    order = spark.sparkContext.broadcast(order)
    give_back()

    # lists of several classes; of a class that several tasks have sent one row stays: in a list
    # sorted by class the last row of the first class, and the first row of every other
    in_list = Window.partitionBy("token").orderBy("cls")
    prev, after = F.lag("cls").over(in_list), F.lead("cls").over(in_list)
    lists = prefix_rows(docs, order, column).select("*", prev.alias("prev"), after.alias("after"), F.first("cls").over(in_list).alias("least"))
    once = (F.col("prev") != F.col("cls")) | ((F.col("least") == F.col("cls")) & (F.col("after") != F.col("cls")))
    lists = lists.filter(once).select("token", "cls", "n", "pos")
    # shared shingles of a class ahead of this one and behind it: only those can be common to a pair
    ahead = F.row_number().over(Window.partitionBy("cls").orderBy("pos")) - 1
    later = F.count(F.lit(1)).over(Window.partitionBy("cls")).cast("int") - 1 - ahead
    lists = written(lists.select("*", ahead.alias("ahead"), later.alias("later")), "join-ahead")

    item = ["cls", "n", "pos", "ahead", "later"]
    by_own = Window.partitionBy("token").orderBy((F.col("pos") - F.col("ahead")) / F.col("n"), "cls")
    star = lists.withColumn("hub", F.first(F.struct(*item)).over(by_own))
    star = star.select(F.struct(*item).alias("x"), F.col("hub").alias("y"))
    met = star.filter((F.col("x.cls") != F.col("y.cls")) & may_link("x", "y", F.least("x.ahead", "y.ahead")))
    met = met.select(*ordered_pair("x", "y")).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("lists"))
    # what is left out here is paired below
    tested = written(met.filter(4 * F.col("lists") >= 1 + F.least("na", "nb") / 25).drop("lists"), "join-star")
    links = counted_links(tested, docs, keys, order, column)
    first = connected_components(links)

    # lists that still hold several components: their pairs across components
    labelled = lists.drop("ahead").join(first, F.col("cls") == F.col("node"), "left").select(
        "token", "cls", "n", "pos", "later", F.coalesce("component", "cls").alias("comp")
    )
    labelled = written(labelled, "join-labelled")
    split = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    open_lists = labelled.join(split, "token", "left_semi")
    across = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.cls") < F.col("y.cls"))
        & (F.col("x.comp") != F.col("y.comp"))
        & may_link("x", "y", F.lit(0))
    )
    rest = open_lists.alias("x").join(open_lists.alias("y"), across).select(*ordered_pair("x", "y")).distinct()
    rest = written(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "join-rest")
    linked = connected_components(links.unionByName(counted_links(rest, docs, keys, order, column)))

    labels = sets.join(linked, F.col("cls") == F.col("node"), "left").select(
        "doc_id", "n", "cls", F.coalesce("component", "cls").alias("label"), *marks
    )
    labels = written(labels, "join-labels")
    order.destroy()
    return labels


def components(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    with temporary() as scope:
        labels = scope.keep(labelled_sets(docs, column))
    names = labels.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labels.join(names, "label", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least doc_id stays.

    A document is an id with its text: texts that share an id are judged apart (of one id the
    least hash stays), rows that repeat both are one document and stay together. Rows without
    an id come after all ids and are documents of their own, so of equal ones one stays.
    """
    version = F.substring(blob_id(F.col("text")), 1, 16)
    with temporary() as scope:
        labels = scope.keep(labelled_sets(docs.select("doc_id", "text", version.alias("_version")), "text", "_version"))
    labels = labels.filter("label IS NOT NULL").select("label", F.struct(F.isnull("doc_id").alias("last"), "doc_id", "_version").alias("d"))
    least = labels.groupBy("label").agg(F.min("d").alias("least"))
    gone = labels.join(least, "label").filter("d <> least").select(F.col("d.doc_id").alias("_id"), "d._version").distinct()
    # written first, so its size is known when the join is planned: a small list moves no text
    gone = written(gone, "join-gone")
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["_id"]) & (F.substring(blob_id(docs["text"]), 1, 16) == gone["_version"])
    left = docs.join(gone, same, "left_anti").select(*docs.columns)
    # what is left without an id can still repeat a text; texts without words are linked with nothing
    plain = F.col("doc_id").isNotNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row = F.struct(*docs.columns)
    one = left.filter(~plain).groupBy(blob_id(F.col("text"))).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("r")).select("r.*")
    return left.filter(plain).unionByName(one)


# Shingle sets and links stated plainly; components by the least reachable id.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END s FROM w),
t AS (SELECT doc_id, len(s) n, unnest(s) t FROM s),
o AS (SELECT a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

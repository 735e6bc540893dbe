"""Quality classifier by an n-gram language model (operator 2).

An interpolated modified Kneser-Ney model of order two is trained on trusted text
(documents labelled good) and gives every document its perplexity; documents above a
quantile of held-out trusted documents of their language are rejected.

Words are runs between white space, case kept, hashed to ``CLASSES`` word classes, so the
unigram side of the model is a pair of arrays of fixed size and only the bigram counts
grow with the corpus. The bigrams live in shards (the top bits of their mixed key): one
exchange sums the training counts per shard, a second brings every document's bigrams to
the shard that holds their counts, and the partial log-probabilities are summed per
document. For that, the interpolated probability is written as a sum,

    log P(w | v) = log P1(w) + log g(v) + [log P2(w | v) - log P1(w) - log g(v)]

where the bracket is zero for bigrams never seen in training. A hot bigram costs a
document one entry, whatever its count; a shard streams over its documents, so a task
holds the counts of one shard only. There are ``2 ** SHARD_BITS`` shards whatever the
input: with 32-bit bigram keys a shard can never hold more than ``2 ** (32 - SHARD_BITS)``
bigrams, so its memory has a fixed bound and the work per document does not grow with the
corpus.

A fifth of the trusted documents (by hash of the id) is kept out of training and sets the
thresholds. A language whose fifth is too small for the quantile (fewer than 1 / (1 - q)
documents, 200 at 0.995) is cross-fitted: each other fifth of its trusted documents is scored
by a model trained without that fifth, so all of them set the threshold. If they are still
fewer, the language's own quantile counts for ``n`` of these 200 parts and its mean plus the
quantile of all languages' scores about their means for the rest. The score is the mean negative log-probability per word, drawn towards the
language's mean as if ``PRIOR`` more words stood there, so that very short texts are not
rejected for one rare word; perplexity is its exponent without that prior.

Defined results: a document without words (null, blank) has no perplexity and is kept
by the classifier's query flag ``kept`` (nothing speaks against it); a null language is
the stratum ``und``; a language without trusted documents uses the threshold of
all languages together, and without any trusted document nothing is rejected. Rows that
repeat a doc_id are scored as one document by the query, rows with a null doc_id together
under null; the pipeline's stage judges every text by itself. Ties with the threshold are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.arrays import CHUNK, WordHashes, bytes_column, has, id_filter, lean, mix, pack, sliced, summed_vector, unpack, vector_rows
from spanlab.llm.common import table, temporary, written
from spanlab.session import ship_package

CLASS_BITS = 16
CLASSES = 1 << CLASS_BITS
HELD_OUT = 5  # one trusted document of so many sets thresholds
QUANTILE = 0.995
PRIOR = 20
BLOCK_WORDS = 500_000  # words whose bigrams are packed together
MEMO = 150_000  # words whose hash a task remembers
UNKNOWN = "und"
NOWHERE = np.iinfo(np.int64).min  # stands for a null doc_id

# vectors of the model: distinct histories of a class, then per history count, and how many
# followers were seen once, twice, more often; then the numbers of bigrams seen 1..4 times
FOLLOWS, TOTAL, ONCE, TWICE, MORE, COUNTS = range(6)
VECTOR = 5 * CLASSES + 8

SHARD_BITS = 6

REQUEST = "shard int, kind int, block long, keys binary, rows binary, counts binary, ids binary, words binary"
ANSWER = "block long, parts binary, ids binary, words binary"


def classes_of(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    return (hashes.of((text or b"").split()) >> np.uint64(64 - CLASS_BITS)).astype(np.uint64)


def bigram_keys(w: np.ndarray) -> np.ndarray:
    return (w[:-1] << np.uint64(CLASS_BITS)) | w[1:]


# A bijection of 32-bit keys: multiplication by an odd number.
SPREAD, UNSPREAD = 0x9E3779B1, pow(0x9E3779B1, -1, 1 << 32)


def spread(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(SPREAD)) & np.uint64(0xFFFFFFFF)


def unspread(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(UNSPREAD)) & np.uint64(0xFFFFFFFF)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, np.flatnonzero(first))


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


# ---------------------------------------------------------------- training


def training_rows(docs: DataFrame, trusted: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, keys, counts: packed bigrams (spread keys) of the trusted documents.

    A bit field of fixed size leaves out most other documents in the scan; the join on the
    packed rows is exact.
    """
    field = docs.sparkSession.sparkContext.broadcast(id_filter(trusted, "doc_id"))

    def one(batches):
        hashes, bits = WordHashes(MEMO), field.value
        for b in sliced(batches):
            ids, keys, counts = [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), bytes_column(b, column)):
                if i is None or not has(bits, i):
                    continue
                k, c = np.unique(spread(bigram_keys(classes_of(text, hashes))), return_counts=True)
                if len(k):
                    ids.append(i)
                    keys.append(pack(deltas(k.astype(np.uint32))))
                    counts.append(pack(c.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "keys", "counts"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column)).mapInArrow(lean(one), "doc_id long, keys binary, counts binary")
    return rows.join(trusted, "doc_id", "left_semi")


def split_rows(rows: DataFrame, bits: int) -> DataFrame:
    """shard, keys, counts: the rows' bigrams summed within a task and cut into shards."""

    def one(batches):
        keys, counts, held = [], [], 0
        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                keys.append(np.cumsum(unpack(k, np.uint32), dtype=np.uint64))
                counts.append(unpack(c, np.uint32).astype(np.int64))
                held += len(keys[-1])
                if held > 4 * BLOCK_WORDS:
                    yield _cut(*summed(np.concatenate(keys), np.concatenate(counts)), bits)
                    keys, counts, held = [], [], 0
        if keys:
            yield _cut(*summed(np.concatenate(keys), np.concatenate(counts)), bits)

    return rows.select("keys", "counts").mapInArrow(lean(one), "shard int, keys binary, counts binary")


def _cut(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    width = 32 - bits
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width))
    shard, k, c = [], [], []
    for s, (x, y) in enumerate(zip(np.split(keys, edges), np.split(counts, edges))):
        if len(x):
            shard.append(s)
            k.append(pack(deltas((x & np.uint64((1 << width) - 1)).astype(np.uint32))))
            c.append(pack(y.astype(np.uint32)))
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["shard", "keys", "counts"])


def shard_counts(parts: DataFrame, bits: int) -> DataFrame:
    """One row per shard: keys and summed counts, and rows (chunk, cells) of the model's vectors."""

    def one(batches):
        at, keys, counts = None, [], []
        vector = np.zeros(VECTOR, np.int64)

        def done():
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            full = unspread(k | np.uint64(at << (32 - bits)))
            old, new = (full >> np.uint64(CLASS_BITS)).astype(np.int64), (full & np.uint64(CLASSES - 1)).astype(np.int64)
            vector[:CLASSES] += np.bincount(new, minlength=CLASSES)
            vector[CLASSES : 2 * CLASSES] += np.bincount(old, weights=c, minlength=CLASSES).astype(np.int64)
            for j, seen in ((ONCE, c == 1), (TWICE, c == 2), (MORE, c > 2)):
                vector[j * CLASSES : (j + 1) * CLASSES] += np.bincount(old[seen], minlength=CLASSES)
            vector[5 * CLASSES :] += np.bincount(np.minimum(c, 7), minlength=8)
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([pack(deltas(k.astype(np.uint32)))], pa.binary()), pa.array([pack(c.astype(np.uint64))], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())],
                names=["shard", "keys", "counts", "chunk", "cells"],
            )

        for b in batches:
            for s, k, c in zip(b.column("shard").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                if s != at:
                    if keys:
                        yield done()
                    at, keys, counts = s, [], []
                keys.append(np.cumsum(unpack(k, np.uint32), dtype=np.uint64))
                counts.append(unpack(c, np.uint32).astype(np.int64))
                if len(keys) > 64:
                    k, c = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [k], [c]
        if keys:
            yield done()
            v = vector_rows(vector)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(v), pa.int32()), pa.nulls(len(v), pa.binary()), pa.nulls(len(v), pa.binary()), pa.array([x for x, _ in v], pa.int32()), pa.array([x for _, x in v], pa.binary())],
                names=["shard", "keys", "counts", "chunk", "cells"],
            )

    dealt = parts.repartition(1 << bits, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(lean(one), "shard int, keys binary, counts binary, chunk int, cells binary")


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3+ (each within its count)."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5

    def d(k, a, b):
        return min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) if a and b else 0.5 * k

    return np.array([0.0, d(1, n1, n2), d(2, n2, n3), d(3, n3, n4)])


class Model:
    """Arrays of the unigram side: log P1, P1, history totals, log of the back-off mass, discounts."""

    def __init__(self, vector: np.ndarray):
        follows = vector[:CLASSES].astype(float)
        total, once, twice, more = (vector[j * CLASSES : (j + 1) * CLASSES].astype(float) for j in (TOTAL, ONCE, TWICE, MORE))
        seen = vector[5 * CLASSES :]
        self.cut = discounts(*seen[1:5].astype(float))
        of = np.bincount(np.minimum(follows, 5).astype(int), minlength=6).astype(float)
        own = discounts(*of[1:5])
        mass = follows.sum()
        spare = own[np.minimum(follows, 3).astype(int)]
        if mass:
            # interpolated with the uniform distribution over all classes
            self.p1 = (follows - spare) / mass + spare.sum() / mass / CLASSES
        else:
            self.p1 = np.full(CLASSES, 1 / CLASSES)
        self.total = total
        rest = self.cut[1] * once + self.cut[2] * twice + self.cut[3] * more
        self.back = np.where(total > 0, rest / np.maximum(total, 1), 1.0)
        self.log_p1 = np.log(self.p1)
        self.log_back = np.log(self.back)

    def extra(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log P2 - log P1 - log back-off of seen bigrams."""
        old, new = (keys >> np.uint64(CLASS_BITS)).astype(np.int64), (keys & np.uint64(CLASSES - 1)).astype(np.int64)
        kept = (counts - self.cut[np.minimum(counts, 3)]) / self.total[old]
        return np.log(kept + self.back[old] * self.p1[new]) - self.log_p1[new] - self.log_back[old]


def trained(docs: DataFrame, trusted: DataFrame, column: str = "text") -> tuple[DataFrame, Model, int]:
    """Sharded bigram counts (shard, keys, counts), the unigram side, and the shard bits."""
    spark = docs.sparkSession
    ship_package(spark)
    bits = SHARD_BITS
    parts = split_rows(training_rows(docs, trusted, column), bits)
    both = written(shard_counts(parts, bits), "lm-counts")
    model = Model(summed_vector(both.filter("chunk IS NOT NULL").select("chunk", "cells"), VECTOR))
    return both.filter("chunk IS NULL").select("shard", "keys", "counts"), model, bits


# ---------------------------------------------------------------- scoring


def request_rows(docs: DataFrame, model, bits: int, column: str = "text") -> DataFrame:
    """Rows ``REQUEST``: per block of documents and shard its bigrams (kind 1), and the block's
    ids, word counts and unigram part (kind 2, in ``keys``)."""
    width = 32 - bits
    names = [f.split()[0] for f in REQUEST.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]

    def one(batches):
        hashes, m, number = WordHashes(MEMO), model.value, TaskContext.get().partitionId() << 32
        ids, words, held = [], [], 0
        for b in sliced(batches):
            for i, text in zip(b.column("doc_id").to_pylist(), bytes_column(b, column)):
                ids.append(i)
                words.append(classes_of(text, hashes))
                held += len(words[-1])
                if held > BLOCK_WORDS or len(ids) == 1 << 16:
                    yield block(number, ids, words, m)
                    ids, words, held, number = [], [], 0, number + 1
        if ids:
            yield block(number, ids, words, m)

    def block(number, ids, words, m):
        sizes = np.array([len(w) for w in words])
        flat = np.concatenate(words).astype(np.int64)
        row = np.repeat(np.arange(len(words)), sizes)
        follows = np.ones(len(flat), bool)
        follows[np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]] = False
        back = np.zeros(len(flat))
        back[1:] = m.log_back[flat[:-1]]
        base = np.bincount(row, weights=m.log_p1[flat] + np.where(follows, back, 0.0), minlength=len(words))
        at = np.flatnonzero(follows)
        keys = spread((flat[at - 1].astype(np.uint64) << np.uint64(CLASS_BITS)) | flat[at].astype(np.uint64)) if len(at) else np.empty(0, np.uint64)
        pairs, counts = np.unique((keys << np.uint64(16)) | row[at].astype(np.uint64), return_counts=True)
        keys, who = pairs >> np.uint64(16), (pairs & np.uint64(0xFFFF)).astype(np.uint16)
        ids = np.array([NOWHERE if i is None else i for i in ids], dtype=np.int64)
        out = [(number % (1 << bits), 2, number, base.tobytes(), None, None, ids.tobytes(), sizes.astype(np.int64).tobytes())]
        edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width))
        for s, (k, w, c) in enumerate(zip(np.split(keys, edges), np.split(who, edges), np.split(counts, edges))):
            if len(k):
                k = deltas((k & np.uint64((1 << width) - 1)).astype(np.uint32))
                out.append((s, 1, number, pack(k), pack(w), pack(c.astype(np.uint32)), None, None))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column)).mapInArrow(lean(one), REQUEST)


def shard_answers(both: DataFrame, shared, bits: int) -> DataFrame:
    """Rows ``ANSWER``: per block and shard one number per document; blocks' own rows pass by."""
    names = [f.split()[0] for f in ANSWER.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def one(batches):
        m, at, keys, extra = shared.value, None, np.empty(0, np.uint64), np.empty(0)
        for b in batches:
            out = []
            for s, kind, block, k, r, c, ids, words in zip(*[b.column(j).to_pylist() for j in range(8)]):
                if s != at:
                    at, keys, extra = s, np.empty(0, np.uint64), np.empty(0)
                if kind == 0:
                    keys = np.cumsum(unpack(k, np.uint32), dtype=np.uint64)
                    extra = m.extra(unspread(keys | np.uint64(s << (32 - bits))), unpack(c, np.uint64).astype(np.int64))
                elif kind == 2:
                    out.append((block, k, ids, words))
                elif len(keys):
                    asked = np.cumsum(unpack(k, np.uint32), dtype=np.uint64)
                    spot = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    value = np.where(keys[spot] == asked, extra[spot], 0.0) * unpack(c, np.uint32)
                    out.append((block, pack(np.bincount(unpack(r, np.uint16), weights=value).astype(np.float32)), None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    dealt = both.repartition(1 << bits, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(lean(one), ANSWER)


def scores(docs: DataFrame, counts: DataFrame, model: Model, bits: int, column: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob of every document (rows of one doc_id together)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    none = F.lit(None).cast("binary")
    held = counts.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("block"), "keys", none.alias("rows"), "counts", none.alias("ids"), none.alias("words"))
    answers = shard_answers(held.unionByName(request_rows(docs, shared, bits, column)), shared, bits)

    def one(batches):
        sums, heads = {}, {}
        for b in batches:
            for block, parts, ids, words in zip(*[b.column(j).to_pylist() for j in range(4)]):
                if ids is None:
                    part = unpack(parts, np.float32).astype(np.float64)
                else:
                    part = np.frombuffer(parts, np.float64)
                    heads[block] = (np.frombuffer(ids, np.int64), np.frombuffer(words, np.int64))
                old = sums.get(block)
                if old is None or len(old) < len(part):
                    old, part = part.copy(), old
                if part is not None:
                    old[: len(part)] += part
                sums[block] = old
        for block, (ids, words) in heads.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NOWHERE), pa.array(words), pa.array(sums[block])], names=["doc_id", "n_words", "log_prob"]
            )

    rows = answers.repartition("block").mapInArrow(lean(one), "doc_id long, n_words long, log_prob double")
    return rows.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("log_prob").alias("log_prob"))


def needed(quantile: float) -> int:
    """Fewest documents whose empirical quantile is not simply their maximum."""
    return math.ceil(1 / (1 - quantile) - 1e-6)


def cross_scores(docs: DataFrame, trusted: DataFrame, least: int) -> DataFrame | None:
    """lang, n_words, log_prob of the trusted documents in training whose language has fewer
    than ``least`` held-out ones, each by a model trained without its fold (none: None)."""
    few = trusted.groupBy("lang").agg(F.count_if("held_out").alias("held")).filter(F.col("held") < least).select("lang")
    rest = written(trusted.filter("NOT held_out").join(few, "lang", "left_semi").select("doc_id", "fold", "lang"), "lm-few")
    out = None
    for fold in [r["fold"] for r in rest.select("fold").distinct().collect()]:
        with temporary() as scope:
            ids = written(rest.filter(F.col("fold") == fold).select("doc_id", "lang"), "lm-few-fold")
            counts, model, bits = trained(docs, trusted.filter(F.col("fold") != fold).select("doc_id"))
            found = scores(docs.join(ids, "doc_id", "left_semi"), counts, model, bits)
            one = scope.keep(written(found.join(ids, "doc_id").select("lang", "n_words", "log_prob"), "lm-cross"))
        out = one if out is None else out.unionByName(one)
    return out


def smoothed_scores(docs: DataFrame, good: DataFrame, prior: int, quantile: float = QUANTILE) -> tuple[DataFrame, DataFrame]:
    """doc_id, lang, n_words, log_prob, held_out and score of every document; lang and score of
    the documents that set the thresholds. Both written."""
    # one row per id: an id that is labelled good anywhere is trusted
    langs = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.coalesce(F.min("lang"), F.lit(UNKNOWN)).alias("lang"))
    trusted = good.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(langs, "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(HELD_OUT))
    trusted = written(trusted.withColumn("fold", fold).withColumn("held_out", fold == 0), "lm-trusted")
    cross = cross_scores(docs, trusted, needed(quantile))
    counts, model, bits = trained(docs, trusted.filter("NOT held_out").select("doc_id"))
    found = scores(docs, counts, model, bits)
    same = found["doc_id"].eqNullSafe(langs["doc_id"])
    all_ = found.join(langs, same).select(found["doc_id"], "lang", "n_words", "log_prob")
    all_ = all_.join(trusted.filter("held_out").select("doc_id", "held_out"), "doc_id", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    all_ = written(all_, "lm-scores")
    nll = -F.col("log_prob")
    basis = all_.filter("held_out").select("lang", "n_words", "log_prob")
    basis = (basis if cross is None else basis.unionByName(cross)).filter("n_words > 0")
    means = written(basis.groupBy("lang").agg((F.sum(nll) / F.sum("n_words")).alias("mean")), "lm-means")
    whole = basis.agg((F.sum(nll) / F.sum("n_words")).alias("mean")).first()["mean"]
    smooth = (nll + prior * F.coalesce("mean", F.lit(whole))) / (F.col("n_words") + prior)
    scored = written(all_.join(means, "lang", "left").withColumn("score", F.when(F.col("n_words") > 0, smooth)), "lm-smooth")
    return scored, written(basis.join(means, "lang").select("lang", smooth.alias("score")), "lm-basis")


def thresholds(basis: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, threshold: the quantile of ``basis`` (lang, score) per language, drawn towards that
    of all languages about their means where a language has too few documents for its own."""
    least = needed(quantile)

    # by a sketch of bounded size
    def at(x):
        return F.percentile_approx(x, quantile, 10_000)

    own = basis.groupBy("lang").agg(F.count("score").alias("n"), F.avg("score").alias("centre"), at("score").alias("own"))
    pooled = basis.join(own, "lang").agg(at(F.col("score") - F.col("centre")).alias("p")).first()["p"]
    share = F.least(F.col("n"), F.lit(least)) / least
    drawn = F.col("centre") + share * (F.col("own") - F.col("centre")) + (1 - share) * F.lit(pooled).cast("double")
    return own.select("lang", F.when(F.col("n") >= least, F.col("own")).otherwise(drawn).alias("threshold"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    prior: int = PRIOR,
    good: str = "quality",
) -> DataFrame:
    """doc_id, lang, n_words, perplexity, score, threshold, kept: one row per distinct doc_id.

    ``docs`` (doc_id, text, lang), ``labels`` (doc_id, ``good`` = 1 for trusted ones).
    """
    with temporary() as scope:
        scored, basis = smoothed_scores(docs, labels.filter(F.col(good) == 1), prior, quantile)
        scope.keep(scored)
        limits = scope.keep(written(thresholds(basis, quantile), "lm-limits"))
        # for languages without any trusted document
        common = basis.agg(F.percentile_approx("score", quantile, 10_000).alias("t")).first()["t"]
    nll = -F.col("log_prob")
    return scored.join(limits, "lang", "left").select(
        "doc_id",
        "lang",
        "n_words",
        F.when(F.col("n_words") > 0, F.exp(nll / F.col("n_words"))).alias("perplexity"),
        "score",
        F.coalesce("threshold", F.lit(common).cast("double")).alias("threshold"),
    ).withColumn("kept", ~F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))


def op2_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose perplexity is above their language's threshold go.

    A document is an id (or none) with its text, told apart by a 64-bit hash of both: texts
    that share an id are judged apart, and so is every text without an id. A label counts for
    all texts of its id.
    """
    version = F.xxhash64("doc_id", "text")
    labels = table(spark, sf_dir, "labels").join(docs.select("doc_id", version.alias("_version")), "doc_id")
    labels = labels.select(F.col("_version").alias("doc_id"), "quality")
    verdict = classify(docs.select(version.alias("doc_id"), "text", "lang"), labels)
    # written first, so its size is known when the join is planned: a small list moves no text
    gone = written(verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_version")), "lm-gone")
    return docs.join(gone, F.xxhash64(docs["doc_id"], docs["text"]) == gone["_version"], "left_anti").select(*docs.columns)

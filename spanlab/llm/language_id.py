"""Language identification by hierarchical discrimination (operator 5).

A text becomes the counts of its letter bigrams and trigrams (UTF-8, lower case, anything
that is no letter is one space), hashed to ``CELLS`` cells, square-rooted and scaled to
length one. The language *family* is predicted first, then one-versus-one linear support
vector machines separate the languages inside that family. Families come from a parameter
(a language that it does not name is a family of its own).

The machines are trained on a bounded sample: at most ``PER_LANGUAGE`` distinct texts of
each labelled language, those with the least text hash, their whole texts. Every document
is predicted from its whole text; language, source and id are no inputs.

Defined results: a text that is null or has no letter gets ``und`` and score 0; without
any labelled text every document gets ``und`` and 0; with one language it is that one with
score 1. A null language is never learned from; a null doc_id is not held out and not
learned from. Repeated rows are predicted each; empty tables give an empty result; extra
columns are ignored. Ties go to the language that comes first in alphabetical order.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab.llm.arrays import bytes_column
from spanlab.llm.common import table
from spanlab.session import ship_package

CELLS = 1 << 12
PER_LANGUAGE = 600
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"

# Families of the more common languages (ISO 639-1).
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "uralic": ["et", "fi", "hu"],
}

LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: bytes | None) -> np.ndarray | None:
    """Unit vector of a text, None without a letter."""
    if not text:
        return None
    low = text.decode("utf-8", "replace").lower()
    if not LETTER.search(low):
        return None
    clean = b" " + b" ".join(low.encode().translate(NOT_LETTERS).split()) + b" "
    b = np.frombuffer(clean, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - CELLS.bit_length() + 1)
    counts = np.bincount(two >> shift, minlength=CELLS) + np.bincount(three >> shift, minlength=CELLS)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Linear support vector machine (dual coordinate descent, squared hinge); the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    diagonal = (x * x).sum(axis=1) + 0.5 / c
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - slope / diagonal[i])
            if new != alpha[i]:
                largest = max(largest, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if largest < 1e-4:
            break
    return w


class Pairwise:
    """One-versus-one machines over some classes: votes, ties by the sum of margins."""

    def __init__(self, x: np.ndarray, names: list[str]):
        self.classes = sorted(set(names))
        names = np.array(names)
        self.pairs, rows = [], []
        for i, a in enumerate(self.classes):
            for j in range(i + 1, len(self.classes)):
                b = self.classes[j]
                used = (names == a) | (names == b)
                self.pairs.append((i, j))
                rows.append(svm(x[used], np.where(names[used] == a, 1.0, -1.0)))
        self.w = np.array(rows) if rows else np.zeros((0, x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Class and a score in 0..1: the least logistic of its margins against the others."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margins = self.w[:, :-1] @ x + self.w[:, -1]
        votes, sums, least = np.zeros(len(self.classes)), np.zeros(len(self.classes)), np.full(len(self.classes), np.inf)
        for (i, j), m in zip(self.pairs, margins):
            votes[i if m >= 0 else j] += 1
            sums[i] += np.tanh(m)
            sums[j] -= np.tanh(m)
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = int(np.lexsort((-np.arange(len(votes)), sums, votes))[-1])
        return self.classes[best], float(1 / (1 + np.exp(-3 * least[best])))


class Identifier:
    """Family machines, then the machines of the family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, list[str]]):
        family_of = {lang: f for f, members in families.items() for lang in members}
        names = [family_of.get(lang, lang) for lang in langs]
        self.family = Pairwise(x, names) if langs else None
        self.inside = {}
        for f in sorted(set(names)):
            used = [i for i, n in enumerate(names) if n == f]
            self.inside[f] = Pairwise(x[used], [langs[i] for i in used])

    def predict(self, text: bytes | None) -> tuple[str, float]:
        x = features(text)
        if x is None or self.family is None:
            return UNKNOWN, 0.0
        family, p = self.family.predict(x)
        lang, q = self.inside[family].predict(x)
        return lang, p * q


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Feature rows and languages of the bounded sample of ``labelled`` (text, lang)."""
    hashed = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("text"))
    # distinct texts per language tell how far down the hash range twice the sample lies
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return np.zeros((0, CELLS), np.float32), []
    limit = F.lit(None).cast("bigint")
    for lang, n in sorted(sizes.items()):
        share = min(1.0, 2.0 * per_language / n)
        limit = F.when(F.col("lang") == lang, F.lit(int(-(1 << 63) + share * ((1 << 64) - 2048)) if share < 1 else (1 << 63) - 1)).otherwise(limit)
    few = hashed.filter(F.col("h") <= limit).groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = few.withColumn("r", rank).filter(F.col("r") <= per_language)

    def one(batches):
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), bytes_column(b, "text")):
                x = features(text)
                if x is not None:
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "x": pa.array([x.tobytes()], pa.binary())})

    rows = sorted(few.select("lang", "text").mapInArrow(one, "lang string, x binary").collect(), key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]).reshape(len(rows), CELLS)
    return x, [r["lang"] for r in rows]


def identify(docs: DataFrame, families: dict[str, list[str]] = FAMILIES, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    ship_package(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    x, langs = training_sample(docs.filter(fold != HELD_OUT).select("text", "lang"), per_language)
    shared = spark.sparkContext.broadcast(Identifier(x, langs, families))

    def one(batches):
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in bytes_column(b, "text")]
            cols = [b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return src.mapInArrow(one, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))

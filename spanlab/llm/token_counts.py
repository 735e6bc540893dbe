"""Token counts by a map-side two-tier lookup (operator 12).

Counting needs no token ids, only how many ids each pre-token gives, and no pre-token is
shuffled to find that out:

1. Every task counts the pre-tokens of its part of the corpus with a bounded summary
   (lossy counting: past ``SUMMARY_LIMIT`` keys the rare half goes) and keeps its
   ``SUMMARY`` most frequent as one packed row. The rows are merged ``FAN_IN`` at a time
   until one is left, which holds at most ``ENTRIES`` pre-tokens.
2. That table (pre-token and length, packed) is broadcast. Its size is bounded by
   ``ENTRIES`` and ``LONGEST`` and does not grow with the corpus. It decides only how
   fast a length is found, never the length.
3. The second tier is a cache in each Python worker: a pre-token that is not in the table
   is encoded by the library once and remembered; the cache has two generations of at
   most ``CACHE`` pre-tokens, of which the older goes when the younger is full. Pre-tokens
   above ``LONGEST`` characters are encoded each time and never remembered.

A pre-token is a run of spaces with the characters up to the next space. The vocabulary
marks a space by U+2581 and has no piece in which that mark follows another character
(checked when it is loaded), so no merge crosses the start of a pre-token and the lengths
add up to the library's count of the whole text. A U+2581 in a text is the same symbol.

Defined results: a null text is the empty text with no tokens; rows that repeat a doc_id
and null doc_ids are counted each on their own; an empty table gives an empty result;
extra columns are ignored. Strings like ``</s>`` in a text are ordinary text, as the
library's default has it. Texts are counted whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import table, temporary, written
from spanlab.session import ship_package

LIMIT = 4096  # tokens; longer documents are marked
ENTRIES = 65_536  # pre-tokens of the broadcast table
SUMMARY = 8_192  # pre-tokens that a task reports
SUMMARY_LIMIT = 300_000  # pre-tokens that a task counts at a time
FAN_IN = 64  # summaries that one task merges
CACHE = 200_000  # pre-tokens in a generation of a worker's cache
LONGEST = 64  # characters of a pre-token that table and cache hold

MARK = "▁"  # fixed value: the vocabulary's space
RUN = re.compile(" ( *[^ ]*)")
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def default_tokenizer() -> str:
    """Path of the public sentence-piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space (the library puts one before a text)."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return RUN.findall(" " + text)
    return text.split(" ")


class Pieces:
    """The library's processor and the lengths of single pre-tokens."""

    held: dict[str, "Pieces"] = {}  # one per vocabulary and Python worker

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.processor.get_piece_size()):
            if MARK in self.processor.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece of this vocabulary crosses the start of a word")
        # a lone space at the end of a text: the library adds none before an empty text
        self.lone = len(self.processor.encode("a ")) - len(self.processor.encode("a"))

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def lengths(self, keys: list[str]) -> list[int]:
        return [len(ids) if key else self.lone for key, ids in zip(keys, self.processor.encode(keys, num_threads=1))]


class Lengths(dict):
    """Both tiers: the table, which stays, and the younger generation of the cache.

    A lookup is one dictionary access; ``__missing__`` asks the older generation.
    """

    held: dict[tuple, "Lengths"] = {}  # one per vocabulary, table and Python worker

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.pieces, self.frequent, self.old = Pieces.of(path), frequent, {}

    @classmethod
    def of(cls, path: str, packed: bytes) -> "Lengths":
        key = (path, hash(packed))
        if key not in cls.held:
            cls.held.clear()
            cls.held[key] = cls(path, dict(unpack_table(packed)))
        return cls.held[key]

    def learn(self, keys: Iterable[str]) -> None:
        """Remember the lengths of the keys that neither tier holds, encoded in one call."""
        new = []
        for key in keys:
            if len(key) <= LONGEST:
                if key in self.old:
                    self[key] = self.old[key]
                else:
                    new.append(key)
        self.update(zip(new, self.pieces.lengths(new)))

    def turn(self) -> None:
        """Past the limit the younger generation becomes the older one."""
        if len(self) - len(self.frequent) > CACHE:
            self.old = dict(self)
            self.clear()
            self.update(self.frequent)

    def __missing__(self, key: str) -> int:
        return self.pieces.lengths([key])[0]  # too long to remember

    def count(self, texts: list[str]) -> list[int]:
        split = [pretokens(t) for t in texts]
        self.learn({k for keys in split for k in keys if k not in self})
        out = [sum(map(self.__getitem__, keys)) for keys in split]
        self.turn()
        return out


# ---------------------------------------------------------------- the frequent table


def pack_table(rows: list[tuple[str, int]]) -> bytes:
    """(pre-token, number) rows as compressed bytes; pre-tokens hold no space but at their start."""
    text = "\x00".join(f"{n} {key}" for key, n in rows)
    return zstandard.ZstdCompressor(level=3).compress(text.encode())


def unpack_table(packed: bytes) -> Iterable[tuple[str, int]]:
    text = zstandard.ZstdDecompressor().decompress(packed).decode()
    for row in text.split("\x00") if text else []:
        n, key = row.split(" ", 1)
        yield key, int(n)


def pruned(counts: Counter, keep: int) -> Counter:
    """The ``keep`` most frequent, ties by pre-token, so every run keeps the same."""
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep]))


def summaries(docs: DataFrame, column: str) -> DataFrame:
    """One row per task: its most frequent pre-tokens."""

    def rows(batches):
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(pretokens(text or ""))
                if len(counts) > SUMMARY_LIMIT:
                    counts = pruned(counts, SUMMARY_LIMIT // 2)
        # a pre-token with the row mark or too long stays with the second tier
        short = Counter({k: n for k, n in counts.items() if len(k) <= LONGEST and "\x00" not in k})
        packed = pack_table(list(pruned(short, SUMMARY).items()))
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["top"])

    return docs.select(column).mapInArrow(rows, "top binary").select(F.spark_partition_id().alias("task"), "top")


def merged(rows: DataFrame) -> DataFrame:
    """One summary out of each ``FAN_IN`` neighbours."""

    def add(batches):
        totals: dict[int, Counter] = {}
        for b in batches:
            for task, top in zip(b.column("task").to_pylist(), b.column("top").to_pylist()):
                sums = totals.setdefault(task, Counter())
                for key, n in unpack_table(top):
                    sums[key] += n
                if len(sums) > SUMMARY_LIMIT:
                    totals[task] = pruned(sums, SUMMARY_LIMIT // 2)
        for task, sums in totals.items():
            packed = pack_table(list(pruned(sums, ENTRIES).items()))
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([packed], pa.binary())], names=["task", "top"])

    group = F.floor(F.col("task") / FAN_IN).cast("int")
    return rows.select(group.alias("task"), "top").repartition("task").mapInArrow(add, "task int, top binary")


def frequent_table(docs: DataFrame, tokenizer: str, column: str = "text") -> bytes:
    """Packed (pre-token, length) rows of the corpus's most frequent pre-tokens."""
    with temporary():
        rows = written(summaries(docs, column), "token-summaries")
        left = rows.agg(F.max("task")).first()[0]
        while left:
            rows = written(merged(rows), "token-summaries")
            left //= FAN_IN
        one = rows.first()
        keys = [k for k, _ in unpack_table(bytes(one["top"]))] if one else []
    return pack_table(list(zip(keys, Pieces.of(tokenizer).lengths(keys))))


def token_counts(docs: DataFrame, tokenizer: str | None = None, column: str = "text", limit: int = LIMIT) -> DataFrame:
    """``COUNTS`` of every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    path = tokenizer or default_tokenizer()
    shared = spark.sparkContext.broadcast(frequent_table(docs, path, column))

    def rows(batches):
        lengths = Lengths.of(path, shared.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [c for at in range(0, len(texts), 256) for c in lengths.count(texts[at : at + 256])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[c.split()[0] for c in COUNTS.split(", ")],
            )

    src = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(column).alias("text"),
    )
    return src.mapInArrow(rows, COUNTS)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))

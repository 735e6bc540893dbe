"""Packing by non-negative least squares (operator 8).

Documents (token ids and an end id) become sequences of at most ``WINDOW`` ids:

1. Tokenise each document once; whole windows of it are sequences of their own. What is
   left is cut into a *main* piece, a multiple of ``UNIT`` ids, and a *tail* below a unit.
2. The mains' lengths form a histogram of ``WINDOW / UNIT - 1`` bins. All combinations of
   at most ``DEPTH`` bins that fill a window exactly are enumerated, non-negative least
   squares finds how often to use each to match the histogram, the counts are rounded
   down to what the histogram holds, and what remains is offered to the combinations
   once more greedily.
3. Residuals (tails and mains without a place) are packed greedily into windows, cut where
   a window is full. The last, partly filled window is split at powers of two, which need
   no padding. So no sequence is padded at all.

The histogram and its solution have fixed size and are the only thing on the driver. A
piece finds its sequence in closed form from its rank in its bin; ranks come from counts
per written partition (one row each) and a running number inside it, so nothing is sorted
globally. Token ids are written once in the shared folder, packed.

Defined results: a null text is empty and still has its end id; repeated rows and null
doc_ids are packed each on their own; an empty table gives no pieces; extra columns are
ignored. Special-token strings in a text are what the tokenizer makes of them.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab.llm.arrays import kept, lean, pack, unpack
from spanlab.llm.common import table, written
from spanlab.session import ship_package

WINDOW = 2048
UNIT = 64
DEPTH = 4
END = 1
MEMO = 200_000  # words, and pre-tokens, in a generation of what a Python worker remembers
GROUP_BYTES = 1 << 20  # of texts that are split into words at a time
LINE = 2000  # pre-tokens that the tokenizer gets at a time
# The vocabulary's mark of a word's end, and its split, for characters that are letters, digits 0-9 or signs
# in every Unicode version and that composition and lower case map one to one.
WORD_END = "</w>"
PRE_TOKEN = re.compile(r"\x20|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\w\s]+(?:_|[^\w\s])*|_(?:_|[^\w\s])*")
PLAIN = "!-~À-ÖØ-öø-įı-ňŊ-ž"
NOT_PLAIN = re.compile(f"[^ ]*[^ {PLAIN}][^ ]*")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    """Path of the public word-level byte-pair vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Generation:
    """Ids of words (or pre-tokens) as flat arrays: ``flat[first[i] : first[i] + size[i]]`` for number i."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.uint16)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def find(self, keys: list[str]) -> np.ndarray:
        """Number of each key, -1 for those not held."""
        return np.fromiter(map(self.index.get, keys, itertools.repeat(-1)), np.int64, len(keys))

    def add(self, keys: list[str], flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The new keys' numbers."""
        first, held = len(self.flat) + np.cumsum(size) - size, len(self.size)
        self.index.update(zip(keys, range(held, held + len(keys))))
        self.flat = np.concatenate([self.flat, flat])
        self.first = np.concatenate([self.first, first])
        self.size = np.concatenate([self.size, size])
        return np.arange(held, held + len(keys))

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbers one after the other, and how many each has."""
        n = self.size[k]
        ends = np.cumsum(n)
        at = np.repeat(self.first[k] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], n


class Memory:
    """What ``make`` gives for a list of keys, remembered in two generations of ``MEMO`` keys.

    ``make`` returns the ids of all keys one after the other and how many each has. The
    older generation goes when the younger is full, so frequent keys stay.
    """

    def __init__(self, make):
        self.make = make
        self.young, self.old = Generation(), Generation()

    def age(self) -> None:
        """Between groups only: the numbers given out are those of the younger generation."""
        if len(self.young.index) > MEMO:
            self.young, self.old = Generation(), self.young

    def numbers(self, keys: list[str]) -> np.ndarray:
        """Numbers in the younger generation of distinct keys; what it does not hold is made."""
        k = self.young.find(keys)
        new = np.flatnonzero(k < 0)
        if len(new):
            names = [keys[i] for i in new.tolist()]
            older = self.old.find(names)
            known, other = np.flatnonzero(older >= 0), np.flatnonzero(older < 0)
            k[new[known]] = self.young.add([names[i] for i in known.tolist()], *self.old.take(older[known]))
            if len(other):
                names = [names[i] for i in other.tolist()]
                k[new[other]] = self.young.add(names, *self.make(names))
        return k


class WordIds:
    """Ids of texts, word by word: white space always ends a token in this vocabulary.

    Words are runs between ASCII white space; a word's ids do not depend on its neighbours,
    so a text is put together from remembered words. Arrow splits the texts of a group and
    numbers their distinct words, so only those become Python strings. A word that is not
    remembered is made of its pre-tokens, which are fewer: case is folded and punctuation
    cut off before the vocabulary's merges begin, so each lower-cased pre-token goes through
    the tokenizer once. That holds for words of ``PLAIN`` characters, which normalisation
    maps one by one; any other word goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.parts = Memory(self.word_ids), Memory(self.part_ids)
        # the last id of a pre-token is one that ends a word
        self.last = np.zeros(1 << 16, bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True

    def tokenized(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint16, int(size.sum())), size

    def part_ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens; they are encoded in long lines, and the ids tell where each ends."""
        # the library's encodings are large objects: one line's at a time
        lines = (" ".join(new[i : i + LINE]) for i in range(0, len(new), LINE))
        flat = np.concatenate([np.empty(0, np.uint16), *(self.tokenized([line])[0] for line in lines)])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(new):
            raise ValueError("the vocabulary does not mark the end of each pre-token")
        return flat, np.diff(ends, prepend=0)

    def word_ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words."""
        line = " ".join(new)
        other = set(NOT_PLAIN.findall(line))
        if "<|" in line:
            other.update(t for t in new if "<|" in t)  # may be a special token
        plain = np.array([t not in other for t in new], bool) if other else np.ones(len(new), bool)
        # pre-tokens of all plain words in one go; a space ends each word
        tokens = PRE_TOKEN.findall(" ".join(itertools.compress(new, plain)).lower())
        distinct = list(set(tokens).difference(" "))
        self.parts.numbers(distinct)
        k = self.parts.young.find(tokens)  # -1 for the spaces
        flat, n = self.parts.young.take(k[k >= 0])
        size = np.zeros(len(new), np.int64)
        size[plain] = np.bincount(np.cumsum(k < 0)[k >= 0], weights=n, minlength=int(plain.sum()))[: plain.sum()]
        if plain.all():
            return flat, size
        whole, size[~plain] = self.tokenized(list(itertools.compress(new, ~plain)))
        ids = np.empty(int(size.sum()), np.uint16)
        from_plain = np.repeat(plain, size)
        ids[from_plain], ids[~from_plain] = flat, whole
        return ids, size

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """uint16 ids of each text."""
        self.words.age()
        self.parts.age()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        found = split.flatten().dictionary_encode()
        # no word holds a space, so all of them become strings in one go
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary), " ")
        words = line.cast(pa.binary())[0].as_py().decode("utf-8", "replace").split(" ")
        k = self.words.numbers(words if len(found.dictionary) else [])
        ids, n = self.words.young.take(k[found.indices.to_numpy()])
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()  # words before each text
        before = np.concatenate([[0], np.cumsum(n)])[edges]  # ids before each text
        return [ids[a:b] for a, b in zip(before[:-1], before[1:])]


def groups(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``GROUP_BYTES`` of text (a longer text alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > GROUP_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if sizes:
        yield batch.slice(first)


def token_rows(docs: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """Tokens of each document with its running numbers in its partition.

    part, doc_id, n (ids with the end id), ids (packed uint16), unit (bin of the main
    piece), rank (documents of that bin before it in the partition), wholes and tails
    (whole windows and tail ids before it).
    """

    name = f"words of {tokenizer}"

    def one(batches):
        words, part = kept(name, lambda: WordIds(tokenizer)), TaskContext.get().partitionId()
        seen, wholes, tails = np.zeros(WINDOW // UNIT, np.int64), 0, 0
        for batch in batches:
            for b in groups(batch, column):
                rows = []
                for doc, ids in zip(b.column("doc_id").to_pylist(), words.encode(b.column(column))):
                    ids = np.append(ids, np.uint16(END))
                    unit = len(ids) % WINDOW // UNIT
                    rows.append((part, doc, len(ids), pack(ids), unit, int(seen[unit]), wholes, tails))
                    seen[unit] += 1
                    wholes += len(ids) // WINDOW
                    tails += len(ids) % UNIT
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["part", "doc_id", "n", "ids", "unit", "rank", "wholes", "tails"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column))
    return src.mapInArrow(lean(one, name), "part int, doc_id long, n long, ids binary, unit int, rank long, wholes long, tails long")


# ---------------------------------------------------------------- the plan


def combinations(total: int = WINDOW // UNIT, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of at least two and at most ``depth`` lengths below ``total`` that add up to it."""

    def parts(rest: int, most: int, left: int):
        if rest == 0:
            yield ()
        elif left:
            for x in range(min(rest, most), 0, -1):
                for more in parts(rest - x, x, left - 1):
                    yield (x, *more)

    return list(parts(total, total - 1, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Least squares with non-negative unknowns (active sets: grow by the steepest, shrink at zero)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[j] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            low = free & (z <= 0)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


class Plan:
    """How often each combination is used, and the place of the q-th piece of each bin."""

    def __init__(self, histogram: np.ndarray, wholes: int, tails: int):
        bins = WINDOW // UNIT
        self.sets = combinations()
        use = np.zeros((bins, len(self.sets)))
        for j, s in enumerate(self.sets):
            for u in s:
                use[u, j] += 1
        h = histogram.astype(np.int64).copy()
        h[0] = 0
        solved = np.floor(nnls(use[1:], h[1:].astype(float)) + 1e-6).astype(np.int64)
        left, self.times = h.copy(), np.zeros(len(self.sets), np.int64)
        # rounded counts as far as the histogram goes, often used combinations first; then the rest greedily
        for wish in (solved, np.full(len(self.sets), np.iinfo(np.int64).max // 4)):
            for j in np.argsort(-solved, kind="stable"):
                need = use[:, j].astype(np.int64)
                k = min(int(wish[j]), int((left[need > 0] // need[need > 0]).min()))
                self.times[j] += k
                left -= k * need
        self.left, self.used = left, h - left
        self.first = wholes + np.cumsum(self.times) - self.times  # sequence of each combination's first use
        # per bin: combinations that hold it, their multiplicity, and where their places begin
        self.places = []
        for u in range(bins):
            rows = [(j, s.count(u), UNIT * sum(x for x in s if x > u)) for j, s in enumerate(self.sets) if u in s and self.times[j]]
            ends = np.cumsum([self.times[j] * m for j, m, _ in rows])
            self.places.append((rows, ends))
        self.stream = wholes + int(self.times.sum())  # first sequence of the residual stream
        self.base = tails + UNIT * (np.cumsum(self.left * np.arange(bins)) - self.left * np.arange(bins))
        self.length = tails + UNIT * int((self.left * np.arange(bins)).sum())
        rest = self.length % WINDOW
        powers = [1 << k for k in range(WINDOW.bit_length(), -1, -1) if rest >> k & 1]
        self.last = self.length - rest  # from here on sequences are powers of two
        self.edges = self.last + np.cumsum([0, *powers])

    def place(self, u: int, q: int) -> tuple[int, int] | None:
        """(sequence, offset) of the q-th main piece of bin ``u``; None for the residual stream."""
        if q >= self.used[u]:
            return None
        rows, ends = self.places[u]
        i = int(np.searchsorted(ends, q, side="right"))
        j, m, offset = rows[i]
        q -= int(ends[i - 1]) if i else 0
        return int(self.first[j]) + q // m, offset + UNIT * u * (q % m)

    def cuts(self, at: int, length: int):
        """(sequence, offset, length) of the stream's pieces from ``at`` on."""
        while length:
            if at < self.last:
                seq, begin, end = at // WINDOW, at // WINDOW * WINDOW, at // WINDOW * WINDOW + WINDOW
            else:
                k = int(np.searchsorted(self.edges, at, side="right")) - 1
                seq, begin, end = self.last // WINDOW + k, int(self.edges[k]), int(self.edges[k + 1])
            n = min(length, end - at)
            yield self.stream + seq, at - begin, n
            at, length = at + n, length - n


def packed(docs: DataFrame, tokenizer: str | None = None, column: str = "text") -> DataFrame:
    """One row per piece (``PIECES``)."""
    spark = docs.sparkSession
    ship_package(spark)
    tokens = written(token_rows(docs, tokenizer or default_tokenizer(), column), "pack-tokens")
    # one row per written partition: documents per bin, whole windows, tail ids
    whole, tail = F.floor(F.col("n") / WINDOW).cast("bigint"), F.pmod("n", F.lit(UNIT))
    bins = WINDOW // UNIT
    counts = tokens.groupBy("part").agg(
        *[F.count_if(F.col("unit") == u).alias(f"c{u}") for u in range(bins)],
        F.sum(whole).alias("wholes_in"),
        F.sum(tail).alias("tails_in"),
    )
    names = [*[f"c{u}" for u in range(bins)], "wholes_in", "tails_in"]
    counts = written(counts, "pack-counts")
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    plan = Plan(np.array(total[:bins]), total["wholes_in"], total["tails_in"])
    shared = spark.sparkContext.broadcast(plan)
    # running totals over partitions: as many rows as partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.array(*[F.coalesce(F.sum(c).over(before), F.lit(0)) for c in names]).alias("before"))

    def one(batches):
        p = shared.value
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "unit", "rank", "wholes", "tails")]
            for doc, n, ids, unit, rank, wholes, tails, base in zip(*cols, b.column("before").to_pylist()):
                ids = unpack(ids, np.uint16).astype("<u4")
                pieces = [(k * WINDOW, WINDOW, base[bins] + wholes + k, 0) for k in range(n // WINDOW)]
                at, main = n // WINDOW * WINDOW, unit * UNIT
                q = base[unit] + rank
                if main:
                    spot = p.place(unit, q)
                    if spot:
                        pieces.append((at, main, *spot))
                    else:
                        start = at
                        for seq, offset, size in p.cuts(int(p.base[unit]) + (q - int(p.used[unit])) * main, main):
                            pieces.append((start, size, seq, offset))
                            start += size
                start = at + main
                for seq, offset, size in p.cuts(base[bins + 1] + tails, n % UNIT):
                    pieces.append((start, size, seq, offset))
                    start += size
                out += [(doc, s, size, zlib.crc32(ids[s : s + size].tobytes()), n, seq, offset) for s, size, seq, offset in pieces]
            if out:
                names = [c.split()[0] for c in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    return tokens.join(offsets, "part").select("doc_id", "n", "ids", "unit", "rank", "wholes", "tails", "before").mapInArrow(lean(one), PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows."""
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the kept documents."""
    return packed(docs.select("doc_id", "text"))

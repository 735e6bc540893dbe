"""Numpy helpers used inside tasks: word hashing, packed arrays, summed vectors."""

from __future__ import annotations

import ctypes
import gc
import re
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16  # cells of one vector chunk
MEMO = 500_000  # words whose hash a task remembers

STEP = np.uint64(0x9E3779B97F4A7C15)
OTHER_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for the first ``most`` words of a task."""

    def __init__(self, most: int = MEMO):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, k: int, seed: int = 0, step: np.uint64 = STEP) -> np.ndarray:
    """Hash of every run of ``k`` word hashes (empty when there are fewer); another ``step``
    gives an independent hash."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.full(n, seed, dtype=np.uint64)
    for j in range(k):
        acc = acc * step + h[j : j + n]
    return mix(acc)


BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, ASCII letters in lower case, and each text's first word
    (and the number of words as the last).

    A word is the sum of one pseudo-random number per byte and place in the word, so two words
    are equal by chance only. Texts far above ``size`` bytes are hashed in parts.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * size:
        h, at = [], 0
        while at < len(texts[0]):
            cut = BLANK.search(texts[0], at + size)
            to = cut.end() if cut else len(texts[0])
            h.append(word_hashes([texts[0][at:to]], to - at)[0])
            at = to
        h = np.concatenate(h)
        return h, np.array([0, len(h)])
    data = np.frombuffer(b"".join(texts).lower(), np.uint8)
    edges = np.cumsum([0, *map(len, texts)])
    letter = (data - np.uint8(9) > 4) & (data != 32)
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    inner = edges[edges < len(data)]
    start[inner] = letter[inner]  # words end with their text
    at = np.flatnonzero(start)
    first = np.searchsorted(at, edges)
    if not len(at):
        return np.empty(0, dtype=np.uint64), first
    # from the first word on: place in the word and byte, spread; blanks behind a word add nothing
    data, letter, at = data[at[0] :], letter[at[0] :], at - at[0]
    code = np.arange(len(data), dtype=np.uint64)
    code -= np.repeat(at.astype(np.uint64), np.diff(at, append=len(data)))
    code <<= np.uint64(8)
    code |= data
    code += np.uint64(1)
    code *= STEP
    code = mix(code)
    code *= letter
    return np.add.reduceat(code, at), first


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of an integer array (byte planes, then zstd)."""
    size = x.dtype.itemsize
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, size).T) if len(x) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def sliced(batches, rows: int = 512):
    """Arrow batches cut into small ones without a copy, so that only a few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


KEPT: dict[str, object] = {}  # what this Python worker keeps between tasks of one kind


def kept(name: str, make):
    """The worker's object of that name, made at its first use."""
    if name not in KEPT:
        KEPT[name] = make()
    return KEPT[name]


def forget(but: str) -> None:
    """Drop what tasks of another kind kept."""
    for name in KEPT.keys() - {but}:
        del KEPT[name]


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def lean(fn, keep: str = ""):
    """``fn`` for ``mapInArrow`` that leaves its worker small.

    Spark reuses Python workers: an idle one would hold what its last task needed most
    beside the tasks of other stages and the JVM. Of what tasks kept, only ``keep`` stays.
    """

    @wraps(fn)
    def run(batches):
        forget(keep)
        yield from fn(batches)
        give_back()

    return run


def bytes_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def vector_rows(vector: np.ndarray) -> list[tuple[int, bytes]]:
    """``(chunk, cells)`` rows of a vector of counts, without its empty chunks."""
    out = []
    for c in range(0, len(vector), CHUNK):
        part = vector[c : c + CHUNK].astype(np.int64)
        if part.any():
            out.append((c // CHUNK, pack(part)))
    return out


def summed_vector(rows: DataFrame, length: int) -> np.ndarray:
    """Sum of all vectors in ``rows`` (chunk int, cells binary), ``length`` cells, to the driver.

    Each chunk is summed in a task that streams over its rows; the driver receives
    ``length`` counts, which is a parameter and does not grow with the input.
    """

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, cells in zip(b.column("chunk").to_pylist(), b.column("cells").to_pylist()):
                part = unpack(cells, np.int64)
                if c in sums:
                    sums[c][: len(part)] += part
                else:
                    sums[c] = np.concatenate([part, np.zeros(CHUNK - len(part), np.int64)])
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array(list(sums), pa.int32()), "cells": pa.array([pack(v) for v in sums.values()], pa.binary())}
        )

    chunks = max(1, -(-length // CHUNK))
    total = np.zeros(chunks * CHUNK, dtype=np.int64)
    # a first sum within each partition keeps the exchange at partitions x chunks rows
    summed = rows.repartition(max(1, chunks // 4), F.col("chunk")).mapInArrow(lean(add), "chunk int, cells binary")
    for r in summed.collect():
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += unpack(bytes(r["cells"]), np.int64)
    return total[:length]


FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bit field of ``FILTER_BITS`` bits with a bit set for each id (a one-hash Bloom filter).

    Of fixed size (8 MB) whatever the number of ids; who uses it must check its hits.
    """
    # Spark's bitmap functions count positions from 1
    spots = ids.select((F.xxhash64(column).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("spot"))
    cells = spots.groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")
    )
    width = 4096
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in cells.collect():
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["bucket"] - 1) * width : (r["bucket"] - 1) * width + len(bits)] = bits
    return out


def has(field: np.ndarray, value: int) -> bool:
    """Whether a long may be in an ``id_filter`` (Spark's xxhash64 of it, seed 42)."""
    spot = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed=42) & (FILTER_BITS - 1)
    return bool(field[spot >> 3] >> (spot & 7) & 1)

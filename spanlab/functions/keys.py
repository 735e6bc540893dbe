"""Seeded, partition-independent keys.

Every random choice in the library is a function of ``md5(seed ':' parts…)``, so a
result does not depend on partitioning, task retries or executor loss, and an SQL
engine with ``md5`` can replay it. ``rand()`` is never used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def seeded_key(seed, *parts) -> Column:
    """``md5(seed ':' p1 ':' p2 …)`` as lower-case hex (null if any part is null)."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit(":"), _c(p).cast("string")]
    return F.md5(F.concat(*pieces))


def hex_to_long(hex_col: Column, digits: int = 15) -> Column:
    """First ``digits`` hex characters as a non-negative bigint (15 digits = 60 bits)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint")


def draw(key: Column, n) -> Column:
    """A seeded draw in ``[0, n)`` from a hex key."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(hex_to_long(key), n_col.cast("bigint"))


def unit(key: Column) -> Column:
    """A seeded number in ``[0, 1)`` from a hex key (52 bits, exact in a double)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def below(key: Column, p: float) -> Column:
    """``unit(key) < p`` without a number: the hex digits are compared with those of ``p · 2^52`` (rounded up)."""
    least = math.ceil(p * (1 << 52))  # exact: a double times a power of two
    digits = "" if least <= 0 else "g" if least >= 1 << 52 else f"{least:013x}"
    return F.substring(key, 1, 13) < F.lit(digits)

"""String similarity, pair status and longest common block as Catalyst expressions.

Spans are short phrases, so the character programmes below run inside one row with
higher-order functions (``aggregate`` / ``transform``); no Python UDF. The builders
return SQL text over given sub-expressions so they can be nested in other lambdas
(span matching, ensembles).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (status codes of the span scorer).
COR, INC, PAR, MIS, SPU = "COR", "INC", "PAR", "MIS", "SPU"
# Shortest common block that counts as a consensus span.
MIN_COMMON_BLOCK = 5


# Bits of a bigint in use per word of a bit vector: the sum of two words and a carry fits.
BITS = 62
ONES = f"{(1 << BITS) - 1}L"


def masks_sql(b: str) -> str:
    """Match masks of a text: per distinct character, one bit per position, ``BITS`` to a bigint.

    Made once per text, however many texts it is compared with. Callers guard empty texts.
    """
    bits = (
        f"aggregate(transform(slice(_mc, _mw * {BITS} + 1, {BITS}), (_mx, _mi) -> "
        "IF(_mx = _mk, shiftleft(1L, _mi), 0L)), 0L, (_ma, _my) -> _ma | _my)"
    )
    words = f"transform(sequence(0, CAST((size(_mc) - 1) DIV {BITS} AS INT)), _mw -> {bits})"
    return (
        f"transform(array(split({b}, '')), _mc -> map_from_arrays(array_distinct(_mc), "
        f"transform(array_distinct(_mc), _mk -> {words})))[0]"
    )


def lcs_length_sql(a: str, masks: str) -> str:
    """Length of the longest common subsequence (code points) of ``a`` and the text of ``masks``.

    Bit-parallel (Hyyrö 2004) over as many words as the text needs: ``V`` holds one bit per
    character of the text (all ones at the start); for each character of ``a`` with match mask
    ``M``: ``V = (V + (V & M)) | (V & ~M)``, the carry of a word going into the next. The length
    is the number of zero bits of ``V``; a character without a mask leaves ``V`` as it is.
    """
    word = (
        "transform(array(_lz.v + (_lz.v & _lz.m) + _ls.c), _lt -> named_struct('c', shiftright(_lt, "
        f"{BITS}), 'o', concat(_ls.o, array((_lt & {ONES}) | (_lz.v & ~_lz.m)))))[0]"
    )
    step = (
        "aggregate(zip_with(_lv, _lm, (_lx, _ly) -> named_struct('v', _lx, 'm', _ly)), "
        f"named_struct('c', 0L, 'o', CAST(array() AS array<bigint>)), (_ls, _lz) -> {word}, _ls -> _ls.o)"
    )
    fold = (
        f"aggregate(split({a}, ''), transform(map_values({masks})[0], _l1 -> {ONES}), "
        f"(_lv, _lc) -> transform(array(try_element_at({masks}, _lc)), _lm -> IF(_lm IS NULL, _lv, {step}))[0])"
    )
    return f"aggregate({fold}, 0, (_ln, _lw) -> _ln + {BITS} - CAST(bit_count(_lw) AS INT))"


def similarity_sql(a: str, b: str, masks: str | None = None) -> str:
    """Integer 0–100, ``round_half_even(100 · 2·LCS / (len a + len b))``.

    Equal texts score 100 and an empty side scores 0 (checked in that order); null
    gives 0. ``masks`` are those of ``b`` where the caller has made them already.
    """
    if masks is None:
        lcs = f"transform(array({masks_sql(b)}), _sm -> {lcs_length_sql(a, '_sm')})[0]"
    else:
        lcs = lcs_length_sql(a, masks)
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 "
        f"WHEN {a} = {b} THEN 100 "
        f"WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 "
        f"ELSE CAST(bround(100D * (CAST(2 * {lcs} AS DOUBLE) / "
        f"CAST(length({a}) + length({b}) AS DOUBLE)), 0) AS INT) END)"
    )


def partial_status_sql(g: str, p: str) -> str:
    """I2 partial level: COR if equal; same word count → PAR if a word matches in place;
    different counts → PAR if a word of the shorter side is a substring of the longer text."""
    gw = f"split({g}, ' ', -1)"
    pw = f"split({p}, ' ', -1)"
    return (
        f"(CASE WHEN {g} = {p} THEN 'COR' "
        f"WHEN size({gw}) = size({pw}) THEN "
        f"IF(exists(sequence(1, size({gw})), _k -> element_at({gw}, _k) = element_at({pw}, _k)), 'PAR', 'INC') "
        f"WHEN size({gw}) > size({pw}) THEN IF(exists({pw}, _w -> contains({g}, _w)), 'PAR', 'INC') "
        f"ELSE IF(exists({gw}, _w -> contains({p}, _w)), 'PAR', 'INC') END)"
    )


def exact_status_sql(g: str, p: str) -> str:
    """I2 exact and strict levels: COR only if equal, else INC."""
    return f"IF({g} = {p}, 'COR', 'INC')"


def similarity(a, b) -> Column:
    return F.expr(similarity_sql(_sql(a), _sql(b)))


def pair_status(g, p) -> Column:
    """I2 as a struct ``(partial, exact, strict)``."""
    gs, ps = _sql(g), _sql(p)
    return F.expr(
        f"named_struct('partial', {partial_status_sql(gs, ps)}, 'exact', {exact_status_sql(gs, ps)}, "
        f"'strict', {exact_status_sql(gs, ps)})"
    )


def common_block_sql(a: str, b: str) -> str:
    """Longest common block of ``lower(a)`` and ``lower(b)``, cut from ``a`` (original case).

    Binary search on the length (a common block of n characters holds one of n - 1): a length
    is common when the hash sets of both texts' blocks of it meet, compared by their characters.
    ``array_intersect`` keeps the order of ``a``, so ties keep the earliest block in ``a``.
    Returns ``''`` when nothing is shared.
    """

    def blocks(x: str, n: str) -> str:
        return f"transform(sequence(1, length({x}) - {n} + 1), _cp -> substring({x}, _cp, {n}))"

    mid = "CAST((_ca.lo + _ca.hi) DIV 2 AS INT)"
    probe = (
        f"IF(_ca.hi - _ca.lo < 2, _ca, transform(array({mid}), _cn -> "
        f"IF(arrays_overlap({blocks('_ct.a', '_cn')}, {blocks('_ct.b', '_cn')}), "
        "named_struct('lo', _cn, 'hi', _ca.hi), named_struct('lo', _ca.lo, 'hi', _cn)))[0])"
    )
    # lo: a length that is common, hi: one that is not; each round halves what lies between
    least = "least(length(_ct.a), length(_ct.b))"
    longest = (
        f"aggregate(sequence(1, length(bin({least})) + 1), named_struct('lo', 0, 'hi', {least} + 1), "
        f"(_ca, _ci) -> {probe}, _ca -> _ca.lo)"
    )
    first = f"array_intersect({blocks('_ct.a', '_cl')}, {blocks('_ct.b', '_cl')})[0]"
    cut = f"transform(array({longest}), _cl -> IF(_cl = 0, '', substring({a}, instr(_ct.a, {first}), _cl)))[0]"
    texts = f"named_struct('a', left(lower({a}), length({a})), 'b', left(lower({b}), length({b})))"
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR length({a}) = 0 OR length({b}) = 0 THEN '' "
        f"ELSE transform(array({texts}), _ct -> {cut})[0] END)"
    )


def _sql(x) -> str:
    if isinstance(x, str):
        return f"`{x}`"
    raise TypeError("pass column names; use the *_sql builders for expressions")

"""Quality rules with risk-controlled thresholds (operator 6, native).

Each rule is a number per document that rises with doubt (share of symbols, share of
repeated lines, share of repeated three-word windows, share of table bars, mean word
length). Cutoffs are chosen per stratum (language) on labelled holdouts: rejecting every
document above the cutoff of any rule must falsely reject at most a share ``alpha`` of the
good ones, with probability ``1 - delta`` for all strata at once.

All rules of a stratum share one allowance (Tukey's statistically equivalent blocks): the
``n`` holdouts cut what can occur into ``n + 1`` blocks, and any ``b`` of them hold more
than ``alpha`` with probability ``P(Bin(n, alpha) <= b - 1)`` only, so ``b`` is the largest
number for which this exact tail is at most ``delta`` divided by the number of strata. The
rules take their blocks in turn, in the order of ``rule_values``: an equal part of what is
left, of the holdouts no earlier rule rejects. A rule with ``k`` blocks takes the lowest
cutoff of its grid with fewer than ``k`` holdouts above it; blocks that even the lowest
cutoff does not need go to the later rules. A stratum with no block keeps all its documents;
no method can do better there, as without any false rejection the tail is still
``(1 - alpha) ** n`` (219 holdouts for four strata). Strata that are too small even alone
do not count as strata. Holdouts that tie with a cutoff stay in the later rules' sample,
which can only raise their cutoffs.

Defined results: a null or blank text has no words, so it fails the base rule; a null
language is the stratum ``und``; no labels or an empty table: no cutoff. Repeated
three-word windows are found by their 64-bit hash within one document (chance of a
false repeat in a text of 20,000 words: below 1e-10). Ties lie on the kept side (a
document is rejected above the cutoff only).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab.llm.common import let, table, words, written

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50

ALPHA = 0.02  # share of good documents of a stratum that all rules together may reject
DELTA = 0.05  # chance that any certified cutoff breaks its promise
UNKNOWN = "und"

# Cutoffs tried for each rule, in thousandths of the rule's value.
GRID = [5, 10, 20, 30, 40, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900]
LENGTH_GRID = [6000, 7000, 8000, 9000, 10000, 12000, 14000, 16000, 20000, 30000]


def text_measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper (null text: of '')."""
    text = F.coalesce(text, F.lit(""))
    packed = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.struct(words(text).alias("w"), lines.alias("l"), packed.alias("p")),
        lambda x: F.struct(
            F.size(x["w"]).cast("bigint").alias("n_words"),
            F.char_length(x["p"]).cast("bigint").alias("word_chars"),
            (F.char_length(x["p"]) - F.char_length(F.translate(x["p"], SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            F.size(x["l"]).cast("bigint").alias("n_lines"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("bigint").alias("n_dup_lines"),
            repeat_words(x["w"]).alias("n_repeat_words"),
            (F.char_length(x["p"]) - F.char_length(F.translate(x["p"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_upper"),
        ),
    )


def repeat_words(w: Column) -> Column:
    """Words inside a three-word window that the text holds at least twice."""
    none = F.lit(0).cast("bigint")

    def windows(h):
        return F.transform(
            F.slice(h, 1, F.size(h) - 2),
            lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")),
        )

    def repeated(s):
        # neighbours of the sorted windows that share a hash; their first words in text order
        same = F.filter(
            s,
            lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"]),
        )
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at):
        # a window adds its three words less those that the next one adds
        return F.aggregate(
            F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3)))),
            none,
            lambda acc, x: acc + x,
        )

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    count = let(
        hashes,
        lambda h: let(
            F.sort_array(windows(h)),
            lambda s: let(repeated(s), covered),
        ),
    )
    return F.when(F.size(w) < 4, none).otherwise(count)


def rule_values(measures: Column) -> dict[str, tuple[Column, list[int]]]:
    """Rules by name: value in thousandths (rounded down) and the cutoffs tried."""
    m = measures

    def mille(part: Column, whole: Column) -> Column:
        return F.floor(part * 1000 / F.greatest(whole, F.lit(1))).cast("bigint")

    return {
        "symbols": (mille(m["n_symbols"], m["word_chars"]), GRID),
        "dup_lines": (mille(m["n_dup_lines"], m["n_lines"]), GRID),
        "repeats": (mille(m["n_repeat_words"], m["n_words"]), GRID),
        "upper": (mille(m["n_upper"], m["word_chars"]), GRID),
        "word_length": (mille(m["word_chars"], m["n_words"]), LENGTH_GRID),
    }


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z >= 1 (Stirling's series at z + 8; error below 1e-11)."""
    y = z + 8.0
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    high = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series
    down = F.lit(0.0)
    for i in range(8):
        down = down + F.ln(z + float(i))
    return high - down


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Exact ``P(Bin(n, p) <= k)``: terms from k downwards while they matter.

    Below the mean the terms fall at least geometrically; ``12 sqrt(n p) + 60`` of them
    hold all but 1e-15 of the sum. Above the mean the tail is at least 1/3, which no test
    here accepts, so 1 is returned.
    """
    x, m = k.cast("double"), n.cast("double")
    log_top = (
        log_gamma(m + 1) - log_gamma(x + 1) - log_gamma(m - x + 1) + x * math.log(p) + (m - x) * math.log1p(-p)
    )
    last = F.greatest(F.lit(0), F.floor(k - 12 * F.sqrt(m * p) - 60)).cast("bigint")
    steps = F.sequence(k.cast("bigint"), last, F.lit(-1).cast("bigint"))
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] * i * (1 - p) / ((m - i + 1) * p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    return F.when(x >= m * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * total))


def allowed_blocks(n: Column, alpha: float, level: float) -> Column:
    """Largest b with ``P(Bin(n, alpha) <= b - 1) <= level`` (0: none).

    Searched within six deviations below the mean, where tails are above 1e-9 or b is 0.
    """
    mean = n * alpha
    low = F.greatest(F.lit(0), F.floor(mean - 6 * F.sqrt(mean)) - 10).cast("bigint")
    passed = F.filter(F.sequence(low, F.floor(mean).cast("bigint")), lambda k: binomial_tail(n, k, alpha) <= level)
    return F.coalesce(F.array_max(passed) + 1, F.lit(0).cast("bigint"))


def certified_cutoffs(values: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified cutoff per stratum and rule.

    ``values`` has one row per labelled good document: ``stratum`` and ``rules``, an array
    of (rule, value, grid). Returns stratum, rule, cutoff, n, false_rejections (those that
    no earlier rule rejects).
    """
    # documents by the number of cutoffs that they exceed in each rule: summed before the exchange
    cells = values.groupBy(
        "stratum",
        F.transform("rules", lambda r: F.size(F.filter(r["grid"], lambda c: c < r["value"]))).alias("above"),
    ).agg(F.count(F.lit(1)).alias("docs"), F.first(F.transform("rules", lambda r: F.struct(r["rule"].alias("rule"), r["grid"].alias("grid")))).alias("tried"))
    group = written(
        cells.groupBy("stratum").agg(
            F.sum("docs").alias("n"), F.collect_list(F.struct("above", "docs")).alias("cells"), F.first("tried").alias("tried")
        ),
        "quality-cells",
    )
    able = group.filter(F.col("n") * math.log1p(-alpha) <= math.log(delta)).count()
    group = group.withColumn("left", allowed_blocks(F.col("n"), alpha, delta / max(able, 1)))

    def docs(cells):
        return F.aggregate(cells, F.lit(0).cast("bigint"), lambda acc, x: acc + x["docs"])

    def step(acc, i):
        tried = F.get("tried", i)

        def above(p):
            # a document is above the cutoff at position p when it exceeds more than p cutoffs
            return docs(F.filter(acc["cells"], lambda x: F.get(x["above"], i) > p))

        share = F.ceil(acc["left"] / (F.size("tried") - i)).cast("bigint")
        positions = F.sequence(F.lit(0), F.size(tried["grid"]) - 1)
        return let(
            F.struct(share.alias("share"), F.array_min(F.filter(positions, lambda p: above(p) < share)).alias("p")),
            lambda t: F.struct(
                F.filter(acc["cells"], lambda x: t["p"].isNull() | (F.get(x["above"], i) <= t["p"])).alias("cells"),
                (acc["left"] - F.least(t["share"], above(F.lit(0)) + 1)).alias("left"),
                F.concat(
                    acc["out"],
                    F.array(F.struct(tried["rule"].alias("rule"), F.get(tried["grid"], t["p"]).alias("cutoff"), above(t["p"]).alias("false_rejections"))),
                ).alias("out"),
            ),
        )

    none = F.array().cast("array<struct<rule:string,cutoff:bigint,false_rejections:bigint>>")
    start = F.struct(F.col("cells"), F.col("left"), none.alias("out"))
    chosen = F.aggregate(F.sequence(F.lit(0), F.size("tried") - 1), start, step, lambda acc: acc["out"])
    return (
        group.select("stratum", "n", F.explode(chosen).alias("c"))
        .filter("c.cutoff IS NOT NULL")
        .select("stratum", "c.rule", "c.cutoff", "n", "c.false_rejections")
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    alpha: float = ALPHA,
    delta: float = DELTA,
    good: str = "quality",
) -> DataFrame:
    """One row per document: measures, ``base_failed``, ``stratum``, the rules it broke, ``kept``.

    ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, ``good`` = 1 for good ones).
    """
    m = F.col("m")
    measured = docs.select(
        "doc_id", F.coalesce("lang", F.lit(UNKNOWN)).alias("stratum"), text_measures(F.col("text")).alias("m")
    )
    base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    rules = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                value.alias("value"),
                F.array(*[F.lit(c).cast("bigint") for c in grid]).alias("grid"),
            )
            for name, (value, grid) in rule_values(m).items()
        ]
    )
    measured = written(
        measured.select("doc_id", "stratum", "m.*", base.alias("base_failed"), rules.alias("rules")), "quality-measures"
    )
    # the rules judge what the base rule let through
    trusted = labels.filter(F.col(good) == 1).select("doc_id").distinct()
    holdout = measured.filter(~F.col("base_failed")).select("doc_id", "stratum", "rules").join(trusted, "doc_id", "left_semi")
    cutoffs = written(certified_cutoffs(holdout.select("stratum", "rules"), alpha, delta), "quality-cutoffs")
    per_stratum = cutoffs.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )
    joined = measured.join(per_stratum, "stratum", "left")
    broken = F.filter("rules", lambda r: F.coalesce(r["value"] > F.col("cutoffs")[r["rule"]], F.lit(False)))
    return joined.withColumn("broken", F.transform(broken, lambda r: r["rule"])).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0)
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict of the certified cutoffs for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken", ",").alias("broken"),
    )

"""Rare-class augmentation as table jobs.

The per-sentence augmenters of the reference are re-aimed:

- a text is an array of whitespace tokens;
- synonyms come from a ``(word, pos, synonym)`` table. It is joined to the word positions
  of the texts once (``annotate``; ``annotate_words`` for edits that choose among a text's
  distinct words), so the row carries its synonyms; an edit, and every further round of
  edits, is then an expression inside the row;
- every random choice is ``md5(seed ':' tag ':' id ':' …)``, so a round of
  augmentation is repeatable and independent of partitioning.

Texts are processed whole; per-row work is linear in the text length.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.functions.keys import below, draw, seeded_key
from spanlab.operators.exactk import dense_index, dense_order, with_take_flag
from spanlab.session import materialize, remove_path, write_once

# Fixed value: the mask that protects a span while its text is augmented.
SPAN_MASK = "@@span@@"


def words_of(c) -> Column:
    """Whitespace tokens, as ``s.split()`` (an empty text gives ``['']``)."""
    col = c if isinstance(c, Column) else F.col(c)
    return F.split(F.trim(F.regexp_replace(col, T.WHITESPACE_RUN, " ")), " ", -1)


def synonym_table_from_corpus(df: DataFrame, text_col: str = "input_text") -> DataFrame:
    """A ``(word, pos, synonym)`` table derived from the corpus (no lexicon is available).

    All words are ranked 1..N in the order of ``md5(word)``, then word (dense numbering
    without a global window); word r gets two synonyms: its pair partner (1↔2, 3↔4, …)
    and the next rank (N wraps to 1). Part of speech: ``v`` when r is a multiple of 3,
    else ``n``. A partner beyond N is left out. The corpus is read once: its words are written
    in order, and that table is read for both sides of the pairs.
    """
    found = df.select(F.explode(words_of(text_col)).alias("word")).filter(F.col("word") != "").distinct()
    ranked = dense_order(found, [F.md5("word"), "word"], "r").withColumn("r", F.col("r") + 1)
    n = ranked.count()
    partner = F.when(F.col("r") % 2 == 1, F.col("r") + 1).otherwise(F.col("r") - 1)
    nxt = F.col("r") % F.lit(n) + 1
    pairs = ranked.select("word", "r", F.explode(F.array_distinct(F.array(partner, nxt))).alias("pr"))
    names = ranked.select(F.col("r").alias("pr"), F.col("word").alias("synonym"))
    out = pairs.join(names, "pr").select(
        "word", F.when(F.col("r") % 3 == 0, F.lit("v")).otherwise(F.lit("n")).alias("pos"), "synonym"
    )
    return out.filter(F.col("word") != F.col("synonym"))


def annotate(df: DataFrame, syn: DataFrame, text_col: str = "input_text", pos: str | None = None) -> DataFrame:
    """Rows with ``_a``: their words in order, each ``(at, word, syns)`` with all its synonyms.

    The rows are written once with a number of their own; word positions meet the lexicon
    (one row per word) in one join, are grouped by that number and come back to their row.
    A word that fills many positions is dealt by Spark's skew join.
    """
    rows, _ = write_once(df.withColumn("_uid", F.monotonically_increasing_id()), "annotate-rows")
    places = rows.select("_uid", F.posexplode(words_of(text_col)).alias("at", "word"))
    none = F.array().cast("array<string>")
    met = places.join(_lexicon(syn, pos, places), "word", "left").withColumn("syns", F.coalesce("syns", none))
    per_row = met.groupBy("_uid").agg(F.sort_array(F.collect_list(F.struct("at", "word", "syns"))).alias("_a"))
    return rows.join(per_row, "_uid", "left").drop("_uid")


def annotate_words(df: DataFrame, syn: DataFrame, text_col: str = "input_text", pos: str | None = None) -> DataFrame:
    """Rows with ``_w``, their words in order, and ``_v``, each distinct word that has synonyms as ``(word, syns)``.

    For edits that choose a word, wherever it stands: a word meets the lexicon once per row.
    """
    rows, _ = write_once(df.withColumn("_uid", F.monotonically_increasing_id()), "annotate-rows")
    found = rows.select("_uid", F.explode(F.array_distinct(words_of(text_col))).alias("word"))
    met = found.join(_lexicon(syn, pos, found), "word")
    per_row = met.groupBy("_uid").agg(F.collect_list(F.struct("word", "syns")).alias("_v"))
    none = F.array().cast(per_row.schema["_v"].dataType)
    out = rows.join(per_row, "_uid", "left").drop("_uid")
    return out.withColumn("_w", words_of(text_col)).withColumn("_v", F.coalesce("_v", none))


def _lexicon(syn: DataFrame, pos: str | None, places: DataFrame) -> DataFrame:
    """One row per word of ``places`` with its synonyms (of part of speech ``pos``).

    The table holds the words of the whole corpus: those that stand nowhere in the rows leave
    it before synonyms are gathered.
    """
    s = syn if pos is None else syn.filter(F.col("pos") == F.lit(pos))
    s = s.join(places.select("word").distinct(), "word", "left_semi")
    return s.groupBy("word").agg(F.sort_array(F.collect_set("synonym")).alias("syns")).filter(F.size("syns") > 0)


def _chosen(x: Column, id_col: str, seed, tag: str) -> Column:
    """The synonym of an annotated word in a row: the lowest seeded hash; null without synonyms."""
    ranked = F.transform(
        x["syns"], lambda s: F.struct(seeded_key(seed, F.lit(tag), F.col(id_col), x["word"], s).alias("key"), s.alias("synonym"))
    )
    return F.array_min(ranked)["synonym"]


def _candidates(id_col: str, seed, tag: str) -> Column:
    """Distinct words of a row that have synonyms, as ``(pick key, word, synonyms)``."""
    return F.transform(
        "_v",
        lambda v: F.struct(
            seeded_key(seed, F.lit(tag + "-pick"), F.col(id_col), v["word"]).alias("key"), v["word"].alias("word"), v["syns"].alias("syns")
        ),
    )


def _replaced(id_col: str, seed, n: int = 1, tag: str = "sr") -> Column:
    every = _candidates(id_col, seed, tag)
    first = F.array_compact(F.array(F.array_min(every))) if n == 1 else F.slice(F.sort_array(every), 1, n)
    picked = F.transform(first, lambda c: F.struct(c["word"].alias("word"), _chosen(c, id_col, seed, tag).alias("synonym")))
    # the few picked words are bound once, beside the row's words
    return F.flatten(
        F.transform(
            F.array(picked),
            lambda some: F.transform(
                "_w", lambda w: F.coalesce(F.get(F.filter(some, lambda c: c["word"] == w), F.lit(0))["synonym"], w)
            ),
        )
    )


def _inserted(id_col: str, seed, tag: str = "ri") -> Column:
    chosen = F.transform(F.array(F.array_min(_candidates(id_col, seed, tag))), lambda c: _chosen(c, id_col, seed, tag))
    insert = F.get(chosen, F.lit(0))
    at = (draw(seeded_key(seed, F.lit(tag + "-pos"), F.col(id_col)), F.size("_w") + 1) + 1).cast("int")
    return F.when(insert.isNull(), F.col("_w")).otherwise(F.array_insert("_w", at, insert))


def _lexical(id_col: str, seed, p: float = 0.5, tag: str = "wn") -> Column:
    def word(x, i):
        hit = below(seeded_key(seed, F.lit(tag), F.col(id_col), i), float(p))
        return F.when((F.size(x["syns"]) > 0) & hit, _chosen(x, id_col, seed, tag)).otherwise(x["word"])

    return F.transform("_a", word)


def synonym_replace(df, syn, id_col="tweet_id", text_col="input_text", n=1, seed=25, out="augmented", tag="sr"):
    """H1: replace (every occurrence of) ``n`` distinct words that have synonyms, each by one synonym."""
    x = annotate_words(df, syn, text_col)
    return x.withColumn(out, F.array_join(_replaced(id_col, seed, n, tag), " ")).drop("_w", "_v")


def _prepare(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.withColumn("_w", words_of(text_col))


def _finish(df: DataFrame, words: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.array_join(words, " ")).drop("_w")


def random_delete(df, id_col="tweet_id", text_col="input_text", p=0.2, seed=25, out="augmented", tag="rd"):
    """H2: drop each word with probability ``p``; a one-word text stays; if all go, keep one random word."""
    x = _prepare(df, id_col, text_col)
    kept = F.filter("_w", lambda t, i: ~below(seeded_key(seed, F.lit(tag), F.col(id_col), i), float(p)))
    keep_one = F.array(F.element_at("_w", (draw(seeded_key(seed, F.lit(tag + "-keep"), F.col(id_col)), F.size("_w")) + 1).cast("int")))
    words = F.when(F.size("_w") <= 1, F.col("_w")).when(F.size(kept) == 0, keep_one).otherwise(kept)
    return _finish(x, words, out)


def random_swap(df, id_col="tweet_id", text_col="input_text", seed=25, out="augmented", tag="rs"):
    """H3: swap two distinct random positions (a one-word text stays)."""
    x = _prepare(df, id_col, text_col)
    n = F.size("_w")
    i = draw(seeded_key(seed, F.lit(tag + "-a"), F.col(id_col)), n)
    j = F.pmod(i + 1 + draw(seeded_key(seed, F.lit(tag + "-b"), F.col(id_col)), F.greatest(n - 1, F.lit(1))), n)
    x = x.withColumn("_i", i).withColumn("_j", j)
    swapped = F.transform(
        "_w",
        lambda t, k: F.when(k == F.col("_i"), F.element_at("_w", (F.col("_j") + 1).cast("int")))
        .when(k == F.col("_j"), F.element_at("_w", (F.col("_i") + 1).cast("int")))
        .otherwise(t),
    )
    return _finish(x, F.when(n <= 1, F.col("_w")).otherwise(swapped), out).drop("_i", "_j")


def random_insert(df, syn, id_col="tweet_id", text_col="input_text", seed=25, out="augmented", tag="ri"):
    """H4: insert a synonym of a random word (one that has synonyms) at a random position."""
    x = annotate_words(df, syn, text_col)
    return x.withColumn(out, F.array_join(_inserted(id_col, seed, tag), " ")).drop("_w", "_v")


def lexical_replace(df, syn, id_col="tweet_id", text_col="input_text", pos="v", p=0.5, seed=25, out="augmented", tag="wn"):
    """H5: each word of part of speech ``pos`` that has a synonym is replaced with probability ``p``."""
    x = annotate(df, syn, text_col, pos)
    return x.withColumn(out, F.array_join(_lexical(id_col, seed, p, tag), " ")).drop("_a")


# The kinds' names. A kind is how its rows meet the lexicon, the part of speech that is
# cut to (None: all; no lexicon for the last two) and what it makes of a row.
LEXICON_KINDS = {"sr": (annotate_words, None, _replaced), "ri": (annotate_words, None, _inserted), "Wordnet": (annotate, "v", _lexical)}
PLAIN_KINDS = {"rd": random_delete, "rs": random_swap}


def annotate_for(df: DataFrame, kind: str, syn: DataFrame | None, text_col: str = "input_text") -> DataFrame:
    """The rows as ``augment_rows`` needs them for any number of rounds of ``kind``."""
    if kind in PLAIN_KINDS:
        return df
    if kind not in LEXICON_KINDS:
        raise ValueError(f"unknown kind {kind!r}: expected one of {sorted([*LEXICON_KINDS, *PLAIN_KINDS])}")
    meet, pos, _ = LEXICON_KINDS[kind]
    return meet(df, syn, text_col, pos)


def augment_rows(df: DataFrame, kind: str, id_col: str, text_col: str = "input_text", seed=25, out: str = "augmented") -> DataFrame:
    """One edit of each row of ``annotate_for``; the id seeds its choices."""
    if kind in PLAIN_KINDS:
        return PLAIN_KINDS[kind](df, id_col=id_col, text_col=text_col, seed=seed, out=out)
    return df.withColumn(out, F.array_join(LEXICON_KINDS[kind][2](id_col, seed), " "))


def quota_plan(n: int, size: int) -> tuple[int, int]:
    """H6 loop shape: (full rounds, remainder rows). A remainder equal to the size
    stops the loop (it is left to the top-up), as in the reference."""
    if n <= 0 or size <= 0:
        return 0, 0
    full = (n - 1) // size
    rem = n - full * size
    if rem == size:
        rem = 0
    return full, rem


def augment_to(df, n: int, kind: str, syn=None, id_col="tweet_id", text_col="input_text", seed=25) -> DataFrame:
    """H6: augment until ``n`` texts: whole set per full round, the first rows for the
    remainder, then one top-up from the *last* rows for the shortfall of distinct
    texts; distinct result (at most ``n`` rows). Round r seeds every choice with r.

    Rows are ordered by ``md5(seed ':' id)``. The size and the distinct count are
    scalars computed by aggregation; the texts never leave the executors.
    """
    df = materialize(annotate_for(df, kind, syn, text_col))  # every round below reads it
    size = df.count()
    full, rem = quota_plan(n, size)
    key = seeded_key(seed, F.col(id_col))
    rounds = []
    if full > 0:
        rounds.append(df.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(full - 1)))))
    if rem > 0:
        head = with_take_flag(df, key, rem, None, id_col, "_t").filter("_t").drop("_t")
        rounds.append(head.withColumn("_round", F.lit(full)))
    out = None
    for r in rounds:
        aug = _augment_rounds(r, kind, id_col, text_col, seed)
        out = aug if out is None else out.unionByName(aug)
    if out is None:
        have = 0
        loop = None
    else:
        loop = materialize(out.select("augmented").distinct())
        have = loop.count()
    if have < n:
        n_left = min(n - have, size)
        rev = F.translate(key, "0123456789abcdef", "fedcba9876543210")
        tail = with_take_flag(df, rev, n_left, None, id_col, "_t").filter("_t").drop("_t")
        top = _augment_rounds(tail.withColumn("_round", F.lit(full + 1)), kind, id_col, text_col, seed)
        top = top.select("augmented")
        loop = top if loop is None else loop.unionByName(top)
    return loop.distinct() if loop is not None else df.sparkSession.createDataFrame([], "augmented string")


def _augment_rounds(df, kind, id_col, text_col, seed):
    """Apply augmenter ``kind`` with the round number folded into the row key."""
    x = df.withColumn("_rid", F.concat(F.col(id_col), F.lit("#"), F.col("_round").cast("string")))
    return augment_rows(x, kind, "_rid", text_col, seed).select(F.col(id_col), "_round", "augmented")


def append_augmented(corpus: DataFrame, texts: DataFrame, kind: str, prefix: str, target: str = T.POSITIVE_CLASS_TEXT, seed=25) -> DataFrame:
    """H7: new rows ``<kind>_augmented_<i>`` (i dense over the texts in md5 order), the
    text in both text columns, the given prefix and the positive target; one union."""
    # The numbering reads the texts twice (counts, then ranks): compute them once.
    texts = materialize(texts.select("augmented"))
    idx = dense_index(texts, seeded_key(seed, F.col("augmented")), None, "augmented", "_i")
    new = idx.select(
        F.concat(F.lit(f"{kind}_augmented_"), F.col("_i").cast("string")).alias("tweet_id"),
        F.col("augmented").alias("tweet"),
        F.lit(prefix).alias("prefix"),
        F.col("augmented").alias("input_text"),
        F.lit(target).alias("target_text"),
    )
    return corpus.select("tweet_id", "tweet", "prefix", "input_text", "target_text").unionByName(new)


BEGIN, END = "___BEGIN__", "___END__"
# White space after closing punctuation ends a sentence (the punctuation stays).
SENTENCE_END = r"""([.!?]['")\]]?)\s+"""


def markov_table(df: DataFrame, text_col: str = "input_text", order: int = 2) -> DataFrame:
    """H8: transition counts ``(state, next, count)`` of order-``order`` word states.

    Sentences end at line ends and closing punctuation; words are whitespace tokens; a
    sentence is padded with ``order`` begin marks and one end mark. Hot states (the begin state)
    are pre-aggregated per task before the shuffle.
    """
    sent = _sentences(df, text_col)
    padded = F.concat(F.array_repeat(F.lit(BEGIN), order), F.col("_w"), F.array(F.lit(END)))
    steps = F.transform(
        F.sequence(F.lit(order + 1), F.size("_p")),
        lambda i: F.struct(
            F.array_join(F.slice(F.col("_p"), i - order, order), " ").alias("state"),
            F.element_at(F.col("_p"), i).alias("next"),
        ),
    )
    trans = sent.select(padded.alias("_p")).select(F.inline(steps))
    return trans.groupBy("state", "next").agg(F.count(F.lit(1)).alias("count"))


SLOT = 64  # draws that one row of the chain answers, and the most transitions it holds
STEPS_PER_TABLE = 9  # steps of the walks between two written tables


def markov_chain(counts: DataFrame, order: int = 2) -> DataFrame:
    """H8's ``(state, next, count)`` as a table to draw from: ``(state, slot, entries)``.

    A state's transitions stand in the order of their words, each with the range of draws
    that its count gives it. Slot k of a state holds the transitions whose ranges meet the
    draws from ``k · SLOT`` on: at most ``SLOT`` of them, however many a state has, and a
    frequent transition is one entry in each slot it fills. An entry carries the state it
    leads to and that state's total, so a step needs one join. The end of a sentence leads
    nowhere and takes no part in the join for totals.
    """
    by_state = Window.partitionBy("state").orderBy("next")
    upto = counts.select("state", "next", F.sum("count").over(by_state).alias("upto"), "count")
    totals = counts.groupBy("state").agg(F.sum("count").alias("total"))
    words = F.split("state", " ", -1)
    leads = F.when(F.lit(order) == 1, F.col("next")).otherwise(F.array_join(F.concat(F.slice(words, 2, order - 1), F.array("next")), " "))
    going = upto.filter(F.col("next") != END).withColumn("leads", leads)
    going = going.join(totals.select(F.col("state").alias("leads"), "total"), "leads")
    ending = upto.filter(F.col("next") == END).select("*", F.lit(None).cast("string").alias("leads"), F.lit(None).cast("bigint").alias("total"))
    slots = F.sequence(F.floor((F.col("upto") - F.col("count")) / SLOT), F.floor((F.col("upto") - 1) / SLOT))
    rows = going.unionByName(ending).withColumn("slot", F.explode(slots))
    entries = F.sort_array(F.collect_list(F.struct("upto", "next", "leads", "total")))
    return rows.groupBy("state", "slot").agg(entries.alias("entries"))


def markov_generate(
    df: DataFrame,
    n: int,
    text_col: str = "input_text",
    min_words: int = 10,
    max_words: int = 25,
    tries: int = 10,
    seed: int = 25,
    order: int = 2,
) -> DataFrame:
    """H9: ``n`` sentences of ``min_words``–``max_words`` words walked over the chain.

    A step draws a number below the state's total and meets the one entry of the state's
    slot whose range holds it. ``n × tries`` walks run in parallel for ``max_words + 1``
    steps. The chain is dealt and sorted by (state, slot) once, so a step moves and sorts
    only the walks; finished walks keep their place under a key of their own. Walks are cut
    from their lineage every ``STEPS_PER_TABLE`` steps, and those that are finished stay there. Per sentence the first try that ends
    inside the length bounds and is not a sentence of the corpus wins. One refill round
    covers duplicates; it walks along with the first, so the chain is read once a step. The
    result is distinct.
    """
    spark = df.sparkSession
    counts, counts_path = write_once(markov_table(df, text_col, order), "markov-counts")
    dealt = markov_chain(counts, order).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "state", "slot")
    chain = materialize(dealt.sortWithinPartitions("state", "slot"))
    begin = " ".join([BEGIN] * order)
    start = counts.filter(F.col("state") == begin).agg(F.sum("count")).first()[0] or 0
    known = _sentences(df, text_col).select(F.array_join("_w", " ").alias("_known")).distinct()
    made = [counts_path]

    def step(walks: DataFrame, number: int) -> DataFrame:
        at = draw(seeded_key(seed, F.lit("walk"), F.col("round"), F.col("sent"), F.col("try"), F.lit(number)), F.col("_tot"))
        done = F.col("done")
        drawn = walks.select(
            "round", "sent", "try", "text", "n", "done", at.alias("_at"),
            # no slot is negative: finished walks meet nothing, each under its own key
            F.when(done, F.col("sent").cast("string")).otherwise(F.col("state")).alias("state"),
            F.when(done, F.lit(-1).cast("bigint")).otherwise(F.floor(at / SLOT)).alias("slot"),
        )
        met = drawn.join(chain.hint("merge"), ["state", "slot"], "left")
        entry = F.get(F.filter("entries", lambda e: e["upto"] > F.col("_at")), F.lit(0))
        ends = entry["next"] == END
        longer = F.when(F.col("n") == 0, entry["next"]).otherwise(F.concat("text", F.lit(" "), entry["next"]))
        n_words = F.when(done | ends, F.col("n")).otherwise(F.col("n") + 1)
        moved = met.select(
            "round", "sent", "try", F.when(done | ends, F.col("text")).otherwise(longer).alias("text"), n_words.alias("n"),
            entry["leads"].alias("state"), entry["total"].alias("_tot"), (done | ends | (n_words > max_words)).alias("done"),
        )
        # a walk that is done outside the bounds cannot win: it moves no further
        return moved.filter(~F.col("done") | F.col("n").between(min_words, max_words))

    # both rounds walk at once: the second has a sentence for each of the first that may be missing
    walks = spark.range(0, 2 * n).select(
        F.floor(F.col("id") / max(n, 1)).cast("int").alias("round"), F.col("id").alias("sent"),
        F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"), F.lit("").alias("text"), F.lit(0).alias("n"),
        F.lit(begin).alias("state"), F.lit(start).cast("bigint").alias("_tot"), F.lit(False).alias("done"),
    ).filter(F.col("_tot") > 0)
    ended = []
    for number in range(max_words + 1):
        walks = step(walks, number)
        if (number + 1) % STEPS_PER_TABLE == 0 and number < max_words:
            walks, path = write_once(walks, "markov-walks")
            made.append(path)
            ended.append(walks.filter("done"))  # these stay in their table
            walks = walks.filter(~F.col("done"))
    # a walk that is done has its end or a word too many
    ok = functools.reduce(DataFrame.unionByName, [*ended, walks])
    ok = ok.filter(F.col("n").between(min_words, max_words)).select("round", "sent", "try", "text")
    ok = ok.join(known, ok["text"] == known["_known"], "left_anti")
    texts, _ = write_once(ok.groupBy("round", "sent").agg(F.min_by("text", F.col("try")).alias("text")), "markov-sentences")
    have = texts.filter("round = 0").select("text").distinct().count()
    for path in made:
        remove_path(spark, path)
    refill = n - have if have else 0
    return texts.filter((F.col("round") == 0) | (F.col("sent") < n + refill)).select("text").distinct()


def _sentences(df: DataFrame, text_col: str) -> DataFrame:
    """Sentences of the texts as whitespace-token arrays (empty ones dropped).

    A sentence ends at a line end, or after ``.``, ``!`` or ``?`` (and closing quotes or
    brackets) where white space follows.
    """
    cut = F.regexp_replace(F.col(text_col), SENTENCE_END, "$1\n")
    lines = df.select(F.explode(F.split(cut, "\n", -1)).alias("_l"))
    return lines.select(words_of("_l").alias("_w")).filter(F.element_at("_w", 1) != "")


def augment_spans(
    df: DataFrame,
    syn: DataFrame,
    n: int,
    id_col: str = "tweet_id",
    seed: int = 25,
    pos: str = "v",
    p: float = 0.5,
    require_span: bool = False,
    kind: str = "wnet",
    prefix: str = T.SPAN_PREFIX,
) -> DataFrame:
    """Span-preserving augmentation of span rows: the new rows only.

    Lower-case text and span, mask every occurrence of the span, give the words their
    synonyms once, augment (H5) in rounds, keep changed texts, unmask, reject texts equal to an original positive
    text (anti join), target = span; the first ``n`` by (round, md5 order) are kept
    and numbered ``<kind>_augmented_<i>``. Rounds go on until there are ``n`` rows or a
    round adds none. ``require_span`` drops rows whose span is not in the text (the
    reference keeps them).
    """
    pos_rows = df.filter(T.has_span("target_text"))
    if require_span:
        pos_rows = pos_rows.filter(F.contains(F.lower("input_text"), F.lower("target_text")))
    low_t, low_s = F.lower("input_text"), F.lower("target_text")
    known = pos_rows.select(F.col("input_text").alias("_known")).distinct()
    base = pos_rows.select(id_col, low_s.alias("_span"), F.replace(low_t, low_s, F.lit(SPAN_MASK)).alias("_masked"))
    base = materialize(annotate(base, syn, "_masked", pos))  # synonyms are joined once, whatever the rounds

    def rounds(first: int, last: int) -> DataFrame:
        """Changed texts of the rounds from ``first`` up to ``last``, one expression per row and round."""
        x = base.withColumn("_round", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        x = x.withColumn("_rid", F.concat(F.col(id_col), F.lit("#"), F.col("_round").cast("string")))
        x = x.select(id_col, "_round", "_span", "_masked", F.array_join(_lexical("_rid", seed, p), " ").alias("_new"))
        text = F.replace("_new", F.lit(SPAN_MASK), F.col("_span"))
        x = x.filter(F.trim("_masked") != F.trim("_new")).select(id_col, "_round", "_span", text.alias("_text"))
        return x.join(known, x["_text"] == known["_known"], "left_anti")

    size = base.count()
    # a round adds at most a row per text: that many rounds at least, and as many again while rows are missing
    parts, have, done, last = [], 0, 0, -(-n // size) if n > 0 and size else 0
    while done < last:
        block, _ = write_once(rounds(done, last), "augmented-rounds")
        per_round = {r["_round"]: r["count"] for r in block.groupBy("_round").count().collect()}  # a row per round
        empty = next((r for r in range(done, last) if r not in per_round), None)
        parts.append(block if empty is None else block.filter(F.col("_round") < empty))
        have += sum(c for r, c in per_round.items() if empty is None or r < empty)
        done, last = last, last + (0 if empty is not None or have >= n else min(2 * last, -(-(n - have) * last // max(have, 1)) + 1))
    if not have:
        return df.sparkSession.createDataFrame([], "tweet_id string, tweet string, prefix string, input_text string, target_text string")
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    out = _rank_by_round(every, id_col, seed).filter(F.col("_i") < n)
    return out.select(
        F.concat(F.lit(f"{kind}_augmented_"), F.col("_i").cast("string")).alias("tweet_id"),
        F.col("_text").alias("tweet"),
        F.lit(prefix).alias("prefix"),
        F.col("_text").alias("input_text"),
        F.col("_span").alias("target_text"),
    )


def with_augmented_spans(df: DataFrame, syn: DataFrame, n: int, **options) -> DataFrame:
    """H10 as the corpus with the new rows appended (the prepared columns)."""
    columns = ["tweet_id", "tweet", "prefix", "input_text", "target_text"]
    return df.select(*columns).unionByName(augment_spans(df, syn, n, **options))


def _rank_by_round(df: DataFrame, id_col: str, seed) -> DataFrame:
    """0-based rank by (round, md5(seed:id)): rounds are few, so offsets per round come
    from a small count table and rows are ranked inside their round by md5 buckets."""
    per_round = dense_index(df, seeded_key(seed, F.col(id_col)), "_round", id_col, "_ir")
    counts = df.groupBy("_round").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_round").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).select("_round", "_off")
    return per_round.join(offs, "_round").withColumn("_i", F.col("_off") + F.col("_ir")).drop("_off", "_ir")

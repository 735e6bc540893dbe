"""Model-ready fixed-length rows.

Segmentation by a pretrained tokenizer is the model's codec and is not built; here
the words of ``prefix: input_text`` and of ``target_text`` are looked up in a vocab
table. Truncation to ``max_len`` is the operator's contract (the model reads that
many positions): the first ``max_len - 1`` tokens plus the end token are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators.augment import words_of
from spanlab.operators.exactk import dense_index

# Special token ids and the label value of padded positions.
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
IGNORE_LABEL = -100


def vocab_from_corpus(df: DataFrame, text_col: str) -> DataFrame:
    """A ``(token, id)`` table of all words: ids 3, 4, … in the order of ``md5(token)``, then token.

    The numbering is dense without a global window (``dense_index``).
    """
    words = df.select(F.explode(words_of(text_col)).alias("token")).filter(F.col("token") != "").distinct()
    numbered = dense_index(words, F.md5("token"), None, "token", "_i")
    return numbered.select("token", (F.col("_i") + 3).cast("int").alias("id"))


def encode_fixed(
    df: DataFrame,
    vocab: DataFrame,
    max_len: int = 130,
    key: str = "tweet_id",
    source=None,
    target: str = "target_text",
) -> DataFrame:
    """``(key, input_ids, attention_mask, labels)`` per row, each an int array of ``max_len``.

    Each distinct (key, source, target) content is encoded once under an md5 uid:
    tokens are exploded with their position, joined to the vocab (unknown → UNK)
    and folded back in position order per uid (at most ``2·max_len`` tokens, so no
    group grows with the data); rows join their encoding back, so copies of a row
    (oversampling) keep their multiplicity. Padding is ``PAD`` in the ids, 0 in the
    mask and -100 in the labels.
    """
    src = source if source is not None else T.model_input("prefix", "input_text")
    keep = max_len - 1
    uid = F.md5(F.concat_ws("\u0001", F.col(key).cast("string"), F.col("_src"), F.col("_tgt")))
    rows = df.select(key, src.alias("_src"), F.col(target).alias("_tgt")).select(
        key,
        uid.alias("_uid"),
        F.slice(words_of(F.col("_src")), 1, keep).alias("_st"),
        F.slice(words_of(F.col("_tgt")), 1, keep).alias("_tt"),
    )
    # Only the uid and the truncated token arrays cross the network, never the texts.
    content = rows.select("_uid", "_st", "_tt").dropDuplicates(["_uid"])
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("_st").alias("toks")),
        F.struct(F.lit(1).alias("side"), F.col("_tt").alias("toks")),
    )
    toks = content.select("_uid", F.inline(sides)).select("_uid", "side", F.posexplode("toks").alias("pos", "token"))
    looked = toks.join(vocab.select("token", "id"), "token", "left").withColumn("id", F.coalesce("id", F.lit(UNK_ID)))
    grouped = looked.groupBy("_uid").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.struct("pos", "id")))).alias("_s"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.struct("pos", "id")))).alias("_t"),
    )

    def fixed(arr, pad):
        ids = F.concat(F.transform(arr, lambda x: x["id"]), F.array(F.lit(EOS_ID)))
        return F.concat(ids, F.array_repeat(F.lit(pad), F.lit(max_len) - F.size(ids)))

    enc = grouped.select(
        "_uid",
        fixed(F.col("_s"), PAD_ID).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1), F.size("_s") + 1), F.array_repeat(F.lit(0), F.lit(max_len) - F.size("_s") - 1)
        ).alias("attention_mask"),
        fixed(F.col("_t"), IGNORE_LABEL).alias("labels"),
    )
    # a row whose input and target are both null has no token: end token and pads
    blank = [
        F.concat(F.array(F.lit(EOS_ID)), F.array_repeat(F.lit(PAD_ID), max_len - 1)),
        F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), max_len - 1)),
        F.concat(F.array(F.lit(EOS_ID)), F.array_repeat(F.lit(IGNORE_LABEL), max_len - 1)),
    ]
    names = ["input_ids", "attention_mask", "labels"]
    joined = rows.select(key, "_uid").join(enc, "_uid", "left")
    return joined.select(key, *[F.coalesce(F.col(c), b).alias(c) for c, b in zip(names, blank)])

"""Roles of the pipeline built from the driver's tables.

The reference's data set is private, so each role is derived by Spark from the
driver tables (``documents``, ``labels``, ``pages``, ``events``), whole tables and
whole texts. Every random-looking choice is a function of ``md5`` of a fixed tag
and the id, so the same rows come out of DuckDB in ``spanlab.plans.oracle``.

- texts: ``documents`` → ``(tweet_id, tweet)``
- class labels: ``labels.toxic`` 1 → ADE, else NoADE
- span labels: for toxic documents, three words and two words (split on one space) at
  md5-seeded places anywhere in the text
- noisy texts: text + the page URL of the same id + a snake_case token + an emoji
- runs: three classification and three extraction runs whose predictions are the
  gold, or a flipped / shortened / longer / reordered / missing answer, by md5
- progress log: ``events`` per user as a metric log
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import joins
from spanlab.session import write_once

# Fixed values of the mapping (shared with the oracle).
CLASS_RUNS = ["assert_run_a", "assert_run_b", "assert_run_c"]
SPAN_RUNS = ["ner_run_a", "ner_run_b", "ner_run_c"]
NOISE_TOKEN = "snake_case_token"
# (emoji, name) lookup table: a small fixed sample of Unicode short names.
EMOJI_TABLE = [
    ("😀", "grinning_face"),
    ("😂", "face_with_tears_of_joy"),
    ("😢", "crying_face"),
    ("😷", "face_with_medical_mask"),
    ("🤒", "face_with_thermometer"),
    ("🤢", "nauseated_face"),
    ("🤮", "face_vomiting"),
    ("😴", "sleeping_face"),
    ("💊", "pill"),
    ("💉", "syringe"),
    ("❤", "red_heart"),
    ("👍", "thumbs_up"),
    ("👍🏽", "thumbs_up_medium_skin_tone"),
    ("🔥", "fire"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its file splits are the partitions."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _h(tag: str, *cols) -> Column:
    parts = [F.lit(tag)]
    for c in cols:
        parts += [F.lit(":"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string")]
    return F.md5(F.concat(*parts))


def texts(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("tweet_id"), F.col("text").alias("tweet"))


def noisy_texts(spark, sf_dir) -> DataFrame:
    """Texts with a URL (page of the same id, when there is one), an underscore token and an emoji."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    emojis = F.array(*[F.lit(e) for e, _ in EMOJI_TABLE])
    pick = F.pmod(F.conv(F.substring(_h("emoji", "doc_id"), 1, 2), 16, 10).cast("bigint"), F.lit(len(EMOJI_TABLE)))
    return d.join(pages, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("tweet_id"),
        F.concat(
            F.col("text"),
            F.lit(" "),
            F.coalesce(F.concat(F.col("url"), F.lit(" ")), F.lit("")),
            F.lit(NOISE_TOKEN + " "),
            F.element_at(emojis, (pick + 1).cast("int")),
        ).alias("tweet"),
    )


def class_labels(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        F.col("doc_id").cast("string").alias("tweet_id"),
        F.when(F.col("toxic") == 1, F.lit("ADE")).otherwise(F.lit("NoADE")).alias("label"),
    )


def _words(text: str = "text") -> Column:
    return F.split(F.col(text), " ", -1)


def _phrase(words: Column, tag: str, id_col, length: int) -> Column:
    """``length`` words (fewer at the end of a short text) from a place that the tag and the id name."""
    at = F.conv(F.substring(_h(tag, id_col), 1, 8), 16, 10).cast("bigint")
    start = F.pmod(at, F.greatest(F.size(words) - length + 1, F.lit(1))) + 1
    return F.array_join(F.slice(words, start.cast("int"), length), " ")


def span_labels(spark, sf_dir) -> DataFrame:
    """Two spans per toxic document, anywhere in its text, with their first offsets."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    base = d.join(lab, "doc_id", "left_semi").withColumn("_w", _words())
    spans = base.select(
        "doc_id",
        "text",
        F.explode(F.array(_phrase(F.col("_w"), "a", "doc_id", 3), _phrase(F.col("_w"), "b", "doc_id", 2))).alias("label"),
    )
    begin = (F.instr(F.col("text"), F.col("label")) - 1).cast("int")
    return spans.select(
        F.col("doc_id").cast("string").alias("tweet_id"),
        F.lit("ADE").alias("type"),
        begin.alias("begin"),
        (begin + F.length("label")).cast("int").alias("end"),
        "label",
    )


def prepared_class(spark, sf_dir) -> DataFrame:
    """Prepared classification rows (D1 → B1 → B7 → B2 → B3)."""
    rows = joins.attach_labels(texts(spark, sf_dir), class_labels(spark, sf_dir), order=["label"])
    return rows.select(
        "tweet_id",
        "tweet",
        F.lit(T.CLASS_PREFIX).alias("prefix"),
        T.clean_text("tweet", EMOJI_TABLE).alias("input_text"),
        T.map_target(T.fill_label("label", T.DEFAULT_CLASS_LABEL), T.CLASS_TARGETS).alias("target_text"),
    )


def _span_rows(spark, sf_dir) -> DataFrame:
    """Texts with their first span label and all span labels joined (one attachment)."""
    return joins.attach_labels(
        texts(spark, sf_dir), span_labels(spark, sf_dir), order=["begin", "end", "label"], policy="both"
    )


def prepared_spans(spark, sf_dir, policy: str = "first") -> DataFrame:
    """Prepared extraction rows; ``policy='join'`` keeps all spans joined by ``'; '``."""
    rows = _span_rows(spark, sf_dir)
    label = "label" if policy == "first" else "label_joined"
    return rows.select(
        "tweet_id",
        "tweet",
        F.lit(T.SPAN_PREFIX).alias("prefix"),
        T.clean_text("tweet", EMOJI_TABLE).alias("input_text"),
        T.fill_label(label, T.NEGATIVE_SPAN).alias("target_text"),
    )


def _flip(target: Column) -> Column:
    return F.when(target == F.lit(T.POSITIVE_CLASS_TEXT), F.lit(T.NEGATIVE_CLASS_TEXT)).otherwise(
        F.lit(T.POSITIVE_CLASS_TEXT)
    )


def class_runs(spark, sf_dir) -> DataFrame:
    """Three rule runs: gold target, flipped for 25 % of (run, id), a trailing dot for 1/16."""
    prep = prepared_class(spark, sf_dir)
    r = prep.withColumn("run", F.explode(F.array(*[F.lit(x) for x in CLASS_RUNS])))
    h = F.md5(F.concat(F.col("run"), F.lit(":"), F.col("tweet_id")))
    pred = F.when(F.substring(h, 1, 2) < F.lit("40"), _flip(F.col("target_text"))).otherwise(F.col("target_text"))
    pred = F.when(F.substring(h, 3, 1) == F.lit("f"), F.concat(pred, F.lit("."))).otherwise(pred)
    return r.select("run", "tweet_id", "tweet", "prefix", "input_text", "target_text", pred.alias("predicted_text"))


def span_runs(spark, sf_dir, with_gold: bool = False, passes: int = 1) -> DataFrame:
    """Three rule runs over the extraction rows, by the first md5 hex digit of (run, id).

    ``with_gold`` keeps the joined gold spans (``gold``) of the same label attachment,
    so scoring needs no second attachment. Rows read in several ``passes`` (one for each
    run that is written) are attached and cleaned once and written."""
    rows = _span_rows(spark, sf_dir)
    prep = rows.select(
        "tweet_id",
        "tweet",
        F.lit(T.SPAN_PREFIX).alias("prefix"),
        T.clean_text("tweet", EMOJI_TABLE).alias("input_text"),
        T.fill_label("label", T.NEGATIVE_SPAN).alias("target_text"),
        T.fill_label("label_joined", T.NEGATIVE_SPAN).alias("gold"),
    )
    if passes > 1:
        prep, _ = write_once(prep, "span-rows")
    r = prep.withColumn("run", F.explode(F.array(*[F.lit(x) for x in SPAN_RUNS])))
    w = _words("tweet")
    s1 = _phrase(w, "a", "tweet_id", 3)
    d = F.substring(F.md5(F.concat(F.col("run"), F.lit(":"), F.col("tweet_id"))), 1, 1)
    g = F.col("gold")
    pred = (
        F.when(d.isin("0", "1", "2", "3", "4", "5"), g)
        .when(d.isin("6", "7"), s1)
        .when(d.isin("8", "9"), _phrase(w, "c", "tweet_id", 2))
        .when(d.isin("a", "b"), F.lit(T.NEGATIVE_SPAN))
        .when(d == "c", F.concat(_phrase(w, "b", "tweet_id", 2), F.lit("; "), s1))
        .when(d == "d", F.concat_ws("; ", *[_phrase(w, f"many{k}", "tweet_id", 1 + k % 3) for k in range(6)]))
        .when(d == "e", F.concat(g, F.lit(".")))
        .otherwise(F.concat(s1, F.lit(" "), F.element_at(w, -1)))
    )
    extra = ["gold"] if with_gold else []
    return r.select(
        "run", "tweet_id", "tweet", "prefix", "input_text", "target_text", pred.alias("predicted_text"), *extra
    )


def class_gold_raw(spark, sf_dir) -> DataFrame:
    """Gold class targets only where a label exists (null elsewhere after a left join)."""
    lab = class_labels(spark, sf_dir)
    return lab.select("tweet_id", T.map_target("label", T.CLASS_TARGETS).alias("target_text"))


def span_gold_raw(spark, sf_dir) -> DataFrame:
    """Gold span targets (first span) only for labelled documents: toxic → span, else ``none``."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("tweet_id"))
    prep = prepared_spans(spark, sf_dir).select("tweet_id", "target_text")
    return prep.join(lab, "tweet_id", "left_semi")


def progress_log(spark, sf_dir) -> DataFrame:
    """``events`` as evaluation logs: run = user, step = rank of (ts, event_id), metric = value."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run"),
        "ts",
        "event_id",
        F.col("value").alias("eval_loss"),
        (F.col("event_type") == F.lit("view")).alias("is_epoch_end"),
    )

"""Registered queries: one per operator of SURVEY §2, over the driver tables.

Each query takes ``(spark, sf_dir)``, reads whole tables through
``spanlab.plans.testviews`` and returns a DataFrame whose column names match the
DuckDB oracle in ``spanlab.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.functions import similarity as S
from spanlab.functions import text as T
from spanlab.operators import aggregate as AG
from spanlab.operators import ensemble as EN
from spanlab.operators import errors as ER
from spanlab.operators import joins as JN
from spanlab.operators import match as MA
from spanlab.operators import prompts as PR
from spanlab.operators import score as SC
from spanlab.operators import submission as SU
from spanlab.plans import testviews as V

Query = Callable[[SparkSession, str], DataFrame]
N_SPAN_RUNS = len(V.SPAN_RUNS)


# --- prepare (§3.1) ---------------------------------------------------------
def q_b7_clean_text(spark, sf):
    t = V.noisy_texts(spark, sf)
    return t.select("tweet_id", T.clean_text("tweet", V.EMOJI_TABLE).alias("input_text"))


def q_b3_prepared_class(spark, sf):
    return V.prepared_class(spark, sf).select("tweet_id", "prefix", "input_text", "target_text")


def q_d1_attach_labels_first(spark, sf):
    return V.prepared_spans(spark, sf, "first").select("tweet_id", "target_text")


def q_d1_attach_labels_join(spark, sf):
    return V.prepared_spans(spark, sf, "join").select("tweet_id", "target_text")


def q_b9_model_input(spark, sf):
    p = V.prepared_class(spark, sf)
    return p.select("tweet_id", T.model_input("prefix", "input_text").alias("model_input"))


def q_b8_apply_prompts(spark, sf):
    p = V.prepared_spans(spark, sf)
    return PR.apply_prompts(p).select("prompt", "tweet_id", "prefix", "input_text", "target_text")


def q_b10_unwrap_prompt(spark, sf):
    p = PR.apply_prompts(V.prepared_spans(spark, sf))
    return PR.unwrap(p).select("prompt", "tweet_id", F.col("target_text").alias("unwrapped"))


# --- ensemble (§3.3) --------------------------------------------------------
def _span_runs_norm(spark, sf):
    return EN.normalise_runs(V.span_runs(spark, sf))


def q_e1_vote_counts(spark, sf):
    return EN.vote_counts(_span_runs_norm(spark, sf))


def q_e2_majority_texts(spark, sf):
    return EN.majority_texts(EN.vote_counts(_span_runs_norm(spark, sf)), N_SPAN_RUNS)


def q_d4_without_majority(spark, sf):
    counts = EN.vote_counts(_span_runs_norm(spark, sf))
    return JN.without_majority(counts, EN.majority_texts(counts, N_SPAN_RUNS))


def q_d4_without_majority_window(spark, sf):
    return JN.without_majority(EN.vote_counts(_span_runs_norm(spark, sf)), n_runs=N_SPAN_RUNS)


def q_e3_candidate_spans(spark, sf):
    rest = JN.without_majority(EN.vote_counts(_span_runs_norm(spark, sf)), n_runs=N_SPAN_RUNS)
    return EN.candidate_spans(rest).select("tweet_id", F.array_join("all_spans", " | ").alias("all_spans"))


def q_j2_common_span(spark, sf):
    rest = JN.without_majority(EN.vote_counts(_span_runs_norm(spark, sf)), n_runs=N_SPAN_RUNS)
    return EN.common_span(EN.candidate_spans(rest)).select("tweet_id", "predicted_text")


def q_j1_majority_vote(spark, sf):
    return EN.majority_vote(EN.normalise_runs(V.class_runs(spark, sf)))


def q_j3_span_ensemble(spark, sf):
    return EN.span_ensemble(_span_runs_norm(spark, sf), N_SPAN_RUNS)


def q_d2_attach_text(spark, sf):
    return EN.run_ensemble(V.span_runs(spark, sf), V.SPAN_RUNS).select("tweet_id", "predicted_text", "tweet")


def q_j4_class_ensemble(spark, sf):
    return EN.run_ensemble(V.class_runs(spark, sf), V.CLASS_RUNS).select("tweet_id", "predicted_text", "counts", "tweet")


def q_b14_submission_spans(spark, sf):
    ens = EN.run_ensemble(V.span_runs(spark, sf), V.SPAN_RUNS)
    return SU.submission_rows(ens, "detection")


def q_b14_submission_class(spark, sf):
    ens = EN.run_ensemble(V.class_runs(spark, sf), V.CLASS_RUNS)
    return SU.submission_rows(ens, "classification")


def q_b13_span_offsets(spark, sf):
    r = V.span_runs(spark, sf).withColumn("predicted_text", T.normalise_prediction("predicted_text", lower=False))
    r = r.filter(T.has_span("predicted_text"))
    return r.select(
        "run",
        "tweet_id",
        T.span_start("tweet", "predicted_text").alias("span_start"),
        T.span_end("tweet", "predicted_text").alias("span_end"),
    )


# --- scoring (§3.2) ---------------------------------------------------------
def _eval_table(spark, sf):
    runs = V.span_runs(spark, sf, with_gold=True)
    return runs.select("run", "tweet_id", T.strip_dots("predicted_text").alias("pred_labels"), F.col("gold").alias("gold_labels"))


def q_i1_similarity(spark, sf):
    t = _eval_table(spark, sf).select(
        "run", "tweet_id", T.split_spans("gold_labels").alias("g"), T.split_spans("pred_labels").alias("p")
    )
    pairs = t.select("run", "tweet_id", F.explode(F.expr(MA.gold_pred_pairs_sql("g", "p"))).alias("x"), "g", "p")
    return pairs.select(
        "run",
        "tweet_id",
        F.expr("element_at(g, x.gi + 1)").alias("gold"),
        F.expr("element_at(p, x.pj + 1)").alias("pred"),
        (-F.col("x.ns")).alias("similarity"),
    )


def q_i2_pair_status(spark, sf):
    sims = q_i1_similarity(spark, sf)
    st = S.pair_status("gold", "pred")
    return sims.select("run", "tweet_id", "gold", "pred", st["partial"].alias("partial"), st["exact"].alias("exact"))


def q_i4_eval_spans(spark, sf):
    return MA.eval_spans(_eval_table(spark, sf), keep=("run", "tweet_id"))


def q_e6_span_scores(spark, sf):
    return SC.span_scores(MA.eval_spans(_eval_table(spark, sf), keep=("run", "tweet_id")), by="run")


def q_i5_evaluate_extraction(spark, sf):
    return SC.span_scores(MA.eval_spans(_eval_table(spark, sf), keep=("tweet_id",)))


def q_a9_metrics_long(spark, sf):
    scores = SC.span_scores(MA.eval_spans(_eval_table(spark, sf), keep=("tweet_id",)))
    return SC.scores_long(scores)


def q_e7_classification_report(spark, sf):
    votes = EN.majority_vote(EN.normalise_runs(V.class_runs(spark, sf)))
    gold = V.prepared_class(spark, sf).select("tweet_id", "target_text")
    x = JN.attach_gold(votes, gold)
    return SC.classification_report(x, label="gold_text", pred="predicted_text")


def q_e7_report_per_run(spark, sf):
    r = V.class_runs(spark, sf)
    x = r.select("run", "target_text", T.normalise_prediction("predicted_text").alias("pred"))
    return SC.classification_report(x, label="target_text", pred="pred", by="run")


# --- error analysis ---------------------------------------------------------
def _class_errors(spark, sf):
    runs = V.class_runs(spark, sf).withColumn("model", T.run_model("run"))
    return ER.class_errors(runs, V.class_gold_raw(spark, sf))


def q_k1_class_errors(spark, sf):
    e = _class_errors(spark, sf)
    return e.groupBy("model").agg(
        F.count_if(F.col("error_kind") == "fp").alias("n_fp"),
        F.count_if(F.col("error_kind") == "fn").alias("n_fn"),
        F.count(F.col("label")).alias("n_with_gold"),
    )


def q_k1_error_rows(spark, sf):
    """The false positives and negatives themselves."""
    e = _class_errors(spark, sf).filter(F.col("error_kind").isNotNull())
    return e.select("run", "model", "tweet_id", "class", "label", "error_kind")


def q_e8_nonnull_counts_fn(spark, sf):
    e = _class_errors(spark, sf).filter(F.col("error_kind") == "fn")
    return ER.nonnull_counts(e.select("model", "tweet_id", "tweet", "class", "label"), "model")


def q_e8_nonnull_counts(spark, sf):
    e = _class_errors(spark, sf).filter(F.col("error_kind") == "fp")
    return ER.nonnull_counts(e.select("model", "tweet_id", "tweet", "class", "label"), "model")


def _span_errors(spark, sf):
    runs = V.span_runs(spark, sf).withColumn("model", T.run_model("run"))
    return ER.span_errors(runs, V.span_gold_raw(spark, sf))


def q_k2_span_errors(spark, sf):
    return ER.errors_per_run(_span_errors(spark, sf))


def q_k2_error_rows(spark, sf):
    """The mismatching predictions themselves."""
    e = _span_errors(spark, sf).filter("mismatch")
    return e.select("model", "tweet_id", "predicted_text", "gold_text", "fn", "fp", "partial")


def q_k3_error_example(spark, sf):
    return ER.error_example(_span_errors(spark, sf), "partial")


# --- analysis aggregates ----------------------------------------------------
def q_e4_value_counts(spark, sf):
    return AG.value_counts(V.prepared_class(spark, sf), "target_text")


def q_e5_avg_words(spark, sf):
    p = V.prepared_class(spark, sf).filter(F.col("target_text") == T.POSITIVE_CLASS_TEXT)
    return AG.avg_words(p, "input_text")


def q_e10_class_sizes(spark, sf):
    p = V.prepared_spans(spark, sf)
    return AG.class_sizes(p.withColumn("label", T.label_name("target_text")), "label")


def q_e11_distinct_texts(spark, sf):
    return AG.distinct_count(V.texts(spark, sf), "tweet")


def queries() -> dict[str, Query]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}


# --- balancing (§2.9) -------------------------------------------------------
from spanlab.operators import balance as BA  # noqa: E402


def q_g1_split_exact(spark, sf):
    return BA.split_exact(V.prepared_class(spark, sf).select("tweet_id", "target_text")).select("tweet_id", "split")


def q_f2_first_half(spark, sf):
    p = V.prepared_spans(spark, sf).select("tweet_id", T.label_name("target_text").alias("label"))
    return BA.first_half(p, by="label").select("tweet_id", "label", "_first")


def q_w3_dense_index(spark, sf):
    from spanlab.operators.exactk import dense_index

    p = V.prepared_class(spark, sf).select("tweet_id", "target_text")
    return dense_index(p, BA.order_key(25, "tweet_id"), "target_text", "tweet_id", "idx")


def q_g2_oversample(spark, sf):
    p = V.prepared_class(spark, sf).select("tweet_id", "target_text")
    return BA.oversample(p, "target_text").select("tweet_id", "target_text", "draw")


def q_g3_undersample(spark, sf):
    p = V.prepared_class(spark, sf).select("tweet_id", "target_text")
    return BA.undersample(p, "target_text").select("tweet_id", "target_text")


def q_g4_balance_two_stage(spark, sf):
    p = V.prepared_spans(spark, sf).select("tweet_id", T.label_name("target_text").alias("label"))
    return BA.balance_two_stage(p, "label", T.NEGATIVE_SPAN).select("tweet_id", "label", "draw")


def q_g4_balanced_sizes(spark, sf):
    p = V.prepared_spans(spark, sf).select("tweet_id", T.label_name("target_text").alias("label"))
    return AG.class_sizes(BA.balance_two_stage(p, "label", T.NEGATIVE_SPAN), "label")


def q_g4_balance_class(spark, sf):
    """G4 for the classification task: the class texts are the labels."""
    p = V.prepared_class(spark, sf).select("tweet_id", T.label_name("target_text", "class").alias("label"))
    return BA.balance_two_stage(p, "label", T.NEGATIVE_CLASS_TEXT)


# --- augmentation (§2.10) ---------------------------------------------------
from spanlab.operators import augment as AU  # noqa: E402


def _positives(spark, sf):
    return _rare(V.prepared_class(spark, sf))


def _synonyms(spark, sf):
    return AU.synonym_table_from_corpus(V.prepared_class(spark, sf), "input_text")


def q_h0_synonym_table(spark, sf):
    return _synonyms(spark, sf)


def q_h1_synonym_replace(spark, sf):
    return AU.synonym_replace(_positives(spark, sf), _synonyms(spark, sf)).select("tweet_id", "augmented")


def q_h2_random_delete(spark, sf):
    return AU.random_delete(_positives(spark, sf)).select("tweet_id", "augmented")


def q_h3_random_swap(spark, sf):
    return AU.random_swap(_positives(spark, sf)).select("tweet_id", "augmented")


def q_h4_random_insert(spark, sf):
    return AU.random_insert(_positives(spark, sf), _synonyms(spark, sf)).select("tweet_id", "augmented")


def q_h5_lexical_replace(spark, sf):
    return AU.lexical_replace(_positives(spark, sf), _synonyms(spark, sf)).select("tweet_id", "augmented")


def _written(rows, name):
    """``rows`` written once: the query reads them in several passes."""
    return write_once(rows, name)[0]


def _rare(prepared):
    return prepared.filter(F.col("target_text") == T.POSITIVE_CLASS_TEXT)


def _quota(prepared):
    stats = prepared.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_text") == T.POSITIVE_CLASS_TEXT).alias("pos")).first()
    return max(0, stats["n"] // 5 - stats["pos"])


def q_h6_augment_to(spark, sf):
    p = _written(V.prepared_class(spark, sf), "prepared")
    return AU.augment_to(_rare(p), _quota(p), "rd")


def _augmented(prepared, kind):
    return AU.augment_to(_rare(prepared), _quota(prepared), kind, AU.synonym_table_from_corpus(prepared, "input_text"))


def q_h6_augment_to_sr(spark, sf):
    return _augmented(_written(V.prepared_class(spark, sf), "prepared"), "sr")


def q_h6_augment_to_ri(spark, sf):
    return _augmented(_written(V.prepared_class(spark, sf), "prepared"), "ri")


def q_h6_augment_to_wordnet(spark, sf):
    return _augmented(_written(V.prepared_class(spark, sf), "prepared"), "Wordnet")


def _appended(spark, sf, kind):
    p = _written(V.prepared_class(spark, sf), "prepared")
    return AU.append_augmented(p, _augmented(p, kind), kind, T.CLASS_PREFIX)


def q_h7_append_sr(spark, sf):
    """H6 into H7: the quota of the rare class filled with synonym replacements."""
    return _appended(spark, sf, "sr")


def q_h7_append_ri(spark, sf):
    return _appended(spark, sf, "ri")


def q_h7_append_wordnet(spark, sf):
    return _appended(spark, sf, "Wordnet")


def q_h7_append_markov(spark, sf):
    """H9 into H7: walked sentences appended to the corpus."""
    p = _written(V.prepared_class(spark, sf), "prepared")
    texts = AU.markov_generate(_rare(p), _quota(p)).select(F.col("text").alias("augmented"))
    return AU.append_augmented(p, texts, "markov", T.CLASS_PREFIX)


def q_h7_append_augmented(spark, sf):
    texts = AU.random_delete(_positives(spark, sf)).select("augmented").distinct()
    return AU.append_augmented(V.prepared_class(spark, sf), texts, "rd", T.CLASS_PREFIX)


def q_h8_markov_table(spark, sf):
    return AU.markov_table(_positives(spark, sf), "input_text")


def q_h9_markov_generate(spark, sf):
    p = _written(V.prepared_class(spark, sf), "prepared")
    return AU.markov_generate(_rare(p), _quota(p))


def q_h10_augment_spans(spark, sf):
    spans = _written(V.prepared_spans(spark, sf), "prepared-spans")
    return AU.with_augmented_spans(spans, _synonyms(spark, sf), n=_quota(V.prepared_class(spark, sf)))


# --- progress logs (M1) -----------------------------------------------------
from spanlab.operators import runs as RU  # noqa: E402


def q_m1_best_checkpoint(spark, sf):
    return RU.best_checkpoint(V.progress_log(spark, sf), patience=3)


# --- model rows, prediction, run evaluation (B16, L1, L3) -------------------
from spanlab.operators import encode as EC  # noqa: E402
from spanlab.operators import predict as PD  # noqa: E402


def q_b16_encode_fixed(spark, sf):
    p = V.prepared_class(spark, sf)
    vocab = EC.vocab_from_corpus(p, "input_text")
    return EC.encode_fixed(p, vocab, max_len=130)


def q_l1_predict_batches(spark, sf):
    p = V.prepared_class(spark, sf)
    return PD.predict_batches(p, PD.rule_factory("classification")).select("tweet_id", "predicted_text")


class _TwoAnswers:
    """The rule predictor's answer and the input's length, as two outputs per input."""

    def __init__(self):
        self.rule = PD.RulePredictor("classification")

    def __call__(self, texts):
        return [None if t is None else [answer, str(len(t))] for t, answer in zip(texts, self.rule(texts))]


def q_l1_predict_k(spark, sf):
    """L1 with several outputs per input, one row each."""
    p = PD.predict_batches(V.prepared_class(spark, sf), _TwoAnswers, k=2)
    return p.select("tweet_id", F.posexplode("predicted_text").alias("nth", "predicted_text"))


def _l3(spark, sf):
    rows = PR.apply_prompts(V.prepared_spans(spark, sf)).filter(F.col("prompt") == "prompt2")
    return PD.evaluate_run(rows, PD.rule_factory("prompt", "prompt2"), prompt="prompt2")


def q_l3_predictions(spark, sf):
    preds, _ = _l3(spark, sf)
    return preds.select("tweet_id", "target_text", "predicted_text")


def q_l3_evaluate_class(spark, sf):
    """L1 → L2 → E7: the classification report of one run."""
    report = {"report": lambda d: SC.classification_report(d, label="target_text", pred="predicted_text")}
    _, metrics = PD.evaluate_run(V.prepared_class(spark, sf), PD.rule_factory("classification"), metrics=report)
    return metrics["report"]


def q_l3_evaluate_run(spark, sf):
    _, metrics = _l3(spark, sf)
    return metrics["span_scores"]


# --- sources and sinks (A1–A8) ----------------------------------------------
from spanlab.sources import io as IO  # noqa: E402
from spanlab.session import scratch_path, write_once  # noqa: E402


def q_a1_read_tsv(spark, sf):
    path = scratch_path(spark, "class-tsv")
    V.class_labels(spark, sf).write.mode("overwrite").option("sep", "\t").csv(path)
    return IO.read_tsv(spark, path, IO.CLASS_SCHEMA)


def _flat_texts(spark, sf):
    """Texts without line ends and tabs: the files are read line by line, with quoting off."""
    return V.texts(spark, sf).select("tweet_id", F.regexp_replace("tweet", r"[\n\r\t]", " ").alias("tweet"))


def _write_plain_tsv(df, path):
    w = df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "")
    w.option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def q_a1_read_tsv_unquoted(spark, sf):
    """A1 with quoting off: quotes are text."""
    path = scratch_path(spark, "texts-tsv")
    _write_plain_tsv(_flat_texts(spark, sf), path)
    return IO.read_tsv(spark, path, IO.TEXT_SCHEMA, quoting=False)


def q_a2_read_splits(spark, sf):
    """A2: a task folder (train and valid texts and class labels) written and read by task name."""
    root = scratch_path(spark, "task")
    train = F.substring(F.md5(F.concat(F.lit("split:"), F.col("tweet_id"))), 1, 1) < "d"
    texts, labels = _flat_texts(spark, sf), V.class_labels(spark, sf)
    _write_plain_tsv(texts.filter(train), f"{root}/train/train_tweets.tsv")
    _write_plain_tsv(texts.filter(~train), f"{root}/valid/tweets.tsv")
    labels.filter(train).write.option("sep", "\t").csv(f"{root}/train/train_class.tsv")
    labels.filter(~train).write.option("sep", "\t").csv(f"{root}/valid/class.tsv")
    parts = zip(("train", "train", "valid", "valid"), ("tweet", "label") * 2, IO.read_splits(spark, root, "Task1a"))
    rows = [df.select(F.lit(s).alias("split"), F.lit(k).alias("kind"), "tweet_id", F.col(k).alias("value")) for s, k, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def q_a3_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "prepared-csv")
    IO.write_csv(V.prepared_spans(spark, sf), path, ["tweet_id", "tweet", "prefix", "input_text", "target_text"])
    return IO.read_csv(spark, path)


def q_a3_parquet_roundtrip(spark, sf):
    """A3 in the format for large tables."""
    path = scratch_path(spark, "prepared-parquet")
    IO.write_table(V.prepared_spans(spark, sf), path, ["tweet_id", "tweet", "prefix", "input_text", "target_text"], fmt="parquet")
    return IO.read_table(spark, path, fmt="parquet")


def _write_runs(spark, runs_df, names):
    """One folder per run. Every run holds the whole texts twice, so its files are compressed."""
    root = scratch_path(spark, "runs")
    cols = ["tweet_id", "tweet", "prefix", "input_text", "target_text", "predicted_text"]
    for i, name in enumerate(names):  # one folder per run, as the run directories of the reference
        # every run has its columns in another order, and one more than the run before it
        rows = runs_df.filter(F.col("run") == name).select("*", *[F.lit(name).alias(f"note{k}") for k in range(i)])
        order = cols[i:] + [f"note{k}" for k in range(i)] + cols[:i]
        IO.write_csv(rows, f"{root}/{name}/{IO.PREDICTIONS_FILE}", order, compression="gzip")
    return root


def q_a4_read_runs(spark, sf):
    root = _write_runs(spark, V.span_runs(spark, sf, passes=len(V.SPAN_RUNS)), V.SPAN_RUNS)
    return IO.read_runs(spark, root).select("run", "tweet_id", "predicted_text")


def q_a6_load_ensemble(spark, sf):
    root = _write_runs(spark, V.span_runs(spark, sf, passes=len(V.SPAN_RUNS)), V.SPAN_RUNS)
    cfg_path = scratch_path(spark, "ensemble-config")
    IO.write_config(spark, cfg_path, root, V.SPAN_RUNS, "ner_ensemble")
    cfg = IO.load_ensemble(spark, cfg_path)
    present = IO.present_runs(spark, cfg["input_dir"], cfg["predictions"])
    runs = IO.read_runs(spark, cfg["input_dir"], present)
    return EN.run_ensemble(runs, present).select("tweet_id", "predicted_text", "tweet")


def q_f1_ordered_votes(spark, sf):
    """the majority votes written in id order and read back with their place."""
    path = scratch_path(spark, "ordered-votes")
    votes = EN.majority_vote(EN.normalise_runs(V.class_runs(spark, sf)))
    IO.write_ordered(votes, path, ["tweet_id"])
    return IO.read_ordered(spark, path, "tweet_id string, predicted_text string, counts bigint")


def q_a9_ordered_metrics(spark, sf):
    """A9 at the sink: metric lines in key order, as the result file of a run has them."""
    path = scratch_path(spark, "ordered-metrics")
    IO.write_ordered(q_a9_metrics_long(spark, sf), path, ["metric"])
    return IO.read_ordered(spark, path, "metric string, value double")


def q_a5_run_names(spark, sf):
    """A5: task and model of every run, from its name."""
    runs = V.class_runs(spark, sf).select("run").unionByName(V.span_runs(spark, sf).select("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return runs.select("run", T.run_task("run").alias("task"), T.run_model("run").alias("model"), "n")


def q_a8_write_submission(spark, sf):
    path = scratch_path(spark, "submission")
    ens = EN.run_ensemble(V.span_runs(spark, sf), V.SPAN_RUNS)
    IO.write_submission(SU.submission_rows(ens, "detection"), path)
    return IO.read_tsv(spark, path, IO.SUBMISSION_SCHEMA, multi_line=True)


# --- membership, last-k cut, per-prompt folders (D5, F3, A7) -----------------
def q_d5_drop_known(spark, sf):
    """Augmented positive texts, about half of them unchanged, without those that are known."""
    pos = _positives(spark, sf)
    same = F.substring(F.md5(F.concat(F.lit("keep:"), F.col("tweet_id"))), 1, 1) < "8"
    text = F.when(same, F.col("input_text")).otherwise(F.col("augmented"))
    new = AU.random_delete(pos).select("tweet_id", text.alias("input_text"))
    return JN.drop_known(new, pos)


def q_f3_last_k(spark, sf):
    """The last k rows of the positives in md5 order (the top-up cut of H6), k = half of them."""
    from spanlab.functions.keys import seeded_key
    from spanlab.operators.exactk import take_first

    pos = _positives(spark, sf).select("tweet_id")
    k = pos.agg((F.count(F.lit(1)) / 2).cast("bigint").alias("_k"))
    rev = F.translate(seeded_key(25, F.col("tweet_id")), "0123456789abcdef", "fedcba9876543210")
    return take_first(pos, rev, k, None, "tweet_id")


def q_a7_prompt_folders(spark, sf):
    """Prompt rows written with one folder per prompt; reading one prompt prunes the others."""
    path = scratch_path(spark, "prompt-folders")
    applied = PR.apply_prompts(V.prepared_spans(spark, sf)).select("prompt", "tweet_id", "prefix", "input_text", "target_text")
    IO.write_csv(applied, path, partition_by=["prompt"])
    back = IO.read_csv(spark, path, "tweet_id string, prefix string, input_text string, target_text string, prompt string")
    return back.filter(F.col("prompt") == "prompt2").select("tweet_id", "input_text", "target_text")


def q_b14_dropped_count(spark, sf):
    ens = EN.run_ensemble(V.span_runs(spark, sf), V.SPAN_RUNS)
    return SU.dropped_spans(ens)

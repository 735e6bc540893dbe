"""Votes, span ensemble and common span (FIXTURES §2 "Votes", "Common span")."""

from spanlab.operators import ensemble as EN

RUN_SCHEMA = "run string, tweet_id string, predicted_text string"


def test_majority_vote_ties(spark):
    df = spark.createDataFrame(
        [("r1", "1", "a"), ("r2", "1", "a"), ("r3", "1", "b"), ("r1", "2", "b"), ("r2", "2", "a")], RUN_SCHEMA
    )
    got = {r.tweet_id: (r.predicted_text, r.counts) for r in EN.majority_vote(df).collect()}
    assert got == {"1": ("a", 2), "2": ("a", 1)}


def test_span_ensemble_cases(spark):
    rows = [
        ("r1", "1", "nausea"), ("r2", "1", "none"),
        ("r1", "2", "nausea"), ("r2", "2", "nausea"), ("r3", "2", "none"),
        ("r1", "3", "severe joint pain"), ("r2", "3", "joint pain"), ("r3", "3", "none"),
        ("r1", "4", "nausea"), ("r2", "4", "none"),
        ("r1", "5", "none"),
    ]
    df = spark.createDataFrame(rows, RUN_SCHEMA)
    two = sorted((r.tweet_id, r.predicted_text) for r in EN.span_ensemble(df.filter("tweet_id = '1'"), 2).collect())
    assert two == [("1", "nausea"), ("1", "none")]
    got = sorted((r.tweet_id, r.predicted_text) for r in EN.span_ensemble(df.filter("tweet_id <> '1'"), 3).collect())
    # id 3: common block of the two spans is "joint pain" (>= 5 chars), found in both
    assert got == [("2", "nausea"), ("3", "joint pain"), ("4", "nausea")]


def test_common_span_longest(spark):
    df = spark.createDataFrame([("1", ["joint aches then pain", "severe joint pain now"])], "tweet_id string, all_spans array<string>")
    assert EN.common_span(df).first().predicted_text == "joint "


def test_common_span_no_block_is_seeded(spark):
    df = spark.createDataFrame([("1", ["abc", "xyz"]), ("2", ["solo"])], "tweet_id string, all_spans array<string>")
    got = {r.tweet_id: r.predicted_text for r in EN.common_span(df).collect()}
    assert got["2"] == "solo" and got["1"] in ("abc", "xyz")
    again = {r.tweet_id: r.predicted_text for r in EN.common_span(df.repartition(3)).collect()}
    assert again == got


def test_run_ensemble_rejects_mixed_tasks(spark):
    import pytest

    df = spark.createDataFrame([("assert_a", "1", "x")], RUN_SCHEMA)
    with pytest.raises(ValueError):
        EN.run_ensemble(df, ["assert_a", "ner_b"])


def test_dedupe_by_key_repeated_and_unique(spark):
    from spanlab.operators import joins as JN

    uniq = spark.createDataFrame([("1", "a"), ("2", "b")], "tweet_id string, tweet string")
    assert sorted(tuple(r) for r in JN.dedupe_by_key(uniq, "tweet_id", "tweet").collect()) == [("1", "a"), ("2", "b")]
    dup = spark.createDataFrame([("1", "z"), ("1", "a"), ("2", "b")], "tweet_id string, tweet string")
    assert sorted(tuple(r) for r in JN.dedupe_by_key(dup, "tweet_id", "tweet").collect()) == [("1", "a"), ("2", "b")]

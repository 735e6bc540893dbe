"""Exact cuts, balancing sizes and partition independence."""

from pyspark.sql import functions as F

from spanlab.operators import balance as BA
from spanlab.operators.exactk import dense_index, take_first


def _ids(spark, n, label="x"):
    return spark.createDataFrame([(str(i), label) for i in range(n)], "tweet_id string, label string")


def test_split_sizes_disjoint_complete(spark):
    df = _ids(spark, 11)
    out = BA.split_exact(df).collect()
    assert sum(r.split == "val" for r in out) == 3 and sum(r.split == "train" for r in out) == 8
    assert sorted(r.tweet_id for r in out) == sorted(str(i) for i in range(11))


def test_exact_k_partition_independent(spark):
    df = _ids(spark, 500)
    key = BA.order_key(25, "tweet_id")
    a = sorted(r.tweet_id for r in take_first(df.repartition(1), key, 123, None, "tweet_id").collect())
    b = sorted(r.tweet_id for r in take_first(df.repartition(7), key, 123, None, "tweet_id").collect())
    ref = sorted(r.tweet_id for r in df.withColumn("k", key).orderBy("k", "tweet_id").limit(123).collect())
    assert a == b == ref


def test_dense_index_is_a_permutation(spark):
    df = _ids(spark, 300)
    idx = [r.idx for r in dense_index(df.repartition(5), BA.order_key(1, "tweet_id"), None, "tweet_id").collect()]
    assert sorted(idx) == list(range(300))


def test_two_stage_sizes(spark):
    for p, n, want in [(3, 10, 5), (8, 10, 8), (1, 5, 2)]:
        df = _ids(spark, p, "ade").unionByName(
            spark.createDataFrame([(f"n{i}", "none") for i in range(n)], "tweet_id string, label string")
        )
        got = {r.label: r["count"] for r in BA.balance_two_stage(df, "label", "none").groupBy("label").count().collect()}
        assert got == {"ade": want, "none": want}, (p, n, got)


def test_oversample_keeps_originals(spark):
    df = _ids(spark, 3, "a").unionByName(_ids(spark, 7, "b").withColumn("tweet_id", F.concat(F.lit("b"), "tweet_id")))
    out = BA.oversample(df, "label")
    sizes = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert sizes == {"a": 7, "b": 7}
    assert out.filter(F.col("draw").isNull()).count() == 10


def test_undersample_subset(spark):
    df = _ids(spark, 3, "a").unionByName(_ids(spark, 7, "b").withColumn("tweet_id", F.concat(F.lit("b"), "tweet_id")))
    out = BA.undersample(df, "label")
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {"a": 3, "b": 3}


def test_straddling_bucket_path(spark, monkeypatch):
    """With 16 buckets every cut falls inside a bucket: the ranking branch must agree
    with a plain global order, for cuts, per-group cuts and dense numbering."""
    from spanlab.operators import exactk

    monkeypatch.setattr(exactk, "BUCKET_DIGITS", 1)
    df = spark.createDataFrame([(str(i), "a" if i % 3 else "b") for i in range(400)], "tweet_id string, label string")
    key = BA.order_key(25, "tweet_id")
    ordered = [r.tweet_id for r in df.withColumn("k", key).orderBy("k", "tweet_id").collect()]
    for k in (1, 77, 250, 399):
        got = sorted(r.tweet_id for r in exactk.take_first(df.repartition(5), key, k, None, "tweet_id").collect())
        assert got == sorted(ordered[:k]), k
    per = {r.tweet_id for r in exactk.take_first(df, key, 10, "label", "tweet_id").collect()}
    rows = df.withColumn("k", key).orderBy("k", "tweet_id").collect()
    want = {r.tweet_id for r in rows if r.label == "a"}
    want_a = [r.tweet_id for r in rows if r.label == "a"][:10]
    want_b = [r.tweet_id for r in rows if r.label == "b"][:10]
    assert per == set(want_a) | set(want_b) and want
    idx = {r.tweet_id: r.idx for r in exactk.dense_index(df.repartition(3), key, None, "tweet_id").collect()}
    assert [t for t, _ in sorted(idx.items(), key=lambda kv: kv[1])] == ordered


def test_refined_histogram_groups_nulls_and_equal_rows(spark, monkeypatch):
    """Ranking one row at most makes every round of the selection run. Null
    keys, null groups, null tie-breaks and rows that are wholly alike stand on both sides."""
    from pyspark.sql import Window

    from spanlab.operators import exactk

    monkeypatch.setattr(exactk, "BUCKET_DIGITS", 8)
    monkeypatch.setattr(exactk, "RANK_ROWS", 1)
    rows = [(None if i % 11 == 0 else str(i % 150), ["a", "b", None, "once"][i % 3 if i else 3], None if i % 7 == 0 else i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "tweet_id string, label string, t long").repartition(7)
    key = BA.order_key(3, "tweet_id")
    order = [F.coalesce(key, F.lit(exactk.LAST_KEY)), "t"]

    def counted(flagged):
        out = {}
        for r in flagged.collect():
            out[r.tweet_id, r.label, r.t, r._take] = out.get((r.tweet_id, r.label, r.t, r._take), 0) + 1
        return out

    ks = spark.createDataFrame([("a", 20), (None, 500), ("b", 0)], "label string, _k long")
    for k, expected in [(17, F.lit(17)), (lambda n: F.floor(n / 2), F.floor(F.col("_n") / 2)), (ks, F.expr("case when label = 'a' then 20 when label is null then 500 else 0 end"))]:
        w = Window.partitionBy("label")
        want = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_take", F.row_number().over(w.orderBy(*order)) <= expected).drop("_n")
        assert counted(exactk.with_take_flag(df, key, k, "label", "t")) == counted(want)
    for k in (0, 33, 380, 1000):
        w = Window.orderBy(*order, "label")
        assert counted(exactk.with_take_flag(df, key, k, None, ["t", "label"])) == counted(df.withColumn("_take", F.row_number().over(w) <= k)), k
    assert exactk.with_take_flag(df.limit(0), key, 5, None, "t").collect() == []
    assert exactk.with_take_flag(df.limit(0), key, 5, "label", "t").collect() == []

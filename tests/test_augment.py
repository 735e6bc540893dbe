"""Augmentation: quota loop shape, properties of the edits (SURVEY §2.10, FIXTURES "Quota")."""

from pyspark.sql import functions as F

from spanlab.operators import augment as AU


def test_quota_plan_fixture():
    # (size, n) -> rows from the loop (full * size + remainder)
    cases = {(10, 4): 4, (10, 25): 25, (10, 10): 0, (10, 30): 20, (10, 0): 0}
    for (size, n), loop_rows in cases.items():
        full, rem = AU.quota_plan(n, size)
        assert full * size + rem == loop_rows, (size, n)


def _texts(spark):
    rows = [("1", "the cat sat on the mat"), ("2", "one"), ("3", "a b c d e f g h")]
    return spark.createDataFrame(rows, "tweet_id string, input_text string")


def _syn(spark):
    return spark.createDataFrame(
        [("cat", "n", "dog"), ("sat", "v", "rested"), ("mat", "n", "rug"), ("c", "v", "see")], "word string, pos string, synonym string"
    )


def test_random_delete_keeps_a_word(spark):
    out = {r.tweet_id: r.augmented for r in AU.random_delete(_texts(spark), p=0.99).collect()}
    assert out["2"] == "one"
    assert len(out["3"].split(" ")) >= 1 and set(out["3"].split(" ")) <= set("abcdefgh")


def test_random_swap_is_permutation(spark):
    out = {r.tweet_id: r.augmented for r in AU.random_swap(_texts(spark)).collect()}
    assert sorted(out["1"].split(" ")) == sorted("the cat sat on the mat".split(" "))
    assert out["2"] == "one"
    assert out["3"] != "a b c d e f g h"


def test_synonym_replace_and_insert(spark):
    sr = {r.tweet_id: r.augmented for r in AU.synonym_replace(_texts(spark), _syn(spark)).collect()}
    assert sr["1"] in {"the dog sat on the mat", "the cat rested on the mat", "the cat sat on the rug"}
    ri = {r.tweet_id: r.augmented for r in AU.random_insert(_texts(spark), _syn(spark)).collect()}
    assert len(ri["1"].split(" ")) == 7 and ri["2"] == "one"


def test_lexical_replace_only_pos(spark):
    out = {r.tweet_id: r.augmented for r in AU.lexical_replace(_texts(spark), _syn(spark), p=1.0).collect()}
    assert out["1"] == "the cat rested on the mat"
    assert out["3"] == "a b see d e f g h"


def test_augment_to_at_most_n(spark):
    out = AU.augment_to(_texts(spark), 5, "rd")
    assert out.count() <= 5


def test_markov_table_counts(spark):
    df = spark.createDataFrame([("1", "a b a b")], "tweet_id string, input_text string")
    t = {(r.state, r.next): r["count"] for r in AU.markov_table(df).collect()}
    assert t[("a b", "a")] == 1 and t[("___BEGIN__ ___BEGIN__", "a")] == 1 and t[("a b", "___END__")] == 1


def test_append_augmented_ids(spark):
    corpus = spark.createDataFrame([("1", "t", "p", "t", "healthy okay")], "tweet_id string, tweet string, prefix string, input_text string, target_text string")
    texts = spark.createDataFrame([("x",), ("y",)], "augmented string")
    out = AU.append_augmented(corpus, texts, "sr", "assert ade")
    ids = sorted(r.tweet_id for r in out.filter(F.col("tweet_id") != "1").collect())
    assert ids == ["sr_augmented_0", "sr_augmented_1"]


def test_encode_fixed_keeps_copies(spark):
    from spanlab.operators import encode as EC

    rows = [("1", "p", "a b", "x"), ("1", "p", "a b", "x"), ("2", "p", "zz", "none")]
    df = spark.createDataFrame(rows, "tweet_id string, prefix string, input_text string, target_text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4), ("x", 5), ("p:", 6)], "token string, id int")
    out = sorted((r.tweet_id, r.input_ids, r.attention_mask, r.labels) for r in EC.encode_fixed(df, vocab, max_len=5).collect())
    assert out[0] == out[1] == ("1", [6, 3, 4, 1, 0], [1, 1, 1, 1, 0], [5, 1, -100, -100, -100])
    assert out[2] == ("2", [6, 2, 1, 0, 0], [1, 1, 1, 0, 0], [2, 1, -100, -100, -100])


def test_annotated_words_carry_all_their_synonyms(spark):
    rows = [("1", "the cat  sat"), ("1", "the cat  sat"), (None, None), ("4", ""), ("5", "cat " * 5000 + "mat")]
    df = spark.createDataFrame(rows, "tweet_id string, input_text string").repartition(3)
    syn = _syn(spark).unionByName(spark.createDataFrame([("cat", "n", "dog"), ("cat", "v", "purr")], "word string, pos string, synonym string"))
    out = AU.annotate(df, syn).collect()
    assert len(out) == len(rows)
    by = {r.tweet_id: r for r in out}
    assert [(a.at, a.word, a.syns) for a in by["1"]._a] == [(0, "the", []), (1, "cat", ["dog", "purr"]), (2, "sat", ["rested"])]
    assert len(by["5"]._a) == 5001 and by[None]._a is None and [a.word for a in by["4"]._a] == [""]
    assert [(a.word, a.syns) for a in AU.annotate(df.limit(0), syn).collect()] == []


def test_every_kind_by_rounds_equals_single_rounds(spark):
    """Rounds taken together in the rows are the rounds taken one by one."""
    df = _texts(spark)
    for kind, single in (("sr", AU.synonym_replace), ("ri", AU.random_insert), ("Wordnet", AU.lexical_replace)):
        base = AU.annotate_for(df, kind, _syn(spark)).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(3))))
        base = base.withColumn("rid", F.concat("tweet_id", F.lit("#"), F.col("round").cast("string")))
        together = {r.rid: r.augmented for r in AU.augment_rows(base, kind, "rid").collect()}
        for k in range(4):
            one = df.withColumn("rid", F.concat("tweet_id", F.lit(f"#{k}")))
            assert {r.rid: r.augmented for r in single(one, _syn(spark), id_col="rid").collect()}.items() <= together.items(), kind


def test_markov_chain_slots_give_each_transition_its_count(spark):
    rows = [("a b", "x", 1000), ("a b", "y", 1), ("a b", AU.END, 70), ("b x", AU.END, 1000), ("b y", "z", 1), ("y z", AU.END, 1)]
    chain = AU.markov_chain(spark.createDataFrame(rows, "state string, next string, count long")).collect()
    assert all(len(r.entries) <= AU.SLOT for r in chain) and len(chain) == len({(r.state, r.slot) for r in chain})
    slots = {(r.state, r.slot): r.entries for r in chain}
    drawn = {}
    for state, total in (("a b", 1071), ("b x", 1000), ("b y", 1)):
        for at in range(total):
            e = next(e for e in slots[state, at // AU.SLOT] if e.upto > at)
            drawn[state, e.next] = drawn.get((state, e.next), 0) + 1
            assert (e.leads, e.total) == {"x": ("b x", 1000), "y": ("b y", 1), "z": ("y z", 1), AU.END: (None, None)}[e.next]
    assert drawn == {(s, n): c for s, n, c in rows if s != "y z"}


def test_dense_order_over_ranges(spark):
    from spanlab.operators.exactk import dense_order

    df = spark.range(1000).selectExpr("cast(id % 997 as string) AS w", "id").repartition(9)
    got = [(r.idx, r.w, r.id) for r in dense_order(df, [F.md5("w"), "id"]).collect()]
    want = [(r.w, r.id) for r in df.orderBy(F.md5("w"), "id").collect()]
    assert sorted(got) == [(i, *x) for i, x in enumerate(want)]
    assert dense_order(df.limit(0), ["w"]).collect() == []


def test_a_word_meets_the_lexicon_once_per_row(spark):
    rows = [("1", "the cat  sat"), (None, None), ("4", ""), ("5", "cat " * 5000 + "mat")]
    df = spark.createDataFrame(rows, "tweet_id string, input_text string").repartition(3)
    by = {r.tweet_id: r for r in AU.annotate_words(df, _syn(spark)).collect()}
    assert len(by) == 4 and len(by["5"]._w) == 5001 and sorted((v.word, v.syns) for v in by["5"]._v) == [("cat", ["dog"]), ("mat", ["rug"])]
    assert by["1"]._w == ["the", "cat", "sat"] and by[None]._w is None and by["4"]._w == [""] and by["4"]._v == []
    sr = {r.tweet_id: r.augmented for r in AU.synonym_replace(df, _syn(spark), n=2).collect()}
    assert sr == {"1": "the dog rested", None: None, "4": "", "5": "dog " * 5000 + "rug"}


def test_augmented_corpus_is_prepared_once(spark, sf_small):
    """What comes back reads the rows written once, not the tables again."""
    from spanlab.plans import catalog

    for query in (catalog.q_h7_append_sr, catalog.q_h6_augment_to_wordnet, catalog.q_h10_augment_spans):
        assert not [f for f in query(spark, sf_small).inputFiles() if "documents.parquet" in f], query


def test_digits_below_a_share_are_numbers_below_it(spark):
    from spanlab.functions.keys import below, unit

    half = f"{1 << 51:013x}"
    keys = [half, f"{(1 << 51) - 1:013x}", "0" * 13, "f" * 13, None, *(r.k[:13] for r in spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k")).collect())]
    df = spark.createDataFrame([(k and k + "0" * 19,) for k in keys], "k string")
    for p in (0.0, 0.2, 0.5, 0.99, 1.0):
        rows = df.select(below(F.col("k"), p).alias("a"), (unit(F.col("k")) < F.lit(p)).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], p


def test_walks_that_cannot_win_move_no_further(spark, monkeypatch):
    """Tables between the steps hold a text per walk, and no walk that ended outside the bounds."""
    made, real = [], AU.write_once

    def spy(df, name):
        out = real(df, name)
        if name == "markov-walks":
            made.append([(r.n, r.done) for r in out[0].select("n", "done").collect()])
        return out

    monkeypatch.setattr(AU, "write_once", spy)
    df = spark.createDataFrame([("1", "a b c. a b d e f g h i j k l m n. b c a b c a b d.")], "tweet_id string, input_text string")
    out = [r.text for r in AU.markov_generate(df, 20, min_words=5, max_words=12).collect()]
    assert out and all(5 <= len(t.split(" ")) <= 12 for t in out)
    assert len(made) == 1 and made[0] and all(5 <= n <= 12 for rows in made for n, done in rows if done)

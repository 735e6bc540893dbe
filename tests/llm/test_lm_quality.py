import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from spanlab.llm import lm_quality as L


def cls(word):
    return xxhash.xxh64_intdigest(word) >> (64 - L.CLASS_BITS)


def brute(train, texts):
    """The model by its textbook definition: (n_words, log probability) per text."""
    bigrams = Counter()
    for t in train:
        w = [cls(x) for x in (t or "").encode().split()]
        bigrams.update(zip(w, w[1:]))
    cc = Counter(bigrams.values())
    cut = L.discounts(*[float(cc[k]) for k in (1, 2, 3, 4)])
    before, after = defaultdict(set), defaultdict(Counter)
    for (a, b), c in bigrams.items():
        before[b].add(a)
        after[a][b] = c
    cont = {b: len(v) for b, v in before.items()}
    own = L.discounts(*[float(sum(v == k for v in cont.values())) for k in (1, 2, 3, 4)])
    mass = sum(cont.values())

    def p1(w):
        if not mass:
            return 1 / L.CLASSES
        spare = sum(own[min(v, 3)] for v in cont.values())
        c = cont.get(w, 0)
        return (c - own[min(c, 3)]) / mass + spare / mass / L.CLASSES

    memo = {}

    def p2(w, v):
        if w not in memo:
            memo[w] = p1(w)
        seen = after.get(v)
        if not seen:
            return memo[w]
        total = sum(seen.values())
        back = sum(cut[min(c, 3)] for c in seen.values()) / total
        c = seen.get(w, 0)
        return (c - cut[min(c, 3)]) / total + back * memo[w]

    out = []
    for t in texts:
        w = [cls(x) for x in (t or "").encode().split()]
        lp = sum(math.log(p2(w[i], w[i - 1])) if i else math.log(p1(w[0])) for i in range(len(w)))
        out.append((len(w), lp))
    return out


def test_pack_round_trips():
    for x in (np.array([], np.uint32), np.arange(1000, dtype=np.uint32) * 7, np.array([5], np.uint64)):
        assert (L.unpack(L.pack(x), x.dtype) == x).all()
    k = np.array([0, 1, 77, (1 << 32) - 1], np.uint64)
    assert (L.unspread(L.spread(k)) == k).all()


def test_probabilities_equal_the_definition_and_sum_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()[:80]
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(-1, None), (-2, ""), (-3, "one"), (-4, "the the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    train = [r for r in rows if r[0] % 2 == 0]
    trusted = spark.createDataFrame([(i,) for i, _ in train], "doc_id long")
    counts, model, bits = L.trained(df, trusted)
    got = {r["doc_id"]: (r["n_words"], r["log_prob"]) for r in L.scores(df, counts, model, bits).collect()}
    want = dict(zip([i for i, _ in rows], brute([t for _, t in train], [t for _, t in rows])))
    assert got.keys() == want.keys()
    for i in got:
        assert got[i][0] == want[i][0]
        assert got[i][1] == pytest.approx(want[i][1], rel=1e-6, abs=1e-5), i
    assert model.p1.sum() == pytest.approx(1.0)


def test_untrained_model_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in L.classify(docs, labels).collect()}
    assert rows[1]["kept"] and rows[2]["kept"] and rows[2]["perplexity"] is None
    assert rows[1]["perplexity"] == pytest.approx(L.CLASSES)
    assert rows[2]["lang"] == "und"
    assert L.classify(docs.limit(0), labels).count() == 0


def test_junk_goes_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in L.op2_quality_lm(spark, sf).collect()}
    assert len(verdict) == docs.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [verdict[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [verdict[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.6


def test_nulls_repeats_and_extra_columns(spark):
    clean = "the cat sat on the mat and the dog sat on the rug"
    rows = [(i, f"{clean} {i}", "en", "x", 1) for i in range(60)] + [(None, clean, None, "y", 2), (None, "z z", "en", "y", 2), (5, f"{clean} 5", "en", "x", 1), (99, "%% " * 100_000, "en", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard string, n_chars int")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in L.classify(docs, labels).collect()}
    assert len(out) == 62 and out[5]["n_words"] == 28 and out[None]["n_words"] == 15
    assert out[3]["kept"] and not out[99]["kept"]


def test_a_few_trusted_documents_do_not_reject_clean_ones_of_their_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = {r["doc_id"] for r in docs.collect() if not set(r["text"] or "#") & set("#*$%&|<>") and len(r["text"].split()) >= 50}
    known = {r["doc_id"] for r in labels.collect()}
    rows = [r for r in L.classify(docs, labels).collect() if r["doc_id"] in clean - known]
    for lang in ("en", "de", "fr", "es"):
        gone = [not r["kept"] for r in rows if r["lang"] == lang]
        assert len(gone) > 40 and sum(gone) / len(gone) < 0.1, (lang, sum(gone), len(gone))


def test_thresholds_of_few_are_drawn_towards_all_languages(spark):
    many = [("en", i / 1000) for i in range(1000)]
    few = [("es", 5.0), ("es", 5.2)]
    got = {r["lang"]: r["threshold"] for r in L.thresholds(spark.createDataFrame(many + few, "lang string, score double")).collect()}
    assert got["en"] == pytest.approx(0.994, abs=0.002)
    assert got["es"] == pytest.approx(5.1 + 0.01 * 0.1 + 0.99 * 0.494, abs=0.01)
    assert L.thresholds(spark.createDataFrame([], "lang string, score double")).count() == 0

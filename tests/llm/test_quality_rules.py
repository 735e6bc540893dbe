import math
import re
from collections import Counter

from pyspark.sql import functions as F

from spanlab.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, t in enumerate(zip(w, w[1:], w[2:])):
        if c[t] > 1:
            hit |= {i, i + 1, i + 2}
    bad = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), dup, len(hit), bad


def test_whole_table_equals_brute_force(spark, sf_small):
    rows = Q.op6_quality_rules(spark, sf_small).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs}
    assert any(v[4] for v in got.values())
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_edge_texts(spark):
    texts = [None, "", " \n\t\x0b\x0c\r", "a", "a b c", "a b c a b c", "a a a a", "a a a a a", "x\x85y \xa0 z\x1cq", "l\nl\n l\nm\nl", "🎉 <b> é|", "w " * 30000, "a b c d\n" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = df.select("doc_id", Q.text_measures(F.col("text")).alias("m")).select("doc_id", "m.*").collect()
    for r in rows:
        b = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b[:5], texts[r["doc_id"]][:20]


def tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail_is_exact(spark):
    cases = [(10, 0), (100, 1), (1000, 3), (1000, 0), (1000, 7), (500, 1)]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", Q.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("t")).collect():
        want = tail(r["n"], r["k"], 0.01) if r["k"] < r["n"] * 0.01 else 1.0
        assert abs(r["t"] - want) < 1e-9 * max(want, 1e-3)
    big = spark.createDataFrame([(10_000_000, 99_000)], "n long, k long").select(Q.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("t")).first()["t"]
    assert 0.0005 < big < 0.001  # normal approximation: z = -3.18


def test_certified_cutoffs_keep_their_promise(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}###" for i in range(60))
    rows = [(i, good + f" x{i}", "en") for i in range(1500)] + [(10_000 + i, bad + f" x{i}", "en") for i in range(50)]
    rows += [(20_000 + i, bad, None) for i in range(20)] + [(30_000, None, "en"), (30_000, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(20_000 + i, 1) for i in range(20)] + [(None, 1)], "doc_id long, quality int")
    out = Q.judge(docs, labels, alpha=0.05).select("doc_id", "kept", "base_failed", "broken").collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert len(out) == len(rows)
    assert all(kept[i] for i in range(1500))
    assert not any(kept[10_000 + i] for i in range(50))  # same stratum, above the certified cutoff
    assert all(kept[20_000 + i] for i in range(20))  # 20 holdouts certify nothing: kept
    assert not kept[30_000]


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.judge(docs, labels).count() == 0
    docs = spark.createDataFrame([(1, "w " * 60, "en"), (2, " ".join(map(str, range(60))), "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["kept"] for r in Q.judge(docs, labels).collect()} == {1: False, 2: True}


def test_a_few_hundred_holdouts_certify_with_the_production_parameters(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}###" for i in range(60))
    strata = ["a", "b", "c", "d"]
    rows = [(1000 * s + i, good + f" x{i}", lang) for s, lang in enumerate(strata) for i in range(300)]
    rows += [(9000 + s, bad, lang) for s, lang in enumerate(strata)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, _, _ in rows if d < 9000], "doc_id long, quality int")
    out = Q.judge(docs, labels).select("doc_id", "kept", "broken").collect()
    assert {r["doc_id"] for r in out if not r["kept"]} == {9000, 9001, 9002, 9003}


def plain_cutoffs(rows, names, grid, b):
    out, rest = {}, list(rows)
    for i, name in enumerate(names):
        k = -(-b // (len(names) - i))
        fit = [c for c in grid if sum(v[i] > c for v in rest) < k]
        b -= min(k, 1 + sum(v[i] > grid[0] for v in rest))
        if fit:
            out[name] = (fit[0], sum(v[i] > fit[0] for v in rest))
            rest = [v for v in rest if v[i] <= fit[0]]
    return out


def test_certified_cutoffs_follow_the_plain_procedure_and_keep_the_share(spark):
    import random

    draw, names, grid, alpha, delta = random.Random(5), ["a", "b", "c"], [5, 10, 20, 40, 60, 80, 95], 0.02, 0.05
    sizes = {"p": 150, "q": 200, "r": 900, "s": 4000, "t": 20}

    def some():
        x = draw.random()
        return [int(90 * max(x, draw.random()) ** 8), int(90 * x**20), int(90 * draw.random() ** 5)]

    rows = {s: [some() for _ in range(n)] for s, n in sizes.items()}
    flat = [(s, [(k, v, grid) for k, v in zip(names, r)]) for s, x in rows.items() for r in x]
    values = spark.createDataFrame(flat, "stratum string, rules array<struct<rule:string,value:bigint,grid:array<bigint>>>")
    got = {s: {} for s in sizes}
    for r in Q.certified_cutoffs(values, alpha, delta).collect():
        assert r["n"] == sizes[r["stratum"]]
        got[r["stratum"]][r["rule"]] = (r["cutoff"], r["false_rejections"])
    for s, n in sizes.items():
        b = 0
        while b < n * alpha and tail(n, b, alpha) <= delta / 4:  # four strata can certify anything
            b += 1
        assert got[s] == plain_cutoffs(rows[s], names, grid, b), s
        assert sum(x for _, x in got[s].values()) < max(b, 1)
    assert not got["t"] and not got["p"] and len(got["s"]) == 3


def test_the_promise_holds_on_fresh_documents(spark):
    import random

    draw, names, grid = random.Random(7), ["a", "b"], list(range(0, 1000, 5))
    rows = [(str(s), [(k, int(1000 * draw.random()), grid) for k in names]) for s in range(200) for _ in range(600)]
    values = spark.createDataFrame(rows, "stratum string, rules array<struct<rule:string,value:bigint,grid:array<bigint>>>")
    cuts = {}
    for r in Q.certified_cutoffs(values, 0.05, 0.2).collect():
        cuts.setdefault(r["stratum"], {})[r["rule"]] = r["cutoff"]
    assert len(cuts) == 200
    # uniform values: a cutoff c keeps the share (c + 1) / 1000 of its rule
    risks = [1 - math.prod((c.get(k, 999) + 1) / 1000 for k in names) for c in cuts.values()]
    assert sum(x > 0.05 for x in risks) == 0 and max(risks) > 0.02

"""Golden rows for similarity, pair status, matching and span scores (FIXTURES §2)."""

import pytest
from pyspark.sql import functions as F

from spanlab.functions import similarity as S
from spanlab.operators import match as MA
from spanlab.operators import score as SC


def py_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def py_sim(a, b):
    if a == b:
        return 100
    if not a or not b:
        return 0
    return int(round(100 * (2 * py_lcs(a, b) / (len(a) + len(b)))))


def test_similarity_golden(spark):
    cases = [("joint pain", "joint pain", 100), ("nausea", "joint pain", 25), ("nausea", "headache", 29),
             ("bad sleep", "sleep", 71), ("bad sleep", "bad", 50), ("no sleep", "sleep", 77), ("", "pain", 0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [r[0] for r in df.select(S.similarity("a", "b")).collect()]
    assert got == [c for _, _, c in cases]


def test_similarity_brute_force(spark):
    import random

    rnd = random.Random(7)
    alphabet = "ab cdé"
    pairs = [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))),
              "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(S.similarity("a", "b")).collect()]
    assert got == [py_sim(a, b) for a, b in pairs]


def test_pair_status_golden(spark):
    cases = [("joint pain", "joint pain", "COR", "COR"), ("severe joint pain", "severe joint ache", "PAR", "INC"),
             ("joint pain", "pain joint", "INC", "INC"), ("joint pain", "sad mood", "INC", "INC"),
             ("severe joint pain", "joint", "PAR", "INC"), ("severe pain", "in", "PAR", "INC"),
             ("pain", "very bad ache", "INC", "INC")]
    df = spark.createDataFrame([(g, p) for g, p, _, _ in cases], "g string, p string")
    st = df.select(S.pair_status("g", "p").alias("s")).collect()
    assert [(r.s.partial, r.s.exact, r.s.strict) for r in st] == [(a, b, b) for _, _, a, b in cases]


def _table(spark, extra=()):
    rows = [("1", "none", "none"), ("2", "nausea; headache", "none"), ("3", "none", "x; y"),
            ("4", "nausea; joint pain", "joint pain"), ("5", "nausea", "nausea; headache"), *extra]
    return spark.createDataFrame(rows, "tweet_id string, gold_labels string, pred_labels string")


def test_eval_spans_golden(spark):
    m = MA.eval_spans(_table(spark))
    got = sorted((r.tweet_id, r.gold, r.pred, r.partial) for r in m.collect())
    assert got == sorted([
        ("1", "none", "none", "COR"), ("2", "nausea; headache", "none", "MIS"), ("3", "none", "x; y", "SPU"),
        ("4", "joint pain", "joint pain", "COR"), ("4", "nausea", "none", "MIS"),
        ("5", "nausea", "nausea", "COR"), ("5", "none", "headache", "SPU"),
    ])
    s = {r.level: r for r in SC.span_scores(m).collect()}
    for lv in ("partial", "exact", "strict"):
        assert (s[lv].correct, s[lv].missed, s[lv].spurius) == (3, 2, 2)
        assert s[lv].precision == pytest.approx(0.6) and s[lv].recall == pytest.approx(0.6)
        assert s[lv].f1_score == pytest.approx(0.6)


def test_span_scores_with_partial(spark):
    m = MA.eval_spans(_table(spark, [("6", "bad sleep", "sleep")]))
    s = {r.level: r for r in SC.span_scores(m).collect()}
    assert s["partial"].precision == pytest.approx(3.5 / 6)
    assert s["exact"].precision == pytest.approx(3 / 6) and s["strict"].recall == pytest.approx(3 / 6)


def test_span_scores_empty_raises_or_null(spark):
    m = spark.createDataFrame([("a", "b", "MIS", "MIS", "MIS")], "gold string, pred string, partial string, exact string, strict string")
    with pytest.raises(Exception):
        SC.span_scores(m).collect()
    r = SC.span_scores(m, on_empty="null").filter("level = 'exact'").first()
    assert r.precision is None


def test_greedy_matching_one_to_one(spark):
    rows = [("1", "a b; a c; d", "a b; a b; a c; e f")]
    m = MA.eval_spans(spark.createDataFrame(rows, "tweet_id string, gold_labels string, pred_labels string"))
    got = [(r.gold, r.pred) for r in m.collect()]
    golds = [g for g, _ in got if g != "none"]
    preds = [p for _, p in got if p != "none"]
    assert sorted(golds) == ["a b", "a c", "d"] and sorted(preds) == ["a b", "a b", "a c", "e f"]
    assert ("a b", "a b") in got and ("a c", "a c") in got


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "A")], "label string, pred string")
    rep = {r["class"]: r for r in SC.classification_report(df).collect()}
    assert rep["C"].precision == 0.0 and rep["C"].recall == 0.0 and rep["C"].f1_score == 0.0
    assert rep["accuracy"].f1_score == pytest.approx(0.5) and rep["accuracy"].support == 4
    assert rep["A"].precision == pytest.approx(0.5) and rep["A"].recall == pytest.approx(0.5)
    assert rep["macro avg"].support == 4


def _words_of_length(rnd, alphabet, lengths):
    return "".join(rnd.choice(alphabet) for _ in range(rnd.choice(lengths)))


def test_similarity_over_several_words(spark):
    import random

    rnd = random.Random(11)
    lengths = [1, 61, 62, 63, 123, 124, 125, 186, 187, 400]
    pairs = [(_words_of_length(rnd, al, lengths), _words_of_length(rnd, al, lengths)) for al in ("ab", "abcd é😀", "aaab") for _ in range(25)]
    pairs += [("a" * 400, "a" * 399), ("ab" * 100, "ba" * 100), ("x" * 200, "y" * 200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(S.similarity("a", "b")).collect()]
    assert got == [py_sim(a, b) for a, b in pairs]


def py_block(a, b):
    la, lb = a.lower(), b.lower()
    for n in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - n + 1):
            if la[i : i + n] in lb:
                return a[i : i + n]
    return ""


def test_common_block_brute_force(spark):
    import random

    rnd = random.Random(12)
    lengths = [0, 1, 2, 7, 30, 64, 200]
    pairs = [(_words_of_length(rnd, al, lengths), _words_of_length(rnd, al, lengths)) for al in ("aB", "Abcdé 😀") for _ in range(40)]
    pairs += [("xyABab", "ab zz xy"), ("a" * 300, "A" * 299), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(F.expr(S.common_block_sql("a", "b"))).collect()]
    assert got == [py_block(a, b) for a, b in pairs]


def py_greedy(gold, pred):
    order = sorted((-py_sim(g, p), i, j) for i, g in enumerate(gold) for j, p in enumerate(pred))
    used_g, used_p, out = set(), set(), []
    for _, i, j in order:
        if i not in used_g and j not in used_p:
            used_g.add(i)
            used_p.add(j)
            out.append((i, j))
    return out


def test_greedy_matching_equals_plain_fold(spark):
    import random

    rnd = random.Random(13)
    rows = []
    for n in (1, 3, 61, 62, 63, 130):
        rows.append(([_words_of_length(rnd, "abc", [1, 2, 3]) for _ in range(n)], [_words_of_length(rnd, "abc", [1, 2, 3]) for _ in range(max(1, 130 - n))]))
    df = spark.createDataFrame(rows, "g array<string>, p array<string>")
    got = [[(m.gi, m.pj) for m in r[0].m] for r in df.select(F.expr(MA._greedy_sql("g", "p"))).collect()]
    assert got == [py_greedy(g, p) for g, p in rows]

"""Golden rows for the column expressions (FIXTURES §2, SURVEY N1–N8)."""

from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import prompts as PR

EMOJI = [("❤", "red_heart"), ("👍", "thumbs_up"), ("👍🏽", "thumbs_up_medium_skin_tone")]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_clean_text_golden(spark):
    df = spark.createDataFrame(
        [(1, "so tired http://t.co/x now"), (2, "i ❤ sleep"), (3, "__bad__ snake_case"), (4, None), (5, "ok 👍🏽 and 👍")],
        "id int, t string",
    )
    out = dict(rows(df.select("id", T.clean_text("t", EMOJI).alias("c"))))
    assert out[1] == "so tired now"
    assert out[2] == "i :redheart: sleep"
    assert out[3] == "bad snakecase"
    assert out[4] is None
    assert out[5] == "ok :thumbsupmediumskintone: and :thumbsup:"


def test_strip_dots_and_normalise(spark):
    df = spark.createDataFrame([("..a.b..",), (" .x. ",), ("Nausea.",)], "t string")
    got = [r[0] for r in df.select(T.strip_dots("t")).collect()]
    assert got == ["a.b", " .x. ", "Nausea"]
    assert df.select(T.normalise_prediction("t")).collect()[2][0] == "nausea"


def test_span_offsets_golden(spark):
    df = spark.createDataFrame(
        [("Bad Headache today", "bad headache"), ("no pain, pain", "pain"), ("I feel fine", "nausea"), ("abc", "")],
        "tweet string, p string",
    )
    got = rows(df.select(T.span_start("tweet", "p"), T.span_end("tweet", "p")))
    assert got == [(0, 12), (3, 7), (-1, 5), (0, 0)]


def test_binarise_null_and_garbage(spark):
    df = spark.createDataFrame([("healthy okay",), ("adverse event problem",), (None,), ("xyz",)], "p string")
    assert [r[0] for r in df.select(T.binarise("p")).collect()] == ["NoADE", "ADE", "ADE", "ADE"]


def test_split_spans_keeps_empty_parts(spark):
    df = spark.createDataFrame([("None",), ("a; b; ",), (None,)], "s string")
    assert [r[0] for r in df.select(T.split_spans("s")).collect()] == [[], ["a", "b", ""], []]


def test_map_target_strict_raises(spark):
    import pytest

    df = spark.createDataFrame([("ADE",), ("weird",)], "l string")
    ok = df.limit(1).select(T.map_target("l", T.CLASS_TARGETS)).collect()[0][0]
    assert ok == "adverse event problem"
    with pytest.raises(Exception):
        df.select(T.map_target("l", T.CLASS_TARGETS)).collect()
    assert df.select(T.map_target("l", T.CLASS_TARGETS, strict=False)).collect()[1][0] is None


def test_prompt_round_trip_and_marker_case(spark):
    df = spark.createDataFrame(
        [("1", "x {} y", "nausea"), ("2", "t", "none"), ("3", "t", "a.b")], "tweet_id string, input_text string, target_text string"
    )
    applied = PR.apply_prompts(df.withColumn("prefix", F.lit("p")))
    back = PR.unwrap(applied).select("prompt", "tweet_id", "target_text", "input_text")
    got = {(r[0], r[1]): (r[2], r[3]) for r in back.collect()}
    assert got[("prompt1", "1")] == ("nausea", "Is there a negative drug effect in: x {} y")
    assert got[("prompt2", "2")][0] == "none"
    assert got[("prompt3", "3")][0] == "a.b"
    t = applied.filter("prompt = 'prompt2' AND tweet_id = '2'").select("target_text").first()[0]
    assert t == "No, the patient didn’t suffer from a side effect."
    low = spark.createDataFrame([("yes, the patient suffered from nausea.",)], "c string")
    assert low.select(T.unwrap_prompt("c", "Yes, the patient suffered from ")).first()[0] == "none"


def test_span_offsets_slice_equals_span(spark, sf_small):
    """SURVEY §5 property: text[start:end] equals the span (case-insensitive) for every found span."""
    from spanlab.plans import testviews as V

    r = V.span_runs(spark, sf_small).withColumn("p", T.strip_dots("predicted_text")).filter(T.has_span("p"))
    x = r.select("tweet", "p", T.span_start("tweet", "p").alias("s"), T.span_end("tweet", "p").alias("e")).filter("s >= 0")
    bad = x.filter(F.lower(F.expr("substring(tweet, s + 1, e - s)")) != F.lower(F.col("p"))).count()
    assert x.count() > 0 and bad == 0


def _emoji_table():
    """4,000 made-up sequences: single code points, skin tones, joined pairs, flags, keycaps."""
    tones = [chr(0x1F3FB + i) for i in range(5)]
    table = {chr(0x1F300 + i): f"e{i}" for i in range(0xE0)}
    for i in range(500):
        base = chr(0x1F400 + i)
        table.setdefault(base, f"base{i}")
        for k, tone in enumerate(tones):
            table[base + tone] = f"base{i}_tone{k}"
        table[base + "‍❤️‍" + base] = f"pair{i}"
    for a in range(26):
        for b in range(20):
            table[chr(0x1F1E6 + a) + chr(0x1F1E6 + b)] = f"flag_{a}_{b}"
    for ch in "0123456789#*":
        table[ch + "️⃣"] = f"keycap_{ch}"
    return dict(list(table.items())[:4000]) | {"#️⃣": "keycap"}


def _replace_longest(text, table):
    out, i, longest = [], 0, max(map(len, table))
    while i < len(text):
        for n in range(min(longest, len(text) - i), 0, -1):
            if text[i : i + n] in table:
                out.append(f":{table[text[i:i + n]]}:")
                i += n
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_demojize_four_thousand_entries(spark):
    import random

    table = _emoji_table()
    assert len(table) > 3500
    r = random.Random(2)
    keys = list(table)
    texts = [None, "", "no emoji # 1", "".join(keys[:300]), "\U0001F1E6\U0001F1E7\U0001F1E6", "1️⃣2️", "\U0001F3FB" * 3]
    for _ in range(200):
        texts.append("".join(r.choice([r.choice(keys), r.choice(keys)[:1], r.choice(["a", " ", "‍", "️", "é", "$1", "\\"])]) for _ in range(r.randint(1, 30))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", "t", T.demojize("t", table.items()).alias("o"))
    for row in out.collect():
        assert row.o == (None if row.t is None else _replace_longest(row.t, table)), row.t


def test_demojize_expression_does_not_deepen(spark):
    def depth(n):
        table = [(chr(0x1F300 + i), f"e{i}") for i in range(n)]
        plan = spark.range(1).selectExpr("string(id) t").select(T.demojize("t", table).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("replace("), plan.count("CASE WHEN"), plan.count("transform(")

    assert depth(3) == depth(900)


def test_demojize_long_text_in_one_pass(spark):
    long = ("word \U0001F600 and \U0001F44D\U0001F3FD " * 20_000).strip()
    table = {"\U0001F600": "grin", "\U0001F44D": "up", "\U0001F44D\U0001F3FD": "up_medium"}
    got = spark.createDataFrame([(long,)], "t string").select(T.demojize("t", table.items())).first()[0]
    assert got == long.replace("\U0001F600", ":grin:").replace("\U0001F44D\U0001F3FD", ":up_medium:")


def test_cleaning_by_quick_looks_is_the_plain_cleaning(spark):
    """Patterns that pass ordinary characters by find what the plain ones find."""
    from spanlab.plans import testviews as V

    texts = ["HTTP://a.b c", "xhttp://a b", "éwww.x y", "-www.x_y__z", "wwww.q www. q r", "WwW.😀 😀_💊", "ſhttp://x", "\t\n hh  ww www.z", "❤ 👍🏽👍", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = T.emoji_pattern([e for e, _ in V.EMOJI_TABLE]).split(")", 1)[1]  # without the range
    urls = F.regexp_replace("t", T.URL_PATTERN, "")
    for r in df.select(T.strip_urls("t").alias("a"), F.trim(F.regexp_replace(urls, T.WHITESPACE_RUN, " ")).alias("b"),
                       T.strip_underscores("t").alias("c"), F.regexp_replace("t", "_+", "").alias("d"),
                       F.split("t", T.emoji_pattern([e for e, _ in V.EMOJI_TABLE])).alias("e"), F.split("t", plain).alias("f")).collect():
        assert (r.a, r.c, r.e) == (r.b, r.d, r.f)
    assert plain.startswith("(?=[") and "(?=[hw])" in T.URL_PATTERN_JAVA

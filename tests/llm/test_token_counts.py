from collections import Counter

import pytest
import sentencepiece

from spanlab.llm import token_counts as T

MIXED = [
    None,
    "",
    " ",
    "  ",
    "a",
    "a ",
    "a  ",
    " a",
    "   a   b  ",
    "line\nline\n\n  indented\tx",
    "▁a ▁ b▁",
    "</s> <s> <unk> <0x0A>",
    "🎉é　x y\x00z ﬁ",
    "x" * 5000,
    "word " * 30_000,
    " " * 70 + "deep" + " " * 70,
    "same text",
    "same text",
]


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=T.default_tokenizer())


def frame(spark, texts, parts=3):
    rows = [(i if i % 5 else None, t, "n", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, top string").repartition(parts)


def expected(texts, processor):
    return Counter((i if i % 5 else None, len((t or "").encode()), n := len(processor.encode(t or "")), n > T.LIMIT) for i, t in enumerate(texts))


def test_edge_texts(spark, processor):
    got = T.token_counts(frame(spark, MIXED))
    assert Counter(map(tuple, got.collect())) == expected(MIXED, processor)
    assert sum(r[3] for r in expected(MIXED, processor)) == 1


def test_whole_table_equals_library(spark, processor):
    sf_dir = "/root/testdata/sf0.01"
    got = {tuple(r) for r in T.op12_token_counts(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {(d, len((t or "").encode()), n := len(processor.encode(t or "")), n > T.LIMIT) for d, t in docs}


def test_every_tier_gives_the_same(processor, monkeypatch):
    """Table only, cache only, generations that turn over all the time."""
    path = T.default_tokenizer()
    texts = [t or "" for t in MIXED] + [f"w{i} w{i % 7} w{i % 13}" for i in range(300)]
    keys = sorted({k for t in texts for k in T.pretokens(t)})
    table = dict(zip(keys, T.Pieces.of(path).lengths(keys)))
    want = [len(ids) for ids in processor.encode(texts)]
    assert T.Lengths(path, table).count(texts) == want
    assert T.Lengths(path, {}).count(texts) == want
    monkeypatch.setattr(T, "CACHE", 3)
    small = T.Lengths(path, {})
    assert [small.count([t])[0] for t in texts] == want
    assert len(small) <= 3 + max(len(set(T.pretokens(t))) for t in texts)


def test_pretokens_put_together_are_the_text():
    for t in MIXED:
        t = (t or "").replace(T.MARK, " ")
        assert "".join(" " + k for k in T.pretokens(t)) == (" " + t if t else "")


def test_packed_table_keeps_every_key():
    rows = [("", 1), ("  a", 2), ("x\ny", 30), ("é", 4)]
    assert list(T.unpack_table(T.pack_table(rows))) == rows
    assert list(T.unpack_table(T.pack_table([]))) == []


def test_frequent_table_over_many_tasks(spark, monkeypatch):
    texts = [f"common{i % 3} rare{i}" for i in range(400)]
    frequent = dict(T.unpack_table(T.frequent_table(frame(spark, texts, 150), T.default_tokenizer())))
    assert {"common0", "common1", "common2", "rare7"} <= set(frequent)
    processor = sentencepiece.SentencePieceProcessor(model_file=T.default_tokenizer())
    assert all(n == len(processor.encode(k)) for k, n in frequent.items())


def test_empty_table(spark):
    assert T.token_counts(frame(spark, [], 1)).collect() == []

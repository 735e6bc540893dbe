import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanlab.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.default_tokenizer())


def check(df, rows, tokenizer):
    """Exact round trip: pieces tile every document, sequences are gapless and not padded."""
    pieces = [r.asDict() for r in P.packed(df).collect()]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    assert by_doc.keys() == want.keys()
    for d, texts in want.items():
        expected = sorted((s["start"], s["length"]) for s in by_doc[d])
        assert sum(n for _, n in expected) == sum(map(len, texts))
        if len(texts) == 1:
            ids, at = np.array(texts[0], "<u4"), 0
            for p in sorted(by_doc[d], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= P.WINDOW and at & (at - 1) == 0
    return pieces


def test_whole_table_round_trips(spark, sf_small, tokenizer):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    pieces = check(docs.repartition(5), rows, tokenizer)
    total = sum(p["length"] for p in pieces)
    assert len({p["sequence_id"] for p in pieces}) <= total // P.WINDOW + 12


def test_edge_texts(spark, tokenizer):
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, "one"), (None, "null id"), (5, "x " * 2047), (6, "x " * 2048), (7, "x" * 3000),
        (8, "İstanbul ΣΑΣ é é ﬁ  z \x85 \x1c 12a'll DON'T <|endoftext|> 🎉🎉!!"), (9, "long text " * 30_000), (10, "same"), (10, "same"),
    ]
    df = spark.createDataFrame([(a, b, 5, 6) for a, b in rows], "doc_id long, text string, n int, part int")
    check(df, rows, tokenizer)


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch, tokenizer):
    words = P.WordIds(P.default_tokenizer())
    monkeypatch.setattr(P, "MEMO", 5)
    texts = [b"the cat sat on the mat, really", b"other words come in now and then", b""]
    for _ in range(2):
        for t in texts:
            assert words.encode(pa.array([t.decode()]))[0].tolist() == tokenizer.encode(t.decode(), add_special_tokens=False).ids


def test_nnls_against_enumeration():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = P.nnls(a, np.array([4.0, 1]))
    assert np.allclose(a @ x, [4, 1]) and (x >= 0).all()
    assert np.allclose(P.nnls(np.array([[1.0], [1.0]]), np.array([-1.0, -2])), 0)
    rng = np.random.default_rng(0)
    a, b = rng.random((6, 4)), rng.random(6)
    x = P.nnls(a, b)
    grad = a.T @ (b - a @ x)  # optimality: no slope where zero, none left elsewhere
    assert (grad[x == 0] < 1e-6).all() and np.abs(grad[x > 0]).max() < 1e-6


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 400, P.WINDOW // P.UNIT)
    plan = P.Plan(h, 10, 1234)
    seen = defaultdict(list)
    for u in range(1, len(h)):
        for q in range(h[u]):
            spot = plan.place(u, q)
            if spot:
                seen[spot[0]].append((spot[1], u * P.UNIT))
    for seq, parts in seen.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == P.WINDOW and 10 <= seq < plan.stream
    assert plan.used[1:].sum() > 0.8 * h[1:].sum()  # few mains are left over


def test_words_from_pre_tokens_equal_the_tokenizer(tokenizer, monkeypatch):
    """Every plain character beside every kind of neighbour, and memories that turn over all the time."""
    plain = [chr(c) for c in range(0x21, 0x180) if not P.NOT_PLAIN.search(chr(c))]
    kinds = ["", "a", "Z", "7", "_", "'", "'s", "'LL", "''", "<|", "é", "Ÿ"]
    words = [a + c + b for c in plain for a in kinds for b in kinds]
    words += ["don't've'LL", "'S'T'RE", "<|endoftext|>x", "a<|b", "Ünïcode_text__x1234", "éa", "ſİ²½ª×÷ŉ", "ΣΑΣ", "...''s"]
    texts = [" ".join(words[i : i + 50]).encode() for i in range(0, len(words), 50)]
    want = [e.ids for e in tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in P.WordIds(P.default_tokenizer()).encode(pa.array([t.decode() for t in texts]))] == want
    monkeypatch.setattr(P, "MEMO", 40)
    small = P.WordIds(P.default_tokenizer())
    assert [small.encode(pa.array([t.decode()]))[0].tolist() for t in texts * 2] == want * 2
    assert len(small.words.young.index) < 200 and len(small.parts.young.index) < 300


def test_whole_documents_equal_the_tokenizer(spark, tokenizer):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    got = P.WordIds(P.default_tokenizer()).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_groups_hold_every_text_once():
    from spanlab.llm import packing

    texts = ["x" * 10, None, "", "y" * (packing.GROUP_BYTES + 5), "z" * packing.GROUP_BYTES, "w", None]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    out = list(packing.groups(batch, "text"))
    assert [d for b in out for d in b.column(0).to_pylist()] == list(range(7))
    assert [t for b in out for t in b.column(1).to_pylist()] == texts
    assert [b.num_rows for b in out] == [3, 1, 1, 2] and list(packing.groups(batch.slice(0, 0), "text")) == []


def test_slices_nulls_and_white_space(tokenizer):
    """Arrow slices with an offset, nulls, texts of white space alone, and characters near the white space."""
    texts = ["cut", None, "", " \t\n\r\x0b\x0c ", " a  b\n", "x\x1cy \x85 z\xa0w", "A\x00b", "café\u2003au", None]
    got = P.WordIds(P.default_tokenizer()).encode(pa.array(texts).slice(1))
    assert [x.tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]


def test_a_worker_splits_about_a_megabyte_of_texts_at_a_time():
    import pyarrow as pa

    from spanlab.llm import packing as P

    batch = pa.RecordBatch.from_pydict({"text": ["word " * 2000] * 300 + [None, "x" * (3 << 20), "y"]})
    slices = list(P.groups(batch, "text"))
    assert sum(s.num_rows for s in slices) == batch.num_rows
    assert all(s.num_rows == 1 or sum(len(t or "") for t in s.column("text").to_pylist()) <= 1 << 20 for s in slices)

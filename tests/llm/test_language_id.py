import zlib

import numpy as np

from spanlab.llm import language_id as L


def test_held_out_accuracy_and_fields(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op5_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    right = n = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["held_out"] and docs[r["doc_id"]]["lang"]:
            n += 1
            right += r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert n > 200 and right / n > 0.97


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "s", 0.5) for a, b, c in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_edge_texts_and_unknown_languages(spark):
    texts = {"en": "the house and the garden with that", "de": "das haus und der garten mit dem", "fr": "la maison et le jardin avec les", "xx": "zyqq wkzz qqyz zzkw qyqy"}
    rows = []
    for i in range(40):
        lang = list(texts)[i % 4]
        rows.append((i, f"{texts[lang]} {'abc'[i % 3]}", lang))
    extra = [(100, None, "en"), (101, "", "en"), (102, "12 34 !!", None), (103, "DAS HAUS!! UND%%% DER*** GARTEN", None), (104, "la maison " * 50_000, None), (None, "the garden", "en"), (104, "la maison " * 50_000, None), (105, "É", None)]
    out = L.identify(frame(spark, rows + extra)).collect()
    assert len(out) == len(rows) + len(extra)
    got = {r["doc_id"]: r for r in out}
    for i in (100, 101, 102):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[103]["lang_pred"] == "de" and got[104]["lang_pred"] == "fr" and got[None]["lang_pred"] == "en"
    assert got[105]["lang_pred"] in texts and not got[None]["held_out"]
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)


def test_without_labels_and_with_one_language(spark):
    out = L.identify(frame(spark, [(1, "some text", None)])).collect()
    assert (out[0]["lang_pred"], out[0]["score"]) == ("und", 0.0)
    out = L.identify(frame(spark, [(i, f"some text {i}", "en") for i in range(9)])).collect()
    assert all((r["lang_pred"], r["score"]) == ("en", 1.0) for r in out)
    assert L.identify(frame(spark, []).limit(0)).count() == 0


def test_sample_is_bounded_and_ignores_copies(spark):
    rows = [(i, f"text number {i} of many", "en") for i in range(300)] + [(1000 + i, "copy of one text", "de") for i in range(200)]
    x, langs = L.training_sample(frame(spark, rows).select("text", "lang"), per_language=20)
    assert langs.count("en") <= 20 and langs.count("de") == 1 and np.allclose(np.linalg.norm(x, axis=1), 1)


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.1 > 0, 1.0, -1.0)
    w = L.svm(x, y, epochs=200)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97

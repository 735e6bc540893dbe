import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from spanlab.llm import decontaminate, lm_quality, ngram_join, packing, secret_scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Documents before and after every stage."""
    docs = [C.table(spark, SF, "documents")]
    for name, stage in C.STAGES:
        docs.append(C.written(stage(spark, docs[-1], SF), f"test-{name}"))
    return docs


def test_stages_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality_lm", "near_duplicates", "decontaminate", "secret_scan", "packing"]
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < stages[4].count() < stages[0].count()


def test_quality_stage_keeps_clean_documents(spark, stages):
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r["doc_id"] in kept for r in labels if r["quality"] == 1]
    assert np.mean(good) > 0.97


def test_near_duplicate_stage_keeps_one_of_each(spark, stages):
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.components(stages[1].select("doc_id", "text")).collect()}
    kept = {r["doc_id"] for r in stages[2].select("doc_id").collect()}
    assert kept == set(found.values())


def test_decontamination_and_secrets_take_effect(spark, stages):
    assert decontaminate.overlaps(stages[3], C.table(spark, SF, "benchmark")).count() == 0
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert before.keys() == after.keys()
    base = [r.kind for r in secret_scan.BASE_RULES]
    by_path, _, _ = secret_scan.scan_versions(stages[3].select("doc_id", "text"), path="doc_id")
    changed = {r["path"] for r in by_path.select("path", "findings").collect() if r["findings"]}
    assert {d for d in before if before[d] != after[d]} == changed and changed
    again, _, _ = secret_scan.scan_versions(stages[4].select("doc_id", "text"), path="doc_id")
    assert again.filter("size(findings) > 0").select(secret_scan.kind_count(again["findings"], base[2]).alias("n")).agg({"n": "sum"}).first()[0] in (None, 0)


def test_run_returns_the_packed_pieces(spark, stages):
    out = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in C.run(spark, SF).collect())
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r["doc_id"]: np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [1], "<u4") for r in stages[4].collect()}
    assert {d for d, *_ in out} == set(ids)
    for d, start, length, crc in out:
        assert crc == zlib.crc32(ids[d][start : start + length].tobytes())
    assert sum(length for _, _, length, _ in out) == sum(map(len, ids.values()))


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "some text here", "en", "s", 14), (1, "some text here", "en", "s", 14), (None, None, None, None, None), (2, "", "en", "s", 0), (None, "token=abcdef1 x", "en", "s", 15)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, stage in C.STAGES:
        df = spark.createDataFrame(rows, schema)
        out = stage(spark, df, SF)
        if name != "packing":
            assert out.columns == df.columns and out.count() == len(rows), name
        assert stage(spark, df.limit(0), SF).count() == 0, name


def test_near_duplicates_by_id_and_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    rows = [
        (None, text), (None, text), (None, near), (None, ""), (None, ""), (None, None),
        (7, "one text of an id that has two"), (7, "quite another text under the same id"), (3, "one text of an id that has two"),
        (None, "alone without an id"), (None, "alone without an id"), (9, "said twice"), (9, "said twice"), (None, "said twice"),
    ]
    df = spark.createDataFrame([(a, b, "en", "s", i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r["doc_id"] or 0, r["text"] or "") for r in ngram_join.stage_near_duplicates(spark, df, SF).collect()))
    blocks = [t for d, t in out if d == 0 and t.startswith("w0")]
    assert len(blocks) == 1
    assert [x for x in out if not x[1].startswith("w0")] == sorted(
        [(0, ""), (0, ""), (0, ""), (0, "alone without an id"), (3, "one text of an id that has two"), (7, "quite another text under the same id"), (9, "said twice"), (9, "said twice")]
    )


def test_quality_stage_judges_texts_not_ids(spark, stages):
    docs, labels = stages[0].filter("lang = 'en'"), spark.read.parquet(f"{SF}/labels.parquet")
    bad = docs.join(stages[1], "doc_id", "left_anti").join(labels.filter("quality = 0"), "doc_id").orderBy("doc_id").first()["text"]
    kept = docs.join(stages[1].select("doc_id"), "doc_id", "left_semi")
    plain = kept.join(labels, "doc_id", "left_anti").filter("n_chars > 500").orderBy("doc_id").first()
    clean = plain["text"]
    extra = [(None, bad, "en", "x", 1), (None, clean, "en", "x", 1), (plain["doc_id"], bad, "en", "x", 1)]
    out = lm_quality.stage_quality(spark, stages[0].unionByName(spark.createDataFrame(extra, docs.schema)), SF)
    left = {(r["doc_id"], r["text"]) for r in out.filter(out["doc_id"].isNull() | (out["doc_id"] == plain["doc_id"])).collect()}
    assert left == {(None, clean), (plain["doc_id"], clean)}

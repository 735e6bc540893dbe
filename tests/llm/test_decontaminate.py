import itertools

import duckdb
import pytest

from spanlab.llm import decontaminate as D


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


PASSAGE = " ".join(f"word{i}" for i in range(20))


def test_masks_hit_every_window_with_two_changes():
    for changed in itertools.combinations(range(D.WINDOW), 2):
        hit = False
        for mask in D.MASKS:
            for at in range(D.WINDOW - len(mask) + 1):
                hit |= all(at + k not in changed for k, c in enumerate(mask) if c == "1")
        assert hit, changed


def test_substitutions_are_tolerated_and_near_misses_are_not(spark):
    w = PASSAGE.split()
    two = w[:3] + ["x"] + w[4:9] + ["y"] + w[10:]
    many = [x if i % 3 else "z" for i, x in enumerate(w)]
    docs = [
        (1, "Before, text. " + PASSAGE.upper().replace(" ", "%% ") + " after"),
        (2, "a b c " + " ".join(two) + " d"),
        (3, " ".join(many)),
        (4, " ".join(w[5:18])),
        (5, " ".join(w[5:15])),
        (6, None),
        (7, ""),
        (1, PASSAGE),
        (None, PASSAGE),
        (9, "filler " * 100_000 + PASSAGE),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, row string")
    bench = items(spark, [PASSAGE, None, "", "short item"]).selectExpr("item_id", "text", "1 as h")
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["start"], r["n_matched"]) for r in D.overlaps(df, bench).collect()))
    assert got == [(0, 0, 0, 20), (1, 0, 0, 20), (1, 0, 2, 20), (2, 0, 3, 18), (4, 0, -5, 13), (9, 0, 100_000, 20)]


def test_repeated_items_and_empty_tables(spark):
    df = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    rows = D.overlaps(df, items(spark, [PASSAGE, PASSAGE])).collect()
    assert sorted(r["item_id"] for r in rows) == [0, 1]
    assert D.overlaps(df, items(spark, [PASSAGE]).limit(0)).count() == 0
    assert D.overlaps(df.limit(0), items(spark, [PASSAGE])).count() == 0


def test_stage_drops_leaks_only(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept = D.stage_decontaminate(spark, docs, sf_small)
    leaks = {r["doc_id"] for r in D.op1_decontaminate(spark, sf_small).collect()}
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - leaks


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_whole_table_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = sorted(con.execute(D.ORACLE).fetchall())
    got = sorted(tuple(r) for r in D.op1_decontaminate(spark, sf).collect())
    assert got == want and got


def test_stage_judges_each_row_by_its_own_text(spark, sf_small):
    leak = spark.read.parquet(f"{sf_small}/benchmark.parquet").first()["text"]
    rows = [(None, leak), (None, "clean words"), (None, None), (1, f"x {leak}"), (1, "other clean words"), (2, leak)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in D.stage_decontaminate(spark, docs, sf_small).collect()]
    assert sorted(out, key=str) == sorted([(None, "clean words"), (None, None), (1, "other clean words")], key=str)


@pytest.mark.parametrize("length", range(1, 13))
def test_short_masks_hit_all_allowed_changes(length):
    changes = length - -(-length * 8 // 10)
    masks = D.short_masks(length)
    assert all(len(m) == length and "1" in m for m in masks)
    for changed in itertools.combinations(range(length), changes):
        assert any(all(k not in changed for k, c in enumerate(m) if c == "1") for m in masks), changed


def test_short_items_are_found_with_their_allowed_changes(spark):
    texts = {n: [f"item{n}word{i}" for i in range(n)] for n in range(1, 14)}
    docs, wanted = [], set()
    for n, w in texts.items():
        allowed = n - -(-n * 8 // 10)
        for c in range(allowed + 2):
            for at, changed in enumerate(itertools.combinations(range(n), c)):
                if c > allowed and at > 3:
                    break
                doc_id = len(docs)
                body = ["other" if i in changed else x for i, x in enumerate(w)]
                docs.append((doc_id, " ".join(["lead", "in"] + body + ["tail"])))
                if c <= allowed:
                    wanted.add((doc_id, n, 2, n - c))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in texts.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["n_matched"]) for r in D.overlaps(df, bench).collect()}
    assert got == wanted

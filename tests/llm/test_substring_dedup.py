import hashlib
import random

import duckdb
import pytest
import xxhash

from spanlab.llm import substring_dedup as S


def key(d, text):
    """Null ids last; rows of one id by a hash of their text (Spark's, signed)."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return (float("inf") if d is None else d, h - (1 << 64) if h >> 63 else h)


def brute(rows):
    """rows: (doc_id, text); a null id comes last, rows alike in id and text are one document."""
    words = [(key(d, t), (t or "").encode().split()) for d, t in rows]
    first = {}
    for k, w in words:
        for i in range(len(w) - 19):
            run = tuple(w[i : i + 20])
            first[run] = min(first.get(run, (k, i)), (k, i))
    out = []
    for (d, _), (k, w) in zip(rows, words):
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (k, i):
                gone.update(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in S.deduplicated(df).collect()), key=str)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, at int, doc string").repartition(parts)


def test_edge_texts(spark):
    p = [f"w{i}" for i in range(60)]
    t = " ".join
    rows = [
        (1, t(p)), (2, t(p)), (3, t(p[:19])), (4, t(p[5:25])), (5, t(p[5:24])), (6, t(["x"] * 50)), (7, t(["x"] * 20)),
        (8, t(p[:30] + ["q"] + p[31:])), (9, t(p[30:] + p[:30])), (10, None), (11, ""), (12, " \n\t "), (None, t(p)), (None, None),
        (1, t(p)), (13, t(p[40:] + ["y"] * 3) + "\x85 \xa0 z"), (14, t(p + p)), (15, t(["a", "b"] * 40_000)),
    ]
    assert got(frame(spark, rows)) == brute(rows)


def test_rows_without_an_id_and_texts_of_one_id_are_told_apart(spark):
    p, t = [f"w{i}" for i in range(60)], " ".join
    rows = [
        (None, t(p[:25])), (None, "a b c"), (5, t(p[:25])), (None, t(p[30:55])), (None, t(["z"] + p[30:55])), (None, t(p[30:55])),
        (7, t(p)), (7, t(["q"] * 3 + p[10:40])), (7, "only these words"), (7, None), (7, t(p)), (8, t(p[20:50])), (None, None), (None, ""),
    ]
    found = got(frame(spark, rows))
    assert found == brute(rows)
    assert (None, 3, 0, hashlib.sha256(b"a b c").hexdigest()) in found and (7, 3, 0, hashlib.sha256(b"only these words").hexdigest()) in found


@pytest.mark.parametrize("seed", [1, 2])
def test_random_repeats(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pool = [[f"p{k}_{i}" for i in range(rng.randint(15, 60))] for k in range(6)]
    rows = []
    for d in range(150):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(pool)[rng.randint(0, 10) :] if rng.random() < 0.5 else [f"r{rng.randint(0, 3)}" for _ in range(rng.randint(0, 30))]
        rows.append((d * 7919 % 1009, " ".join(w)))
    assert got(frame(spark, rows, 9)) == brute(rows)


def test_small_chunks_change_nothing(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(docs.repartition(6)) == brute(rows)


def test_paths_are_maximal_and_name_their_source(spark):
    p = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(["a"] + p)), (2, " ".join(p)), (3, " ".join(p[:30] + p[:25]))]
    words = {d: t.split() for d, t in rows}
    paths = {r["doc"]: r for r in S.repeated_spans(frame(spark, rows)).collect()}
    assert set(paths) == {2, 3}
    spans = {d: list(zip(r["starts"], r["edges"])) for d, r in paths.items()}
    assert spans == {2: [(0, 31)], 3: [(0, 11), (30, 6)]}
    for d, r in paths.items():
        for at, m, source, source_at in zip(r["starts"], r["edges"], r["sources"], r["source_starts"]):
            assert (source, source_at) < (d, at)
            assert words[d][at : at + m + 19] == words[source][source_at : source_at + m + 19]


def test_empty_table(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(S.ORACLE).fetchall())
    rows = sorted(tuple(r) for r in S.op3_substring_dedup(spark, sf).collect())
    assert rows == want and any(r[2] for r in rows)

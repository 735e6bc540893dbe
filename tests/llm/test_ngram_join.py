import random
import re
import tracemalloc

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from spanlab.llm import arrays
from spanlab.llm import ngram_join as N
from spanlab.llm.graph import connected_components


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    s = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                root[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((d, len(s[i]), (min(ids) if ids else None) if s[i] else d))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.components(df).collect()), key=str)


def test_filter_agrees_with_spark(spark):
    values = [0, 1, -1, 12345, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", F.xxhash64("v").alias("h")).collect():
        assert r["h"] & ((1 << 64) - 1) == xxhash.xxh64_intdigest(r["v"].to_bytes(8, "little", signed=True), seed=42)
    field = arrays.id_filter(df, "v")
    assert all(arrays.has(field, v) for v in values)
    assert sum(arrays.has(field, v) for v in range(1000, 2000)) == 0


def test_edge_texts(spark):
    base = [f"w{i}" for i in range(60)]

    def changed(*at):
        return " ".join("x" if i in at else w for i, w in enumerate(base))

    rows = [
        (7, " ".join(base)), (3, changed(30)), (9, changed(30, 31)), (2, changed(5)), (11, changed(10, 30, 50)),
        (20, "one two"), (21, "ONE\ttwo"), (22, "one  two three"), (23, "one\x85two"), (24, None), (25, ""), (26, " \n"), (None, "one two"),
        (None, None), (7, " ".join(base)), (30, "a b c d e"), (31, "A B C D E"), (32, "é É a b c"), (33, "É É a b c"),
        (40, "spam " * 50_000), (41, "spam " * 7), (None, "lone words of a row without any id"),
    ]
    df = spark.createDataFrame([(a, b, i, 1) for i, (a, b) in enumerate(rows)], "doc_id long, text string, cls int, token int")
    assert got(df) == brute(rows)


def test_links_across_a_chain_of_edits(spark):
    # every text is one word away from the next; ends are far apart
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        rows.append((100 - k, " ".join(f"c{i}" if i < k else w for i, w in enumerate(base))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(df) == brute(rows)
    assert len({r[2] for r in got(df)}) == 1


def test_shared_passage_links_only_what_is_near(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{' '.join(f'u{i}_{k}' for k in range(i % 9))} {passage}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.components(df).count() == 0


def test_whole_table_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(N.ORACLE).fetchall())
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.op4_ngram_join(spark, sf).collect())
    assert rows == want
    assert any(r[0] != r[2] for r in rows)


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    out = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert out == {**{i: 100 for i in range(100, 401)}, **{k: 1000 for k in range(1000, 1200)}}
    assert connected_components(df.limit(0)).count() == 0


def test_words_and_sets_of_odd_texts():
    pieces = ["a", "B", "b", "ab", "é", "É", "\x85", "\xa0", "\x00", "\x1f", " ", "\t", "\n", "\v", "\f", "\r", "x" * 300]
    rng = random.Random(3)
    texts = [None, "", " ", "a", " a", "a "] + ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(300)]
    texts.append(" ".join(f"Long{i % 977}" for i in range(60_000)))  # above the size of a group
    known: dict = {}
    got_sets = list(N.shingle_sets(None if t is None else t.encode() for t in texts))
    assert len(got_sets) == len(texts)
    for t, s in zip(texts, got_sets):
        assert len(s) == len(sets_of(t)) and (np.diff(s.astype(object)) > 0).all()
        assert known.setdefault(frozenset(sets_of(t)), s.tobytes()) == s.tobytes()
    assert len(set(known.values())) == len(known)
    words = [w for t in texts if t for w in t.encode().lower().split()]
    h, first = arrays.word_hashes([t.encode() for t in texts if t], 1 << 30)
    assert len(h) == len(words) == first[-1] and len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    part, _ = arrays.word_hashes([texts[-1].encode()], 1000)
    assert (part == h[-len(part) :]).all() and len(part) == 60_000


def test_order_takes_little_memory():
    counts = np.random.default_rng(1).poisson(3, N.BUCKETS).astype(np.int64)
    counts[77] = 1 << 34
    by_count = np.lexsort((np.arange(len(counts)), counts))
    tracemalloc.start()
    order = N.Order(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (order.rank[by_count] == np.arange(len(counts))).all()
    assert (np.diff(order.fragment[by_count].astype(int)) >= 0).all()
    assert peak < 2.5 * counts.nbytes


def test_only_picked_texts_are_cut(spark):
    words = " ".join(f"w{i}" for i in range(30))
    texts = [words, words.replace(" ", "  "), words.upper(), words + " end", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    keys = spark.createDataFrame([(N.text_key(texts[1].encode()),)], "txt long")
    order = spark.sparkContext.broadcast(N.Order(np.ones(N.BUCKETS, dtype=np.int64)))
    field = spark.sparkContext.broadcast(arrays.id_filter(keys, "txt"))
    (want,) = N.shingle_sets([words.encode()])
    rows = N.segment_rows(df, field, order).collect()
    assert {r["cls"] for r in rows} == {N.set_class(want)}
    assert sorted(t for r in rows for t in r["tokens"]) == sorted(want.view(np.int64).tolist())


def test_chance_shingles_make_no_pair(spark):
    # of 100 shingles each, one listed: what follows the prefix cannot make up the overlap
    kind = "struct<cls:long,n:int,pos:int,ahead:int,later:int>"
    rows = [((1, 100, 0, 0, later), (2, 100, 0, 0, later)) for later in (0, 7, 8, 9, 20)]
    df = spark.createDataFrame(rows, f"x {kind}, y {kind}")
    got_flags = [r["may"] for r in df.select(N.may_link("x", "y", N.F.lit(0)).alias("may")).collect()]
    assert got_flags == [100 * (79 + 1 + later) >= 80 * (200 - 79 - 1 - later) for later in (0, 7, 8, 9, 20)]

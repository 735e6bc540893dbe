import hashlib
import re

from spanlab.llm import secret_scan as S

# The rules stated once more, for Python's engine.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 20:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m.group()) >= 24:
            out.append((m.start(), 2, "hex", m.end()))
    out.sort()
    return out


def digest(text):
    rows = brute(text)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in rows)
    n = [sum(r[2] == k for r in rows) for k in ("assign", "access", "hex")]
    return (*n, hashlib.sha256(joined.encode()).hexdigest())


def test_whole_table_equals_brute_force(spark):
    sf_small = "/root/testdata/sf0.01"
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in S.op9_secret_ledger(spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert got == {r["doc_id"]: digest(r["text"]) for r in docs}
    assert sum(v[0] + v[1] + v[2] for v in got.values()) > 0


def test_edge_texts(spark):
    texts = [
        None,
        "",
        "token: token: abcdefgh",
        "token = 'abc' PassWord=\"x.y/z-_=+\" 🎉 API_KEY : abcdef",
        "AKIA" + "A" * 15 + " " + "AKIA" + "B" * 16 + "AKIA" + "C" * 20,
        "f" * 23 + " " + "0a" * 12 + "g" + "1" * 30,
        "é🎉 secret=" + "a1" * 20,
        "x " * 200_000 + "apikey=1234567",
        "same token=abcdef1",
        "same token=abcdef1",
        "ſecret=abcdefg toKen=abcdefg",
        "token=abcdef",
    ]
    df = spark.createDataFrame([(i if i else None, t, "blob", "findings") for i, t in enumerate(texts)], "path long, text string, blob string, findings string")
    by_path, pairs, _ = S.scan_versions(df)
    kinds = [r.kind for r in S.BASE_RULES]
    rows = by_path.select("path", S.spans_string(by_path["findings"], kinds).alias("s")).collect()
    got = {r["path"]: r["s"] or "" for r in rows}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert got[i if i else None] == ",".join(f"{k}:{s}:{e}" for s, _, k, e in brute(t)), t[:50]
    assert pairs.count() == len(S.RULES) * len({t or "" for t in texts})


def test_ledger_scans_only_unseen_pairs(spark):
    one = spark.createDataFrame([("a", "token=abcdef1"), ("b", "nothing")], "path string, text string")
    two = spark.createDataFrame([("a", "token=abcdef1"), ("c", "token=abcdef1"), ("a", "hex " + "a" * 30)], "path string, text string")
    _, pairs, found = S.scan_versions(one)
    by_path, fresh, every = S.scan_versions(two, ledger=pairs, findings=found)
    assert fresh.count() == len(S.RULES)  # only the new blob
    got = sorted((r["path"], S_len(r["findings"])) for r in by_path.collect())
    assert got == [("a", 1), ("a", 1), ("c", 1)]
    assert every.count() == 2
    # a new version of one rule is scanned on every blob again
    newer = [S.Rule("assign", 2, r"token=[a-z]+"), *S.RULES[1:]]
    _, again, _ = S.scan_versions(two, newer, ledger=pairs.unionByName(fresh), findings=every)
    assert {r["rule"] for r in again.collect()} == {"assign@2"} and again.count() == 2


def S_len(findings):
    return sum(len(f["spans"]) for f in findings or [])


def test_empty_table(spark):
    df = spark.createDataFrame([], "path long, text string")
    by_path, pairs, found = S.scan_versions(df)
    assert by_path.count() == pairs.count() == found.count() == 0


def test_stage_replaces_spans(spark, sf_small):
    rows = [(1, "x token=abcdef123 y", "en", 0, 19), (2, None, None, 1, None), (3, "é " + "a1" * 12 + " z", "fr", 2, 28), (3, "é " + "a1" * 12 + " z", "fr", 2, 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, findings int, n_chars long")
    out = sorted(S.stage_secrets(spark, docs, sf_small).collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in out] == ["x [secret] y", None, "é [secret] z", "é [secret] z"]
    assert [r["n_chars"] for r in out] == [12, None, 12, 12]
    assert out[0].asDict().keys() == dict.fromkeys(["doc_id", "text", "lang", "findings", "n_chars"]).keys()


def test_stage_cuts_each_row_by_its_own_text(spark):
    rows = [(1, "token=abcdef1 x"), (1, "clean words that are long enough"), (1, "y password: hunter22 z")]
    rows += [(None, "a secret=abcdefgh b"), (None, "nothing to hide in this one"), (None, None), (2, "token=abcdef1 x")]
    docs = spark.createDataFrame([(i, x, x and len(x)) for i, x in rows], "doc_id long, text string, n_chars long")
    out = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in S.stage_secrets(spark, docs, None).collect()), key=str)
    want = [(1, "[secret] x"), (1, "clean words that are long enough"), (1, "y [secret] z")]
    want += [(None, "a [secret] b"), (None, "nothing to hide in this one"), (None, None), (2, "[secret] x")]
    assert out == sorted(((i, x, x and len(x)) for i, x in want), key=str)


def test_many_matches_in_one_text(spark):
    import time

    text = "".join(f"{i:024x} token=abc{i:07d} é " for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "path long, text string")
    t0 = time.time()
    by_path, _, _ = S.scan_versions(df)
    got = by_path.select(S.spans_string(by_path["findings"], [r.kind for r in S.BASE_RULES])).first()[0]
    assert got == ",".join(f"{k}:{s}:{e}" for s, _, k, e in brute(text)) and got.count(":") == 200_000
    assert time.time() - t0 < 60


def test_cut_spans_over_several_runs(spark):
    from pyspark.sql import functions as F

    rows = []
    for n in (0, 1, S.RUN - 1, S.RUN, S.RUN + 1, 3 * S.RUN + 7):
        text = "é🎉abc" * (4 * n + 2)
        spans = sorted((7 * i + i % 3, 7 * i + i % 3 + (1, 4, 9)[i % 3]) for i in range(n))
        rows.append((text, spans))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int>>")
    got = [r[0] for r in df.select(S.cut_spans(F.col("text"), F.col("spans"))).collect()]

    def plain(text, spans):
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += text[at:s] + "[secret]"
            at = max(at, e)
        return out + text[at:]

    assert got == [plain(t, s) for t, s in rows]

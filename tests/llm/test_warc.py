import base64
import hashlib

import duckdb
import pytest

from spanlab.llm import warc as W
from spanlab.session import scratch_path


def through(spark, df):
    folder = scratch_path(spark, "warc-test")
    store, root = W.store_of(folder)
    store.create_dir(root, recursive=True)
    manifest = W.write_archives(df, folder)
    return W.read_archives(spark, folder, payload=True), manifest


def test_edge_pages_round_trip(spark):
    rows = [
        (1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://c/\n x", None), (4, "http://d/", ""),
        (5, "http://é/", "é🎉\r\n\r\nWARC/1.1\r\n"), (6, "http://e/", "x" * 3_000_000), (None, "http://f/", "<p>same</p>"), (None, "http://g/", "only null"),
        (7, "http://h/", "twice"), (7, "http://h/", "twice"),
    ]
    df = spark.createDataFrame([(a, b, c, "k", 1) for a, b, c in rows], "page_id long, url string, html string, key string, refers_to int").repartition(3)
    read, manifest = through(spark, df)
    out = read.collect()
    assert len(out) == len(rows) == manifest.agg({"records": "sum"}).first()[0]
    by = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out))
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        last = max(ids, default=None)
        again = last is not None and page != last
        want.append((page or 0, "revisit" if again else "response", last if again else None, len(data)))
    assert by == sorted(want, key=lambda r: (r[0], r[1]))
    texts = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): (h or "").encode() for _, _, h in rows}
    for r in out:
        assert r["payload_digest"] in texts and r["payload_bytes"] == len(texts[r["payload_digest"]])
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == texts[r["payload_digest"]]


def test_archive_layout_and_dictionary():
    records = [W.record(i, f"http://h/{i}", b"<html>common words in every page " + str(i).encode() * 50, None) for i in range(300)]
    data = W.archive(records)
    assert int.from_bytes(data[:4], "little") == W.DICTIONARY_MAGIC
    assert [r for _, r in W.frames(data)] == records
    assert len(data) < sum(map(len, records)) / 2
    one = W.archive(records[:1])
    assert [r for _, r in W.frames(one)] == records[:1]


@pytest.mark.parametrize("damage", ["dictionary", "frame", "cut", "length", "digest", "header"])
def test_damage_is_found(damage):
    good = W.record(1, "http://a/", b"payload bytes", None)
    bad = {
        "length": good.replace(b"payload bytes", b"payload byte"),
        "digest": good.replace(b"payload bytes", b"payload bytez"),
        "header": good.replace(b"WARC-Date", b"WARC-Dote"),
    }
    data = W.archive([bad.get(damage, good)])
    if damage == "dictionary":
        data = data[4:]
    if damage == "frame":
        data = data[:-6] + b"xx" + data[-4:]
    if damage == "cut":
        data = data[:-3]
    with pytest.raises((ValueError, W.zstandard.ZstdError)):
        [W.parsed(r) for _, r in W.frames(data)]


def test_empty_table(spark):
    read, manifest = through(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert read.count() == manifest.count() == 0


def test_whole_table_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = sorted(con.execute(W.ORACLE).fetchall())
    rows = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.op7_warc(spark, sf).collect())
    assert rows == want

import duckdb

from spanlab.llm import url_filter as U


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    cut = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    path = tail[:cut]
    fits = [(len(h + p), h + p, a) for a, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def canonical(u):
    return f'<html><head><LINK href="{u}" rel="canonical"></head>'


URLS = [
    None, "", "nothing", "http://", "http:///x", "HTTP://A.NET", "http://a.net/", "http://net/x", "http://anet/", "http://x.example.net/en/a",
    "http://example.net/en", "https://m.example.com/de/1#top", "https://example.com/DE/1", "http://notexample.com/de/", "http://fr.org/fr/x?y=/de/",
    "http://org/fr/", "http://user@example.com:80/de/", "http://a.net?x=/en/", "//a.net/", "x://y://z.net/", "http://Ä.NET/Ö", "http://a.net/\nb?c", "http://.net/", "http://a..net/",
]


def test_edge_urls(spark):
    df = spark.createDataFrame([(i, u, None, "h", "p", "r") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, path string, rule string")
    out = {r["page_id"]: r for r in U.judge(df, U.rule_table(spark)).collect()}
    assert len(out) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, action = brute_rule(u)
        r = out[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, action or "allow"), u


def test_blocks_reach_aliases_and_allows_stop_them(spark):
    pages = [
        (1, "http://good.edu/a", canonical("http://bad.net/a")),  # alias of a blocked page
        (2, "https://good.edu/b", '<meta http-equiv="refresh" content="0; url=/a?x=1&amp;y=2">'),
        (3, "http://good.edu/a?x=1&y=2#z", '<link rel=canonical href="http://good.edu/a">'),  # chain to the block
        (4, "http://free.edu/a", canonical("http://bad.net/free")),
        (5, "http://bad.net/free", canonical("http://example.net/en/free")),  # an allowed member
        (6, "http://lone.edu/", '<link rel="stylesheet" href="http://bad.net/a">'),
        (7, "http://fr.org/fr/1", canonical("http://bad.net/a")),  # allowed itself
        (8, "http://seen.edu/x", None),
        (1, "http://good.edu/a", None),
        (None, "http://good.edu/rel/page", '<link rel="canonical" href="../a"><link rel="canonical" href="">'),
    ]
    # page 7 is allowed and would lift the first component's block: give it a component of its own
    pages[6] = (7, "http://fr.org/fr/1", canonical("http://bad.net/seven"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://seen.edu/x", "http://worse.net/"), (None, "http://x/"), ("broken", "")], "from_url string, to_url string")
    out = U.judge(df, U.rule_table(spark), redirects).collect()
    got = sorted(((r["page_id"] or 0), r["verdict"]) for r in out)
    assert got == [(0, "allow"), (1, "block"), (1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "block"), (6, "allow"), (7, "allow"), (8, "block")]


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string"), U.rule_table(spark)).count() == 0


def test_whole_table_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = sorted(con.execute(U.ORACLE).fetchall())
    rows = sorted(tuple(r) for r in U.op10_url_filter(spark, sf).collect())
    assert rows == want and len({r[4] for r in rows}) == 2

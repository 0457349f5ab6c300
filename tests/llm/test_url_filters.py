from qamill.llm import url_filters as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/x", "block"),
         ("tie.org", "/", "allow"), ("tie.org", "/", "block"), (None, "/", "block")]
URLS = ["http://A.Example.NET/en/1?q#f", "https://example.net/fr/", "http://notexample.net/en/",
        "http://www.example.com/de/xyz", "http://example.com/de/", "http://x.net", "http://x.net?a/",
        "nothing", "", None, "ftp://tie.org/a", "http://a..net/", "http://example.com.net/en/",
        "http://" + "a." * 300 + "net/" + "p" * 5000, "http://example.net?next=https://x.org/en/",
        "http://a.com?u=http://example.net/en/x", "http://x.org#go=http://y/fr/", "://net/a", "a://b://net/", "x:/net/",
        "http:///net/", "http://example.net/en/?u=http://b.com/de/x"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut].lower(), rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h), len(p), v, h + p) for h, p, v in RULES if h is not None
           and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fit)[3], max(fit)[2]) if fit else (None, "allow"))


def judged(spark, monkeypatch=None):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])],
                               "page_id bigint, url string, rule string")
    rows = U.judge(df, U.rule_table(spark, RULES)).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}


def test_against_brute_force(spark):
    assert judged(spark) == {i: brute(u) for i, u in enumerate(URLS + URLS[:3])}


def test_parts_against_the_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    got = U.judge(df, U.rule_table(spark, U.RULES)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(U.ORACLE).fetchall())


def test_large_rule_sets_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 1)
    assert judged(spark) == {i: brute(u) for i, u in enumerate(URLS + URLS[:3])}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert U.judge(none, U.rule_table(spark, RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/")], "page_id bigint, url string")
    assert U.judge(one, U.rule_table(spark, [])).first()["verdict"] == "allow"

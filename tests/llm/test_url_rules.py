from __future__ import annotations

import random
import re

from lodestone.llm import url_rules

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def brute(url):
    rest = (url or "").split("://", 1)
    if len(rest) == 1:
        host = path = ""
    else:
        host = re.split("[/?#]", rest[1], maxsplit=1)[0]
        path = re.split("[?#]", rest[1][len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    return host, path, None, next((p.verdict for p in url_rules.PATTERNS if re.search(p.expression, low)), "allow")


def urls():
    r = random.Random(3)
    hosts = ["example.com", "www.example.com", "EXAMPLE.com", "a.net", "net", "notcom", "x.org", "spam-farm.x.org", "cheap-pills.example.org", "adult-1.x.org", "adult1.x.org", "com", "", "a.b.www.example.com"]
    tails = ["", "/", "/en/1", "/en", "/es/2?x=1", "/fr/#a", "?q=/en/", "#/en/", "/spam-report", "/wp-login.php", "/a.exe?x", "/redirect?a=1&url=http://b", "/casino", "/free-mp3-download", "?utm_source=a&ref=affiliate"]
    made = [f"{r.choice(['http', 'HTTPS', ''])}://{h}{t}" for h in hosts for t in tails]
    return [*made, None, "", "no scheme example.com/en/", "http://a://b.net/es/", "http://ü.com/é", "http://x.net/es/" + "y" * 100_000, "http://\n.com/\n/x"]


def test_verdicts(spark):
    every = urls()
    df = spark.createDataFrame([(k // 2 if k else None, u, "clash") for k, u in enumerate(every)], "page_id long, url string, host string")
    got = [tuple(r) for r in url_rules.judged(df).collect()]
    assert sorted(got, key=str) == sorted(((k // 2 if k else None, *brute(u)) for k, u in enumerate(every)), key=str)
    assert url_rules.judged(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    pattern = url_rules.Pattern("block", ("often", "seldom"), "often.*seldom")
    rules = url_rules.Rules((), (pattern,), {"often": 100, "seldom": 2})
    assert list(rules.filed) == ["seldom"]
    assert rules.by_pattern("http://x.org/often/seldom") == "block" and rules.by_pattern("http://x.org/often") == "allow"


def test_redirects_to_https_in_a_table_without_http(spark):
    every = ["https://x.org/redirect?url=https://y.org", "https://x.org/redirect?a=1&url=httpx", "https://x.org/redirect/url", "https://x.org/?url=https://y.org"]
    df = spark.createDataFrame(list(enumerate(every)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judged(df).collect()}
    assert got == {k: brute(u)[3] for k, u in enumerate(every)} == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_literal_tokens_are_in_all_that_fits():
    for p in url_rules.PATTERNS:
        for u in urls():
            low = (u or "").lower()
            if re.search(p.expression, low):
                assert set(p.tokens) <= url_rules.tokens(low)


def test_oracle_and_operator_agree_outside_ascii(spark):
    import duckdb

    from lodestone.llm import sql

    urls = ["HTTP://CAFÉ.com/É", "http://x/écasino", "http://x/é-casino/", "http://x/casinoé", "http://x/CASİNO", "http://x/a.exe\n", "http://x/a.exe", "http://x/ſpam-farm", "http://x/spam-farm", "http://ADULT.é/", "http://x.net/es/İ", None, "", "://", "a://b://c", "http://www.EXAMPLE.com/en/", "http://example.com/en/x", "http://x/K", "http://ÀB.COM/?q"]
    rows = list(enumerate(urls))
    got = sorted(tuple(r) for r in url_rules.judged(spark.createDataFrame(rows, "page_id long, url string")).collect())
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    want = con.execute("select page_id, host, path, rule, verdict from (" + sql.url_rules() + ") order by page_id").fetchall()
    assert got == want


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string, host string, verdict string")
    assert url_rules.judged(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/x", "clash", "clash"), (1, "http://a.com/x", "clash", "clash"), (None, "http://" + "h" * 500_000 + "/p", "", "")], "page_id long, url string, host string, verdict string")
    rows = url_rules.judged(one).collect()
    assert len(rows) == 3 and {r.host for r in rows if r.page_id == 1} == {"a.com"} and {len(r.host) for r in rows if r.page_id is None} == {500_000}

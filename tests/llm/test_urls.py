"""URL verdicts, term by term."""

import re

from tidewatch.llm import urls

URLS = [
    None, "", "no scheme casino", "http://Example.ORG", "http://example.org/", "https://m.example.org/es/1?x=/en/1",
    "http://example.org/en/12", "http://notexample.org/es/", "ftp://a.com/fr/#x", "http://com/de/", "http://x.com/de",
    "http://x.net/CASINO-win", "http://casinos.net/", "http://free-bets.net/a", "http://freebets.net/",
    "http://x.net/free/free", "http://ü.net/free?win=1", "a://b://c.org/x", "http://?q=porn", "http://x.org:80/p",
    "http://x.net/" + "a" * 50_000 + "/xxx", "http://x.net/ads_track", "İ://x.NET/ı-PORN",
]


def by_hand(url):
    text = url or ""
    rest = text.split("://", 1)[1] if "://" in text else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    host = lower(host)
    rule = kind = None
    for verdict, own, start in urls.RULES:
        if (host == own or host.endswith("." + own)) and path.startswith(start) and len(own + start) > len(rule or ""):
            rule, kind = own + start, verdict
    has = lambda t: re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", lower(text))
    bad = any(map(has, urls.STRICT)) or sum(map(bool, map(has, urls.SOFT))) >= 2
    return host, path, rule, kind or ("block" if bad else "allow")


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge_urls(df).collect()}
    assert got == {k: by_hand(u) for k, u in enumerate(URLS)}
    assert {v[3] for v in got.values()} == {"allow", "block"}


def test_repeated_rows_stay_and_nothing_gives_nothing(spark):
    df = spark.createDataFrame([(1, "http://a.com/fr/")] * 2 + [(None, None)], "page_id long, url string")
    assert urls.judge_urls(df).count() == 3
    assert urls.judge_urls(df.limit(0)).collect() == []

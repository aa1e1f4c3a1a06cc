import math

import pytest
from pyspark.sql import functions as F

from mailsift.functions.url_features import SuffixRules, extract_urls, url_host, with_url_features, with_url_parts, with_urls

EXTRACT = [
    ("Two links, http://one.example and https://two.example.net/a/b here.", ["http://one.example", "https://two.example.net/a/b"]),
    ("defanged hxxp://bad-place.example.net stays a link", ["hxxp://bad-place.example.net"]),
    ("bare www.shop.example/basket counts", ["www.shop.example/basket"]),
    ("A full stop ends it http://docs.example/page.", ["http://docs.example/page"]),
    ("Nothing to follow in these words at all.", []),
    ("plain example.com is no link", []),
    ('<a href="HTTP://A.B/c">x</a> (www.d.e), [https://f.g/h]', ["HTTP://A.B/c", "www.d.e", "https://f.g/h"]),
    ("xhttp://no.start éhttp://no.start _www.no.start", []),
    ("a http://x.y/z b", ["http://x.y/z"]),
]


def test_extract_urls(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXTRACT)], "i int, text string")
    got = {r.i: r.urls for r in df.select("i", extract_urls(F.col("text")).alias("urls")).collect()}
    assert got == {i: urls for i, (_, urls) in enumerate(EXTRACT)}


HOSTS = [
    ("http://User:pw@Mail.Example.org:8443/x", "mail.example.org"),
    ("hxxps://secure.example.net?q=1", "secure.example.net"),
    ("www.example.com/login#top", "www.example.com"),
    ("http://under_score.example.com", "under_score.example.com"),
    ("http://[::1", ""),
    ("www.example.com/?next=http://b.c", ""),
    ("http://", ""),
    ("http://a@b@c.d/", "c.d"),
]


def test_hosts(spark):
    df = spark.createDataFrame([(u,) for u, _ in HOSTS], "u string")
    got = {r.u: r.h for r in df.select("u", url_host(F.col("u")).alias("h")).collect()}
    assert got == dict(HOSTS)


DOMAINS = [
    ("http://a.b.example.co.uk/", "co.uk", "example"),
    ("http://bit.ly/x", "ly", "bit"),
    ("http://win-now.tk", "tk", "win-now"),
    ("http://co.tk", "tk", "co"),
    ("http://localhost/x", "", "localhost"),
    ("http://box.unknowntld", "", "unknowntld"),
    ("http://co.uk/", "co.uk", ""),
    ("http://example.com./x", "com", "example"),
    ("http://172.16.4.9/in", "", "172.16.4.9"),
]


def test_suffix_and_domain(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in DOMAINS], "text string")
    rows = with_url_parts(with_urls(df)).select("text", F.inline("_parts")).collect()
    assert {(r.text, r.suffix, r.domain) for r in rows} == set(DOMAINS)


RULES = """// a remark
com
co.uk
uk
photography
*.ck
!www.ck
*.kawasaki.jp
!city.kawasaki.jp
jp
公司.cn
cn
"""
BY_RULES = [
    ("http://studio.photography/", "photography", "studio"),
    ("http://a.b.co.uk/", "co.uk", "b"),
    ("http://shop.any.ck", "any.ck", "shop"),
    ("http://www.ck", "ck", "www"),
    ("http://x.y.kawasaki.jp", "y.kawasaki.jp", "x"),
    ("http://x.city.kawasaki.jp", "kawasaki.jp", "city"),
    ("http://name.xn--55qx5d.cn", "xn--55qx5d.cn", "name"),
    ("http://box.unknowntld", "", "unknowntld"),
    ("http://co.uk/", "co.uk", ""),
]


def test_suffixes_by_a_list_of_rules(spark, tmp_path):
    (tmp_path / "rules.dat").write_text(RULES)
    rules = SuffixRules.read(spark, str(tmp_path / "rules.dat"))
    df = spark.createDataFrame([(u,) for u, _, _ in BY_RULES], "text string")
    rows = with_url_parts(with_urls(df), rules).select("text", F.inline("_parts")).collect()
    assert {(r.text, r.suffix, r.domain) for r in rows} == set(BY_RULES)


FEATURES = [
    ("two http://a.com http://b.com", {"url_count": 2}),
    ("http://172.16.4.9/in", {"has_ip_literal": True, "avg_domain_entropy": 0.0, "suspicious_tld": False}),
    ("http://999.9.9.9/login", {"has_ip_literal": True, "avg_domain_entropy": 0.0}),
    ("http://plain.example/in", {"has_ip_literal": False, "has_at_symbol": False}),
    ("http://bit.ly/9Kq", {"has_url_shortener": True}),
    ("https://T.CO/zz", {"has_url_shortener": True}),
    ("http://example.com", {"has_url_shortener": False, "suspicious_tld": False}),
    ("http://win-now.tk/x", {"suspicious_tld": True}),
    ("http://bank.example@attacker.example/in", {"has_at_symbol": True}),
    ("http://bank.example/?x=a@b", {"has_at_symbol": False}),
    ("http://bank.example?x=a@b", {"has_at_symbol": True}),
    ("http://aab.com http://abcd.com http://10.0.0.1",
     {"avg_domain_entropy": (-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)) + 2.0) / 2}),
    ("Words alone, nothing that could be opened", {
        "url_count": 0, "has_ip_literal": False, "has_url_shortener": False, "avg_domain_entropy": 0.0,
        "suspicious_tld": False, "has_at_symbol": False}),
    (None, {"url_count": 0, "suspicious_tld": False}),
]


def test_url_features(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FEATURES)], "i int, text string")
    rows = {r.i: r for r in with_url_features(df).collect()}
    for i, (text, expected) in enumerate(FEATURES):
        for name, value in expected.items():
            assert rows[i][name] == pytest.approx(value), (text, name)

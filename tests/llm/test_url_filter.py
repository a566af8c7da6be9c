import hashlib

import pytest
from pyspark.sql import functions as F

from mediaquarry.llm import url_filter as u
from mediaquarry.llm.queries import URL_RULES


def judged(spark, urls, **settings):
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return sorted(u.url_filter(table, **settings).collect())


def test_split(spark):
    want = {
        None: ("", ""), "no scheme": ("", ""), "http://": ("", ""), "HTTP://WWW.A.com": ("www.a.com", ""), "x://A.b/P?q#f": ("a.b", "/P"),
        "x://a?b/c": ("a", ""), "x://a#b/c": ("a", ""), "x://a/b#c?d": ("a", "/b"), "x://ÄA/é": ("Äa", "/é"), "a://b://c/d": ("b:", "//c/d"),
        "x://a\nb/c\nd?e": ("a\nb", "/c\nd"), "\U0001f600://a/b": ("a", "/b"),
    }
    assert [(r.host, r.path) for r in judged(spark, want)] == list(want.values())


def test_rules_and_terms(spark):
    want = {
        "http://a.example.com/en/7x": ("example.com/en/7", "allow"), "http://a.example.com/en/8": ("com/en/", "block"), "http://com/en/": ("com/en/", "block"),
        "http://xcom/en/": (None, "allow"), "http://example.net/de/81": ("example.net/de/8", "block"), "http://casino.example.net/de/1": ("net/de/", "allow"),
        "http://a.org/es/": ("org/es/", "block"), "http://a.org/es": (None, "allow"), "http://a.org/en/casino": (None, "block"), "http://casinos.org/": (None, "allow"),
        "http://bets.org/loan": (None, "block"), "http://free.org/free": (None, "allow"), "http://a.org/x?casino": (None, "block"), "http://CASINO-win.org": (None, "block"),
    }
    assert [(r.rule, r.verdict) for r in judged(spark, want, rules=URL_RULES)] == list(want.values())


def test_ties_between_rules(spark):
    rules = [u.Rule("allow", "a.org", "/x"), u.Rule("block", "b.a.org", ""), u.Rule("allow", "org", "/abcd"), u.Rule("block", "a.org", "/x")]
    assert [r.rule for r in judged(spark, ["x://b.a.org/x", "x://c.a.org/x", "x://b.a.org/abcd"], rules=rules)] == ["b.a.org", "a.org/x", "org/abcd"]
    assert judged(spark, ["x://c.a.org/x"], rules=rules)[0].verdict == "block"


def test_tables(spark):
    rows = [(1, None), (2, ""), (None, "http://porn.example/"), (3, "http://a.com/en/1"), (3, "http://a.com/en/1"), (4, "http://x/" + "a" * 100_000)]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("id", "host", "path", "rule", "verdict", "hits", "own")})
    got = [(r.page_id, r.rule, r.verdict) for r in u.url_filter(table, rules=URL_RULES).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "allow"), (2, None, "allow"), (None, None, "block"), (3, "com/en/", "block"), (3, "com/en/", "block"), (4, None, "allow")], key=str)
    assert u.url_filter(table.limit(0)).count() == 0
    assert {r.verdict for r in u.url_filter(table, terms=()).collect()} == {"allow"}


def test_the_whole_url_is_scanned(spark):
    want = {
        "http://a.org/search?q=casino": ("block", 1, 0, 1, 0, 6), "http://a.org/#PORN": ("block", 1, 0, 1, 0, 6), "www.porn.com/xxx": ("block", 2, 0, 2, 0, 12),
        "casino.com/xxx": ("block", 2, 0, 2, 0, 12), "http://a.org/x?ref=casino": ("block", 1, 0, 1, 0, 6), "http://a.org/?loan=1#bets": ("block", 0, 2, 0, 2, 6),
        "http://a.org/bets?x=bets/bets": ("allow", 0, 1, 0, 3, 3), "http://a.org/?q=casinos": ("allow", 0, 0, 0, 0, 0), "no scheme": ("allow", 0, 0, 0, 0, 0),
        "http://a.net/de/?q=casino": ("allow", 1, 0, 1, 0, 6), "http://a.org/free/buy": ("allow", 0, 2, 0, 2, 4), "http://a.org/free/buy/ad": ("block", 0, 3, 0, 3, 6),
        "x://épornographie/porné": ("allow", 0, 0, 0, 0, 0), None: ("allow", 0, 0, 0, 0, 0),
    }
    assert [tuple(r)[4:] for r in judged(spark, want, rules=URL_RULES)] == list(want.values())


def test_terms_come_from_a_file_with_a_digest(tmp_path):
    path = tmp_path / "terms.tsv"
    path.write_text("term\tkind\tweight\nfoo\tstrict\t6\nfoo\tsoft\t3\nbar\tsoft\t3\n")
    terms = u.load_terms(path, hashlib.sha256(path.read_bytes()).hexdigest())
    assert u.count_terms("foo-bar bar foobar", u.vocabulary(terms)) == (1, 1, 1, 2, 9)
    with pytest.raises(ValueError, match="SHA-256"):
        u.load_terms(path, "0" * 64)
    own = u.load_terms(u.TERMS, u.TERMS_SHA256)
    assert all(t.weight >= u.LIMIT for t in own if t.kind == "strict") and all(2 <= t.weight < u.LIMIT for t in own if t.kind == "soft")
    assert len({t.term for t in own}) == len(own) and all(t.term.isalnum() and t.term == t.term.lower() for t in own)

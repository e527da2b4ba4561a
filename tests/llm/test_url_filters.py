"""URL filters against plain matching of every rule with every url."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.llm import url_filters as uf

RULES = [
    ("host", "net/", "block"), ("host", "example.net/en/", "allow"), ("host", "example.com/de/", "block"), ("host", "org/fr/", "allow"),
    ("host", "bare", "block"), ("host", "Example.ORG/En", "block"), ("pattern", "||ads.", "block"), ("pattern", "/banner/", "block"),
    ("pattern", "ner", "block"), ("pattern", "|http:*login^", "block"), ("pattern", "help/login", "allow"), ("pattern", ".zip|", "block"),
    ("pattern", "*a*b*", "block"), ("pattern", "/banner/", "allow"), ("pattern", "[x](y).+", "block"),
]


def glob(pattern: str, text: str) -> bool:
    """Does ``pattern`` fit the start of ``text``?"""
    if not pattern:
        return True
    if pattern == "|":
        return not text
    if pattern[0] == "*":
        return any(glob(pattern[1:], text[k:]) for k in range(len(text) + 1))
    if pattern[0] == "^":
        if not text:
            return glob(pattern[1:], text)
        return not (text[0].isascii() and (text[0].isalnum() or text[0] in "_.%-")) and glob(pattern[1:], text[1:])
    return text[:1] == pattern[0] and glob(pattern[1:], text[1:])


def ascii_lower(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    return ascii_lower(host), tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def fits(kind, rule, url) -> bool:
    host, path = parts(url)
    if kind == "host":
        want, slash, start = rule.partition("/")
        want = ascii_lower(want)
        return (host == want or host.endswith("." + want)) and path.startswith(slash + start)
    text, rule = ascii_lower(url or ""), ascii_lower(rule)
    if rule.startswith("||"):
        if "://" not in text:
            return False
        begin = text.index("://") + 3
        at = [begin] + [begin + k + 1 for k, c in enumerate(host) if c == "."]
        return any(glob(rule[2:], text[k:]) for k in at)
    if rule.startswith("|"):
        return glob(rule[1:], text)
    return any(glob(rule, text[k:]) for k in range(len(text) + 1))


def judged(url):
    hits = [r for r in RULES if fits(r[0], r[1], url)]
    if any(r[0] == "host" for r in hits):
        _, rule, action = max((r for r in hits if r[0] == "host"), key=lambda r: (len(r[1]), r[2] == "allow", r[1]))
        return (*parts(url), rule, None, action)
    best = max(hits, key=lambda r: (r[2] == "allow", len(r[1]), r[1]), default=None)
    return (*parts(url), None, best and best[1], best[2] if best else "allow")


def random_urls(n: int) -> list:
    rng = random.Random(5)
    bits = ["http", "https", "://", "://", "/", "/", ".", ".", "?", "#", "net", "org", "example", "example.com", "com", "en", "fr", "de", "de/", "EN",
            "banner", "ads", "Login", "help", ".zip", "a", "b", "-", "_", "%20", "é", "bare", "[x](y).+", "\n", "://a.example.net/en/", "://example.com/de/", "://x.org/fr/"]
    return [None, "", "://", "http://net", "http://net/", "http://NET/x?y", "http://a.b.bare", "http://bare/q", "http://xbare/", *(
        "".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(n)), "http://ads.x.com/" + "a" * 200_000]


@pytest.mark.parametrize("index_bytes", [uf.INDEX_BYTES, 0])
def test_equals_matching_every_rule(spark, index_bytes):
    urls = random_urls(1500)
    urls += urls[:40]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("mine")).withColumn("token", F.lit(1))
    rules = spark.createDataFrame(RULES + RULES[:2] + [("host", None, "block"), ("pattern", "", "block"), ("host", "net/", "maybe"), ("page", "x", "block")], "kind string, rule string, action string")
    got = uf.judge_urls(table, rules, keep=("page_id", "verdict"), index_bytes=index_bytes)
    assert got.columns == ["page_id", *uf.RESULT]
    rows = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert len(rows) == len(urls)
    for k, url in enumerate(urls[:-41]):
        assert rows[k] == judged(url), url
    assert rows[len(urls) - 41][4] == "block"
    assert sum(r[4] == "block" for r in rows.values()) > 100
    kept = uf.apply_url_filter(table, rules, index_bytes=index_bytes)
    assert kept.columns == table.columns
    assert sorted(r.page_id for r in kept.collect()) == sorted(k for k, r in rows.items() if r[4] == "allow")


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"https://www.example.com/{w}",) for w in ("a/shop", "b/shop", "c/rare")] + [(None,)], "url string")
    rules = spark.createDataFrame([("pattern", "example.com/*/shop|", "block"), ("host", "example.com/c/rare", "block"), ("pattern", "hop", "block"), ("host", "com/c", "block")], "kind string, rule string, action string")
    for small in (True, False):
        filed = {r["rule"]: r["token"] for r in uf.file_rules(rules, urls, small=small).collect()}
        # "example" and "rare" may go on in the url, "hop" may stand inside a word
        assert filed == {"example.com/*/shop|": "shop", "example.com/c/rare": "c", "hop": "", "com/c": "com"}


def test_no_rules_and_no_urls(spark):
    rules = spark.createDataFrame([], "kind string, rule string, action string")
    urls = spark.createDataFrame([(1, "http://net/"), (None, None)], "page_id long, url string")
    for size in (uf.INDEX_BYTES, -1):
        assert {r.verdict for r in uf.judge_urls(urls, rules, index_bytes=size).collect()} == {"allow"}
        assert uf.judge_urls(urls.limit(0), uf.rule_table(spark), keep=("page_id",), index_bytes=size).count() == 0

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.functions.dates import format_datetime


def apply(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def plain_preprocess(text):
    """Straightforward version of the cleaning chain."""
    text = (text or "").lower()
    for pattern in (tx.URL_PATTERN, tx.EMAIL_PATTERN, tx.PATH_PATTERN, tx.NUMBER_PATTERN, r"[^a-zA-Z0-9\s]"):
        text = re.sub(pattern, " ", text)
    return " ".join(w for w in text.split() if len(w) >= 2 and w not in tx.STOPWORDS)


TEXTS = [
    "See https://x.org/a?b=1 and www.foo.bar/q now",
    "mail a.b@c.org, or <x@y.z>; @a@b.c @nodot x@y",
    "ls /usr/local/bin C:\\dir\\x file /a/ b",
    "3.14 x86 10 2023. 5a a5 CVE-2023-12345 1.2.3",
    "naïve café9 9été ÜBER straße déjà2vu",
    "The security of the network: user DATA breached!",
    "tab\tnew\nline\u00a0nbsp  double",
    "", None, "a b c", "aaaa" * 50 + "@", "\\\\server\\share\\x /etc/passwd/",
]


def test_preprocess_matches_plain_version(spark):
    assert apply(spark, TEXTS, tx.preprocess) == [plain_preprocess(t) for t in TEXTS]


def test_preprocess_is_idempotent(spark):
    once = apply(spark, TEXTS, tx.preprocess)
    assert apply(spark, once, tx.preprocess) == once


def test_preprocess_random_text(spark):
    seen = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.text(alphabet="aB9 .@/\\:-_wht\n\tphs", max_size=40))
    def collect(text):
        seen.append(text)

    collect()
    assert apply(spark, seen, tx.preprocess) == [plain_preprocess(t) for t in seen]


def test_flags(spark):
    text = ["The user saw 42 at https://x.org from a@b.org"]
    keep_all = dict(remove_stopwords=False, remove_numbers=False, remove_urls=False, remove_emails=False)
    assert apply(spark, text, lambda c: tx.preprocess(c, **keep_all)) == [
        "the user saw 42 at https org from org"
    ]
    assert apply(spark, text, lambda c: tx.preprocess(c, min_word_length=4)) == [""]


def test_stopwords():
    assert len(tx.STOPWORDS) == 96 == len(set(tx.STOPWORDS))


@pytest.mark.parametrize("span", [(1, 1), (1, 2), (2, 3), (1, 3)])
def test_ngrams(spark, span):
    def grams(t):
        w = (t or "").split()
        return [" ".join(w[i:i + n]) for n in range(span[0], span[1] + 1) for i in range(len(w) - n + 1)]

    texts = ["a b a b", "x", "", "p q r"]
    assert apply(spark, texts, lambda c: tx.ngrams(tx.tokenize(c), span)) == [grams(t) for t in texts]


def test_preview_and_truncate(spark):
    texts = ["x" * 80, "x" * 81, None]
    assert apply(spark, texts, lambda c: tx.preview(c, 80)) == ["x" * 80, "x" * 80 + "...", None]
    words = "word " * 30
    cases = ["y" * 105, "y" * 106, words, "short"]
    assert apply(spark, cases, tx.truncate_words) == [
        "y" * 105, "y" * 97 + "...", words[:97].rsplit(" ", 1)[0] + "...", "short",
    ]


def test_clean_whitespace(spark):
    texts = ["  a \t\t b \n\n\n  \n c\r\nd ", "", None, "\n\n"]
    assert apply(spark, texts, tx.clean_whitespace) == ["a b\nc\nd", "", "", ""]


def test_domain(spark):
    urls = ["http://User:p@Host:8080/x", "https://a.org?q", "mailto:x@y", "//cdn.org/x", "rel/path"]
    assert apply(spark, urls, tx.domain_of) == ["User:p@Host:8080", "a.org", "", "cdn.org", ""]


def test_keys(spark):
    long = "http://é.org/" + "x" * 200
    [key] = apply(spark, [long], tx.sanitize_key)
    assert len(key) == 100 and key.startswith("http___é.org_xx") and key[80:83] == "___"
    [crawl] = apply(spark, [long], tx.crawl_key)
    assert crawl == re.sub(r"[^\w]|_", "_", long)[-150:]


def test_like(spark):
    values = ["100% sure", "1000 sure", "a_b", "axb", "back\\slash", "ABC", "É", "line\nbreak", None]
    def hits(needle):
        flags = apply(spark, values, lambda c: tx.contains_text(c, needle))
        return [v for v, f in zip(values, flags) if f]

    assert hits("0% s") == ["100% sure", "1000 sure"]
    assert hits("a_b") == ["a_b", "axb"]
    assert hits("k\\s") == ["back\\slash"]
    assert hits("abc") == ["ABC"]
    assert hits("é") == []  # only ASCII letters fold
    assert hits("e%b") == ["line\nbreak"]
    assert hits("\\E") == []


def test_format_datetime(spark):
    values = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456+05:00", "2024-01-02", "soon", "2024-13-01", None]
    assert apply(spark, values, format_datetime) == [
        "2024-01-02 03:04", "2024-01-02 03:04", "2024-01-02 00:00", "soon", "2024-13-01", None
    ]

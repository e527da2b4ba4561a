"""Text function queries (T1-T12, W11, W12, X7) over whole documents."""

from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators.features import with_terms
from workload import tables as tb
from workload.registry import query

STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def sql_urls(x):
    return rf"regexp_replace({x}, 'https?://\S+|www\.\S+', ' ', 'g')"


def sql_emails(x):
    return rf"regexp_replace({x}, '\S+@\S+\.\S+', ' ', 'g')"


def sql_paths(x):
    return rf"regexp_replace({x}, '(?:/|\\)[\w\d.-]+(?:/|\\)', ' ', 'g')"


def sql_numbers(x):
    return rf"regexp_replace({x}, '\b\d+(?:\.\d+)?\b', ' ', 'g')"


def sql_symbols(x):
    return rf"regexp_replace({x}, '[^a-zA-Z0-9\s]', ' ', 'g')"


def sql_tokens(x="text"):
    """Whole chain T1-T7 as a list expression."""
    chain = sql_symbols(sql_numbers(sql_paths(sql_emails(sql_urls(f"lower(coalesce({x}, ''))")))))
    return (
        rf"list_filter(string_split_regex({chain}, '\s+'), "
        f"lambda w: length(w) >= 2 AND w NOT IN ({STOP_SQL}))"
    )


def sql_terms(tokens):
    return (
        f"list_concat({tokens}, list_transform(range(1, len({tokens})), "
        f"lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]))"
    )


def _docs(spark, sf):
    return tb.documents(spark, sf)




@query("T1_lower", "SELECT doc_id AS id, lower(coalesce(text, '')) AS out FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("id", tx.lower_text(F.col("content")).alias("out"))


@query("T2_strip_urls", f"SELECT doc_id AS id, {sql_urls('text')} AS out FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("id", tx.strip_urls(F.col("content")).alias("out"))


# stored article urls inside text, so that there is something to remove
@query(
    "T2_strip_urls_in_references",
    tb.with_tables("articles")
    + f"SELECT id, {sql_urls(chr(39) + 'see ' + chr(39) + ' || url || ' + chr(39) + ' www.a.example/x end' + chr(39))} AS out FROM articles",
)
def _(spark, sf):
    text = F.concat(F.lit("see "), "url", F.lit(" www.a.example/x end"))
    return tb.articles(spark, sf).select("id", tx.strip_urls(text).alias("out"))


@query("T3_strip_emails", f"SELECT doc_id AS id, {sql_emails('text')} AS out FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("id", tx.strip_emails(F.col("content")).alias("out"))


@query("T4_strip_paths", f"SELECT page_id AS id, {sql_paths('url')} AS out FROM pages")
def _(spark, sf):
    return tb.raw(spark, sf, "pages").select(
        F.col("page_id").alias("id"), tx.strip_paths(F.col("url")).alias("out")
    )


@query("T5_strip_numbers", f"SELECT doc_id AS id, {sql_numbers('text')} AS out FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("id", tx.strip_numbers(F.col("content")).alias("out"))


@query(
    "T6_strip_symbols",
    r"SELECT doc_id AS id, regexp_replace(text, '[^a-zA-Z0-9 ]+', ' ', 'g') AS out FROM documents",
)
def _(spark, sf):
    return _docs(spark, sf).select("id", tx.strip_symbols(F.col("content")).alias("out"))


@query(
    "T7_keep_words",
    rf"""SELECT doc_id AS id, array_to_string(list_filter(
        string_split_regex(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +'),
        lambda w: length(w) >= 3 AND w NOT IN ({STOP_SQL})), '|') AS out FROM documents""",
)
def _(spark, sf):
    words = tx.keep_words(F.lower(F.col("content")), min_word_length=3)
    return _docs(spark, sf).select("id", F.array_join(words, "|").alias("out"))


@query("T8_preprocess", f"SELECT doc_id AS id, array_to_string({sql_tokens()}, ' ') AS clean FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("id", tx.preprocess(F.col("content")).alias("clean"))


@query(
    "T8_preprocess_flags_off",
    rf"""SELECT doc_id AS id, trim(regexp_replace({sql_symbols(sql_paths("lower(text)"))}, '\s+', ' ', 'g'))
         AS clean FROM documents""",
)
def _(spark, sf):
    flags = dict(
        remove_stopwords=False, min_word_length=1, remove_numbers=False, remove_urls=False,
        remove_emails=False,
    )
    return _docs(spark, sf).select("id", tx.preprocess(F.col("content"), **flags).alias("clean"))


@query(
    "T9_tokenize",
    r"""SELECT doc_id AS id, len(t) AS n_tokens, t[1] AS first_token, t[-1] AS last_token FROM (
        SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS t FROM documents)""",
)
def _(spark, sf):
    t, text = F.col("t"), F.col("content")
    # as in SQL: blank texts have no first and last token, null texts no count either
    return _docs(spark, sf).select("id", F.when(text.isNotNull(), tx.tokenize(text)).alias("t")).select(
        "id",
        F.array_size(t).cast("bigint").alias("n_tokens"),
        F.try_element_at(t, F.lit(1)).alias("first_token"),
        F.try_element_at(t, F.lit(-1)).alias("last_token"),
    )


@query(
    "T10_ngrams",
    f"""SELECT doc_id AS id, array_to_string({sql_terms('t')}, '|') AS terms
        FROM (SELECT doc_id, {sql_tokens()} AS t FROM documents)""",
)
def _(spark, sf):
    return with_terms(_docs(spark, sf)).select("id", F.array_join("terms", "|").alias("terms"))


@query(
    "T11_preview",
    "SELECT doc_id AS id, "
    + ", ".join(
        f"CASE WHEN length(text) > {n} THEN left(text, {n}) || '...' ELSE text END AS p{n}"
        for n in (80, 200, 500, 1000)
    )
    + " FROM documents",
)
def _(spark, sf):
    return _docs(spark, sf).select("id", *[tx.preview(F.col("content"), n).alias(f"p{n}") for n in (80, 200, 500, 1000)])


@query(
    "T12_truncate_words",
    """SELECT doc_id AS id, CASE WHEN length(text) <= 105 THEN text
        ELSE CASE WHEN contains(left(text, 97), ' ')
                  THEN regexp_extract(left(text, 97), '(?s)^(.*) ', 1) ELSE left(text, 97) END || '...' END AS out
        FROM documents""",
)
def _(spark, sf):
    return _docs(spark, sf).select("id", tx.truncate_words(F.col("content")).alias("out"))


@query(
    "W11_sanitize_key",
    r"""SELECT page_id AS id, CASE WHEN length(k) > 100 THEN left(k, 80) || '___' || right(k, 17) ELSE k END AS key
        FROM (SELECT page_id, regexp_replace(url || '#' || html, '[^\p{L}\p{N}._-]', '_', 'g') AS k FROM pages)""",
)
def _(spark, sf):
    long_url = F.concat("url", F.lit("#"), F.col("html"))
    return tb.raw(spark, sf, "pages").select(
        F.col("page_id").alias("id"), tx.sanitize_key(long_url).alias("key")
    )


@query(
    "W12_crawl_key",
    r"""SELECT page_id AS id, right(regexp_replace(url || '#' || html, '[^\p{L}\p{N}]', '_', 'g'), 150) AS key
        FROM pages""",
)
def _(spark, sf):
    long_url = F.concat("url", F.lit("#"), F.col("html"))
    return tb.raw(spark, sf, "pages").select(
        F.col("page_id").alias("id"), tx.crawl_key(long_url).alias("key")
    )


@query(
    "X7_clean_whitespace",
    r"""SELECT doc_id AS id, array_to_string(list_filter(list_transform(
          string_split_regex(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\r\n|\n|\r'),
          lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), chr(10)) AS out FROM documents""",
)
def _(spark, sf):
    return _docs(spark, sf).select("id", tx.clean_whitespace(F.col("content")).alias("out"))


@query("X9_domain", "SELECT page_id AS id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain FROM pages")
def _(spark, sf):
    return tb.raw(spark, sf, "pages").select(
        F.col("page_id").alias("id"), tx.domain_of(F.col("url")).alias("domain")
    )

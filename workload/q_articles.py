"""Article queries: scans, writes, search and labelling (S, W1-W12, Q)."""

from functools import reduce

from pyspark.sql import functions as F

from siftline.functions import labels as lb
from siftline.operators import articles as ar
from siftline.operators import content_store as cs
from siftline.operators.text_index import TextIndex
from siftline.session import work_path
from siftline.sources import readers, writers
from workload import tables as tb
from workload.registry import query

ART = tb.with_tables("articles")
ALL = "id, url, title, content, domain, publish_date, date_extracted, date_stored, source, status, labels"


def _articles(spark, sf):
    return tb.articles(spark, sf)


def _incoming(spark, sf):
    """Chat turns under one url per conversation (many records per url, some
    without title) and the labelled articles crawled again."""
    chats = tb.raw(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.concat(F.lit("https://chat.example.org/"), F.col("conv_id").cast("string")).alias("url"),
        F.when(F.col("role") != "assistant", F.col("role")).alias("title"),
        F.col("text").alias("content"),
    )
    again = (
        tb.articles(spark, sf).filter("labels <> '{}'")
        .select((F.lit(10**12) + F.col("id")).alias("seq"), "url", F.concat(F.lit("again: "), "title").alias("title"), "content")
    )
    return chats.unionByName(again)


INCOMING_SQL = """incoming AS (
  SELECT conv_id * 1000 + turn AS seq, 'https://chat.example.org/' || conv_id AS url,
         CASE WHEN role <> 'assistant' THEN role END AS title, text AS content FROM conversations
  UNION ALL
  SELECT 1000000000000 + id, url, 'again: ' || title, content FROM articles WHERE labels <> '{}')"""


def _upsert_sql(where: str) -> str:
    return tb.with_tables("articles", extra=INCOMING_SQL) + f""", numbered AS (
  SELECT *, (SELECT max(id) FROM articles) + row_number() OVER (ORDER BY seq) AS id,
         row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS rk FROM incoming WHERE {where})
SELECT {ALL} FROM articles WHERE url NOT IN (SELECT url FROM numbered)
UNION ALL
SELECT id, url, coalesce(title, ''), coalesce(content, ''), '', '', '', '{tb.NOW}', 'crawler',
       CAST(0 AS INTEGER), '{{}}' FROM numbered WHERE rk = 1"""


@query("S1_read_pages", "SELECT url, length(html) AS html_length, CAST(0 AS INTEGER) AS depth, CAST(200 AS INTEGER) AS status FROM pages")
def _(spark, sf):
    pages = readers.read_pages(spark, f"{sf}/pages.parquet")
    return pages.select("url", F.length("html").cast("bigint").alias("html_length"), "depth", "status")


@query("S2_load_labeled", ART + f"SELECT {ALL} FROM articles WHERE labels NOT IN ('', '{{}}') ORDER BY id")
def _(spark, sf):
    return ar.load_articles(_articles(spark, sf))


@query(
    "S2_load_relevant_limit",
    ART + f"SELECT {ALL} FROM articles WHERE json_extract_string(labels, '$.is_relevant') = 'true' ORDER BY id LIMIT 50",
)
def _(spark, sf):
    return ar.load_articles(_articles(spark, sf), only_relevant=True, limit=50)


S3_SQL = tb.with_tables("labeled") + "SELECT id, label, length(content) AS n FROM labeled WHERE content <> ''"


def _labeled_back(spark, path, fmt):
    back = lb.resolve_label(readers.read_labeled_json(spark, path, fmt), "is_relevant")
    return back.select("id", "label", F.length("content").cast("bigint").alias("n"))


@query("S3_read_labeled_json", S3_SQL)
def _(spark, sf):
    """Array files: one array of neighbouring ids per file."""
    path = work_path(spark, "labeled-json")
    rows = tb.labeled(spark, sf).select("id", "content", F.col("label").alias("is_relevant"))
    arrays = rows.groupBy(F.floor(F.col("id") / 1000)).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.select("value", F.monotonically_increasing_id().alias("file")).write.partitionBy("file").text(path)
    return _labeled_back(spark, path, "array")


@query("S3_read_labeled_json_lines", S3_SQL)
def _(spark, sf):
    path = work_path(spark, "labeled-json-lines")
    tb.labeled(spark, sf).select("id", "content", F.col("label").alias("is_relevant")).write.json(path)
    return _labeled_back(spark, path, "lines")


@query(
    "S4_read_text_lines",
    r"""SELECT line AS text, count(*) AS n FROM (
          SELECT regexp_replace(unnest(string_split_regex(text, '\r\n|\n|\r')), '^\s+|\s+$', '', 'g') AS line FROM documents)
        WHERE line <> '' GROUP BY line""",
)
def _(spark, sf):
    path = work_path(spark, "lines")
    tb.raw(spark, sf, "documents").select(F.col("text").alias("value")).write.text(path)
    return readers.read_text_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("S5_load_labeled_data", tb.with_tables("labeled") + "SELECT id, label FROM labeled WHERE content <> ''")
def _(spark, sf):
    return ar.load_labeled_data(_articles(spark, sf), None).select("id", "label")


# no stored labels: the fallback rows decide
@query("S5_load_labeled_fallback", tb.with_tables("labeled") + "SELECT id, label FROM labeled WHERE content <> ''")
def _(spark, sf):
    unlabeled = _articles(spark, sf).filter("labels = '{}'")
    fallback = tb.labeled(spark, sf).select(
        "id", "content", F.lit(None).cast("string").alias("labels"), F.col("label").cast("string").alias("is_relevant")
    )
    return ar.load_labeled_data(unlabeled, fallback).select("id", "label")


@query("W1_upsert_articles", _upsert_sql("TRUE"))
def _(spark, sf):
    return ar.upsert_articles(_articles(spark, sf), _incoming(spark, sf), tb.NOW)[0]


@query("W1_upsert_added", tb.with_tables("articles", extra=INCOMING_SQL) + "SELECT count(*) AS added FROM incoming")
def _(spark, sf):
    return ar.upsert_articles(_articles(spark, sf), _incoming(spark, sf), tb.NOW)[1]


@query("W2_insert_strict", _upsert_sql("title IS NOT NULL AND content IS NOT NULL"))
def _(spark, sf):
    return ar.insert_articles_strict(_articles(spark, sf), _incoming(spark, sf), tb.NOW)[0]


@query(
    "W3_patch_articles",
    ART
    + f"""SELECT a.id, url, CASE WHEN l.toxic = 1 THEN NULL ELSE title END AS title, content, domain, publish_date, date_extracted,
            CASE WHEN l.doc_id IS NOT NULL THEN '{tb.NOW}' ELSE date_stored END AS date_stored, a.source,
            CASE WHEN l.doc_id IS NOT NULL THEN CAST(quality + 1 AS INTEGER) ELSE status END AS status, labels
          FROM articles a LEFT JOIN labels l ON l.doc_id = a.id""",
)
def _(spark, sf):
    marks = tb.raw(spark, sf, "labels")
    patches = marks.select(
        F.col("doc_id").alias("id"),
        # a toxic article loses its title: null is a supplied value
        F.when(F.col("toxic") == 1, F.array(F.lit("status"), F.lit("title")))
        .otherwise(F.array(F.lit("status"))).alias("fields"),
        F.lit(None).cast("string").alias("title"),
        (F.col("quality") + 1).alias("status"),
    )
    return ar.patch_articles(_articles(spark, sf), patches, tb.NOW)


@query("W4_delete_articles", ART + f"SELECT {ALL} FROM articles WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, sf):
    keys = tb.raw(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return ar.delete_articles(_articles(spark, sf), keys)


@query(
    "W5_append_session",
    """SELECT user_id AS id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS start_time, count(*) AS urls_processed,
              count(*) FILTER (WHERE event_type <> 'error') AS success_count, 'job-' || user_id AS name
       FROM events GROUP BY user_id""",
)
def _(spark, sf):
    sessions = tb.raw(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"),
        F.count(F.lit(1)).alias("urls_processed"),
        F.count_if(F.col("event_type") != "error").alias("success_count"),
    ).withColumns({"name": F.concat(F.lit("job-"), F.col("id").cast("string")), "max_depth": F.lit(2)})
    path = work_path(spark, "sessions")
    writers.append_session(sessions, path, ["name", "max_depth"])
    return spark.read.parquet(path).select(
        "id", "start_time", "urls_processed", "success_count", F.get_json_object("config", "$.name").alias("name")
    )


EXPORT_SQL = ART + """SELECT id, url, title, content, date_extracted FROM articles
  WHERE date_extracted >= '2024-01-01T02' ORDER BY date_extracted DESC, id"""


@query("W6_export_json", EXPORT_SQL)
def _(spark, sf):
    path = work_path(spark, "export-json")
    writers.export_json(_articles(spark, sf), path, {"start_date": "2024-01-01T02"})
    schema = "id bigint, url string, title string, content string, date_extracted string"
    return spark.read.schema(schema).json(path)


@query("W6_export_json_limited", EXPORT_SQL + " LIMIT 50")
def _(spark, sf):
    path = work_path(spark, "export-json-limited")
    writers.export_json(_articles(spark, sf), path, {"start_date": "2024-01-01T02", "limit": 50})
    schema = "id bigint, url string, title string, content string, date_extracted string"
    return spark.read.schema(schema).json(path)


@query("W7_export_csv", EXPORT_SQL)
def _(spark, sf):
    path = work_path(spark, "export-csv")
    writers.export_csv(_articles(spark, sf), path, {"start_date": "2024-01-01T02"})
    back = writers.read_csv(spark, path, "id bigint, url string, title string, content string, domain string, "
                            "publish_date string, date_extracted string, date_stored string, source string, status int, labels string")
    return back.select("id", "url", "title", "content", "date_extracted")


LABELED_EXPORT_SQL = ART + """SELECT id, url, title, CASE json_extract_string(labels, '$.is_relevant')
    WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE -1 END AS is_relevant
  FROM articles WHERE labels NOT IN ('', '{}') ORDER BY id"""


@query("W8_labeled_export_json", LABELED_EXPORT_SQL)
def _(spark, sf):
    path = work_path(spark, "labeled-export-json")
    writers.export_labeled(_articles(spark, sf), path, "json")
    return spark.read.schema("id bigint, url string, title string, is_relevant int").json(path)


@query("W8_labeled_export_csv", LABELED_EXPORT_SQL)
def _(spark, sf):
    path = work_path(spark, "labeled-export-csv")
    writers.export_labeled(_articles(spark, sf), path, "csv")
    schema = ("id bigint, url string, title string, domain string, publish_date string, date_extracted string, "
              "date_stored string, source string, status int, labels string, is_relevant int")
    return writers.read_csv(spark, path, schema).select("id", "url", "title", "is_relevant")


def _stored(spark, sf):
    """Content store of the labelled articles."""
    return cs.write_content(None, _articles(spark, sf).filter("labels <> '{}'").select(
        F.col("id").alias("seq"), "url", "title", "content"), "2024-01-01T00:00:00")[0]


KEY_SQL = r"regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g')"


def _content_sql(overwrite: bool) -> str:
    order = "DESC" if overwrite else "ASC"
    first = "incoming" if overwrite else "old"
    other = "old" if overwrite else "incoming"
    return tb.with_tables("articles", extra=INCOMING_SQL) + f""", old AS (
  SELECT {KEY_SQL} AS content_id, url, title, content, '2024-01-01T00:00:00' AS timestamp
  FROM articles WHERE labels <> '{{}}'),
new AS (SELECT * FROM (SELECT {KEY_SQL} AS content_id, url, title, content, '{tb.NOW}' AS timestamp,
          row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY seq {order}) AS rk FROM incoming) WHERE rk = 1)
SELECT content_id, url, title, content, timestamp FROM {'new' if overwrite else 'old'}
UNION ALL
SELECT content_id, url, title, content, timestamp FROM {'old' if overwrite else 'new'}
WHERE content_id NOT IN (SELECT content_id FROM {'new' if overwrite else 'old'})"""


@query("W9_write_content", _content_sql(False))
def _(spark, sf):
    return cs.write_content(_stored(spark, sf), _incoming(spark, sf), tb.NOW)[0]


@query("W9_write_content_overwrite", _content_sql(True))
def _(spark, sf):
    return cs.write_content(_stored(spark, sf), _incoming(spark, sf), tb.NOW, overwrite=True)[0]


@query("W10_list_contents", ART + f"SELECT DISTINCT {KEY_SQL} AS content_id FROM articles WHERE labels <> '{{}}'")
def _(spark, sf):
    return cs.list_contents(_stored(spark, sf))


@query(
    "W10_read_content",
    ART + "SELECT url, title, content FROM articles WHERE labels <> '{}' AND url = 'https://src1.example.org/en/1'",
)
def _(spark, sf):
    return cs.read_content(_stored(spark, sf), "https://src1.example.org/en/1").select("url", "title", "content")


@query(
    "Q1_search_articles",
    ART + f"""SELECT * REPLACE (json(labels)::VARCHAR AS labels) FROM (SELECT {ALL} FROM articles WHERE domain = 'src7.example.org' AND date_extracted >= '2024-01-01T01'
      AND date_extracted <= '2024-01-20' AND (title ILIKE '%THE%' OR content ILIKE '%THE%')
      ORDER BY date_extracted DESC, id LIMIT 20 OFFSET 3)""",
)
def _(spark, sf):
    page = ar.search_results(
        _articles(spark, sf), domain="src7.example.org", start_date="2024-01-01T01", end_date="2024-01-20",
        content_filter="THE", limit=20, offset=3,
    )
    return page.withColumn("labels", F.col("labels").cast("string"))


# four keywords over one stored index: frequent, rare, of two letters, with wildcards
KEYWORDS = ["tion", "Zungsch", "ij", "th_%on"]


@query(
    "Q1_indexed_search",
    ART + " UNION ALL ".join(
        f"SELECT '{k}' AS keyword, id, url FROM articles WHERE title ILIKE '%{k}%' OR content ILIKE '%{k}%'" for k in KEYWORDS
    ),
)
def _(spark, sf):
    index = TextIndex.create(_articles(spark, sf), ["title", "content"], "id")
    hits = [index.search(k).select(F.lit(k).alias("keyword"), "id", "url") for k in KEYWORDS]
    return reduce(lambda a, b: a.union(b), hits)


# wildcards inside the text searched for
@query(
    "Q1_search_wildcards",
    ART + f"""SELECT {ALL} FROM articles WHERE title ILIKE '%th_%on%' OR content ILIKE '%th_%on%'
      ORDER BY date_extracted DESC, id LIMIT 100""",
)
def _(spark, sf):
    return ar.search_articles(_articles(spark, sf), content_filter="th_%on")


@query("Q2_count_articles", ART + "SELECT count(*) AS total FROM articles WHERE title ILIKE '%que%' OR content ILIKE '%que%'")
def _(spark, sf):
    return ar.count_articles(_articles(spark, sf), content_filter="que")


@query(
    "Q3_get_articles",
    ART + """SELECT id, url, title, json_extract_string(labels, '$.labeled_by') AS labeled_by FROM articles
      WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def _(spark, sf):
    keys = tb.raw(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return ar.get_articles(_articles(spark, sf), keys).select(
        "id", "url", "title", F.try_variant_get("labels", "$.labeled_by", "string").alias("labeled_by")
    )


@query(
    "Q4_labeling_queue",
    ART + """SELECT id, url, title FROM (SELECT * FROM articles WHERE labels IS NULL OR labels IN ('{}', '')
        ORDER BY date_extracted DESC, id LIMIT 50) q
      WHERE id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')""",
)
def _(spark, sf):
    done = tb.raw(spark, sf, "documents").filter("source = 'src1'").select(F.col("doc_id").alias("id"))
    return ar.labeling_queue(_articles(spark, sf), done, 50).select("id", "url", "title")


@query(
    "Q5_apply_labels",
    ART + f"""SELECT a.id, CASE WHEN l.doc_id IS NULL THEN labels
           ELSE '{{"is_relevant":' || CASE WHEN toxic = 0 THEN 'true' ELSE 'false' END
                || ',"labeled_by":"manual","labeled_date":"{tb.NOW}"}}' END AS labels,
           CASE WHEN l.doc_id IS NULL THEN date_stored ELSE '{tb.NOW}' END AS date_stored
      FROM articles a LEFT JOIN labels l ON l.doc_id = a.id""",
)
def _(spark, sf):
    decisions = tb.raw(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), (1 - F.col("toxic")).alias("label")
    )
    return ar.apply_labels(_articles(spark, sf), decisions, tb.NOW).select("id", "labels", "date_stored")


# decisions: toxic ones are skipped
@query(
    "Q6_labeling_stats",
    """SELECT count(*) FILTER (WHERE y >= 0) AS total_labeled, count(*) FILTER (WHERE y = 1) AS labeled_relevant,
         count(*) FILTER (WHERE y = 0) AS labeled_not_relevant, count(*) FILTER (WHERE y = -1) AS skipped,
         90.0::DOUBLE AS duration_seconds,
         round(count(*) FILTER (WHERE y = 1) * 100.0 / count(*) FILTER (WHERE y >= 0), 6)::DOUBLE AS relevance_percentage
       FROM (SELECT CASE WHEN toxic = 1 THEN -1 ELSE quality END AS y FROM labels)""",
)
def _(spark, sf):
    decisions = tb.raw(spark, sf, "labels").select(
        F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality")).alias("label")
    )
    return ar.labeling_stats(decisions, 90.0).withColumn(
        "relevance_percentage", F.round("relevance_percentage", 6)
    )

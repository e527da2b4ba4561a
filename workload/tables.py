"""The library's tables derived from the driver's tables, in Spark and in SQL.

Both forms follow the same definitions, so that a query and its SQL twin start
from equal inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import cut_lineage

NOW = "2024-03-01T12:00:00"


def spread(df: DataFrame) -> DataFrame:
    """The driver's tables at the small scales are one file with one row group, which one
    task would read; here, and nowhere in the library, they are dealt out first."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _article_columns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    labels_json = F.when(
        F.col("quality").isNotNull(),
        F.concat(
            F.lit('{"is_relevant": '),
            F.when(F.col("quality") == 1, "true").otherwise("false"),
            F.lit(', "labeled_by": "manual"}'),
        ),
    ).otherwise("{}")
    extracted = F.expr(
        "date_format(timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00'), "
        "\"yyyy-MM-dd'T'HH:mm:ss\")"
    )
    host = F.concat("source", F.lit(".example.org"))
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://"), host, F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        host.alias("domain"),
        F.lit("").alias("publish_date"),
        extracted.alias("date_extracted"),
        extracted.alias("date_stored"),
        F.lit("crawler").alias("source"),
        F.lit(0).alias("status"),
        labels_json.alias("labels"),
    )


def articles(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    docs = raw(spark, sf, "documents")
    return _article_columns(spread(docs) if heavy else docs, raw(spark, sf, "labels"))


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    """(id, content, label) of the labelled documents."""
    docs = spread(raw(spark, sf, "documents").select("doc_id", "text"))
    return docs.join(raw(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("quality").alias("label")
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(id, content) of all documents, spread over enough tasks for text work."""
    docs = spread(raw(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(raw(spark, sf, "pages"))
    return rows.select(
        F.col("page_id").alias("seq"), "url", "html", F.lit(0).alias("depth"), F.lit(200).alias("status"),
        F.expr("timestampadd(SECOND, page_id, TIMESTAMP'2024-01-01 00:00:00')").alias("fetched_at"),
    )


#: Class or id of the part beside the text of a made page; the last two name nothing ignored.
MARKS = [
    "top-nav", "main-navbar", "Menu", "page-HEADER", "footer2", "left-sidebar", "comments", "read-more",
    "advertisement", "social", "share", "related", "plain", "note",
]


def made_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page made of every document: its text, a marked part, and a date in one of eight places.

    The date is a day that follows from the id; place 7 has none.
    """
    docs = spread(raw(spark, sf, "documents").select("doc_id", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    day = F.expr("timestampadd(DAY, doc_id % 300, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    iso, place = F.date_format(day, "yyyy-MM-dd"), F.pmod("doc_id", F.lit(8))
    head = (
        F.when(place == 1, F.concat(F.lit('<meta name="pubdate" content="'), iso, F.lit('">')))
        .when(place == 2, F.concat(F.lit('<meta property="article:published_time" content="'), iso, F.lit('T08:00">')))
        .when(place == 6, F.concat(F.lit('<meta name="date" content="'), iso, F.lit('">')))
        .otherwise("")
    )
    body = (
        F.when(place == 0, F.concat(F.lit('<time datetime="'), iso, F.lit('">once</time>')))
        .when(place == 3, F.concat(F.lit('<b class="Post-Date">Posted '), F.date_format(day, "M/d/yyyy"), F.lit("</b>")))
        .when(place == 4, F.concat(F.lit('<b class="timeline">on '), F.date_format(day, "MMM d, yyyy"), F.lit("</b>")))
        .when(place == 5, F.concat(F.lit('<b datetime="'), iso, F.lit('T10:30">then</b>')))
        .when(place == 6, "<time>no stamp</time>")
        .otherwise("")
    )
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.pmod("doc_id", F.lit(len(MARKS))) + 1).cast("int"))
    names = F.when(F.floor(F.col("doc_id") / len(MARKS)) % 2 == 0, F.lit("class")).otherwise("id")
    html = F.concat(
        F.lit("<html><head>"), head, F.lit("</head><body>"), body,
        F.lit('<div class="content"><p>'), text, F.lit("</p><section "), names, F.lit('="'), mark, F.lit('">\nBeside '),
        F.col("doc_id").cast("string"), F.lit("</section><script>var x = 1;</script></div></body></html>"),
    )
    return docs.select("doc_id", F.concat(F.lit("https://made.example.org/"), F.col("doc_id")).alias("url"), html.alias("html"))


def _ranked(names: DataFrame) -> DataFrame:
    """Ids by name rank over the few distinct names."""
    from pyspark.sql import Window

    return names.select(F.row_number().over(Window.orderBy("name")).cast("bigint").alias("id"), "name")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    names = raw(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    return _ranked(names).select(
        "id", "name", F.concat(F.lit("https://"), "name", F.lit(".example.org")).alias("url"),
        at.alias("created_at"), at.alias("updated_at"),
    )


def _tag_names(spark: SparkSession, sf: str) -> DataFrame:
    """(incident_id, name) before ids."""
    by_lang = raw(spark, sf, "documents").select(F.col("doc_id").alias("incident_id"), F.col("lang").alias("name"))
    marks = raw(spark, sf, "labels").select(
        F.col("doc_id").alias("incident_id"),
        F.explode(F.array_compact(F.array(
            F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low-quality")
        ))).alias("name"),
    )
    return by_lang.unionByName(marks)


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_tag_names(spark, sf).select("name").distinct()).withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp_ntz")
    )


def incident_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _tag_names(spark, sf).join(tags(spark, sf), "name").select(
        "incident_id", F.col("id").alias("tag_id")
    )


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("timestampadd(HOUR, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    src = sources(spark, sf).select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return raw(spark, sf, "documents").join(src, "source", "left").select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        "source_id",
        F.concat(
            F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"),
            F.col("doc_id").cast("string"),
        ).alias("source_reference"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def job_executions(spark: SparkSession, sf: str) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    user = F.col("user_id").cast("string")
    return raw(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("job-"), user).alias("job_id"),
        F.concat(F.lit("https://site-"), user, F.lit(".example.org/")).alias("url"),
        at.alias("start_time"),
        at.alias("end_time"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.floor("value").cast("int").alias("urls_processed"),
        F.lit(0).alias("relevant_found"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        at.alias("created_at"),
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    per_user = raw(spark, sf, "events").groupBy("user_id").agg(
        F.max("ts").alias("last"),
        F.min("ts").alias("first"),
        F.count(F.lit(1)).cast("int").alias("run_count"),
        F.max_by("event_type", "ts").alias("last_type"),
    )
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    user = F.col("user_id").cast("string")
    minutes = (F.lit(60) + F.col("user_id") % 5 * 60).cast("int")
    return per_user.select(
        F.concat(F.lit("job-"), user).alias("job_id"),
        F.concat(F.lit("https://site-"), user, F.lit(".example.org/")).alias("url"),
        minutes.alias("interval_minutes"),
        F.lit(50).alias("max_urls"),
        F.when(
            F.col("last_type") != "signup",
            F.date_format(F.expr("timestampadd(MINUTE, 60 + user_id % 5 * 60, last)"), fmt),
        ).alias("next_run"),
        F.when(F.col("last_type") == "purchase", "running").otherwise("idle").alias("status"),
        F.date_format("last", fmt).alias("last_run"),
        "run_count",
        F.date_format("first", fmt).alias("created_at"),
    )


def edges(spark: SparkSession, sf: str, held: bool = False) -> DataFrame:
    """A page graph: parts and suppliers link each other through the line items.

    ``held`` stores the pairs for queries that read the links more than once.
    """
    li = raw(spark, sf, "lineitem")
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    # grouped on the numbers; the urls are made of what is left
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(F.min(pos).alias("pos"))
    if held:
        pairs = cut_lineage(pairs, "pairs")
    part = F.concat(F.lit("https://parts.example.org/"), F.col("l_partkey").cast("string"))
    supp = F.concat(F.lit("https://suppliers.example.org/"), F.col("l_suppkey").cast("string"))
    both = F.array(
        F.struct(part.alias("src_url"), supp.alias("link")),
        F.struct(supp.alias("src_url"), part.alias("link")),
    )
    return pairs.select("pos", F.explode(both).alias("e")).select("e.src_url", "pos", "e.link")


def graph_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of that graph; parts of size 7, 14, ... failed to load."""
    parts = raw(spark, sf, "part").select(
        F.concat(F.lit("https://parts.example.org/"), F.col("p_partkey").cast("string")).alias("url"),
        F.when(F.col("p_size") % 7 == 0, 404).otherwise(200).alias("status"),
        (F.col("p_size") % 3 != 0).alias("relevant"),
    )
    supps = raw(spark, sf, "supplier").select(
        F.concat(F.lit("https://suppliers.example.org/"), F.col("s_suppkey").cast("string")).alias("url"),
        F.lit(200).alias("status"),
        (F.col("s_acctbal") > 0).alias("relevant"),
    )
    return parts.unionByName(supps)


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds: the suppliers of the first nation."""
    return raw(spark, sf, "supplier").filter(F.col("s_nationkey") == 0).select(
        F.concat(F.lit("https://suppliers.example.org/"), F.col("s_suppkey").cast("string")).alias("url"),
        F.col("s_suppkey").alias("pos"),
    )


# ------------------------------------------------------------------ SQL twins

SQL = {
    "articles": """articles AS (
  SELECT d.doc_id AS id,
         'https://' || source || '.example.org/' || lang || '/' || d.doc_id AS url,
         split_part(text, chr(10), 1) AS title, text AS content,
         source || '.example.org' AS domain, '' AS publish_date,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(d.doc_id), '%Y-%m-%dT%H:%M:%S') AS date_extracted,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(d.doc_id), '%Y-%m-%dT%H:%M:%S') AS date_stored,
         'crawler' AS source, CAST(0 AS INTEGER) AS status,
         CASE WHEN quality IS NULL THEN '{}'
              ELSE '{"is_relevant": ' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END
                   || ', "labeled_by": "manual"}' END AS labels
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "labeled": """labeled AS (
  SELECT d.doc_id AS id, text AS content, quality AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)""",
    "sources": """sources AS (
  SELECT row_number() OVER (ORDER BY name) AS id, name, 'https://' || name || '.example.org' AS url,
         TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at
  FROM (SELECT DISTINCT source AS name FROM documents))""",
    "tag_names": """tag_names AS (
  SELECT doc_id AS incident_id, lang AS name FROM documents
  UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'low-quality' FROM labels WHERE quality = 0)""",
    "tags": """tags AS (
  SELECT row_number() OVER (ORDER BY name) AS id, name, TIMESTAMP '2024-01-01' AS created_at
  FROM (SELECT DISTINCT name FROM tag_names))""",
    "incident_tags": """incident_tags AS (
  SELECT incident_id, t.id AS tag_id FROM tag_names n JOIN tags t ON t.name = n.name)""",
    "incidents": """incidents AS (
  SELECT d.doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description,
         s.id AS source_id,
         'https://' || source || '.example.org/' || lang || '/' || d.doc_id AS source_reference,
         TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS created_at,
         TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS updated_at
  FROM documents d LEFT JOIN sources s ON s.name = d.source)""",
    "job_executions": """job_executions AS (
  SELECT event_id AS id, 'job-' || user_id AS job_id,
         'https://site-' || user_id || '.example.org/' AS url,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS start_time,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS end_time,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
         CAST(floor(value) AS INTEGER) AS urls_processed, CAST(0 AS INTEGER) AS relevant_found,
         CASE WHEN event_type = 'error' THEN props END AS error,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
  FROM events)""",
    "jobs": """jobs AS (
  SELECT 'job-' || user_id AS job_id, 'https://site-' || user_id || '.example.org/' AS url,
         CAST(60 + user_id % 5 * 60 AS INTEGER) AS interval_minutes, CAST(50 AS INTEGER) AS max_urls,
         CASE WHEN max_by(event_type, ts) <> 'signup'
              THEN strftime(max(ts) + to_minutes(60 + user_id % 5 * 60), '%Y-%m-%dT%H:%M:%S.%f') END AS next_run,
         CASE WHEN max_by(event_type, ts) = 'purchase' THEN 'running' ELSE 'idle' END AS status,
         strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_run,
         CAST(count(*) AS INTEGER) AS run_count,
         strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS created_at
  FROM events GROUP BY user_id)""",
    "edges": """edges AS (
  SELECT src_url, link, min(pos) AS pos FROM (
    SELECT 'https://parts.example.org/' || l_partkey AS src_url,
           'https://suppliers.example.org/' || l_suppkey AS link,
           l_orderkey * 10 + l_linenumber AS pos FROM lineitem
    UNION ALL
    SELECT 'https://suppliers.example.org/' || l_suppkey, 'https://parts.example.org/' || l_partkey,
           l_orderkey * 10 + l_linenumber FROM lineitem)
  GROUP BY src_url, link)""",
    "graph_pages": """graph_pages AS (
  SELECT 'https://parts.example.org/' || p_partkey AS url,
         CASE WHEN p_size % 7 = 0 THEN 404 ELSE 200 END AS status, p_size % 3 <> 0 AS relevant FROM part
  UNION ALL
  SELECT 'https://suppliers.example.org/' || s_suppkey, 200, s_acctbal > 0 FROM supplier)""",
    "seeds": """seeds AS (
  SELECT 'https://suppliers.example.org/' || s_suppkey AS url, s_suppkey AS pos
  FROM supplier WHERE s_nationkey = 0)""",
}
_NEEDS = {
    "incidents": ["sources"],
    "tags": ["tag_names"],
    "incident_tags": ["tags"],
}


def with_tables(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named tables and what they depend on."""
    chosen: list[str] = []

    def add(name):
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in chosen:
            chosen.append(name)

    for name in names:
        add(name)
    parts = [SQL[n] for n in chosen] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n"

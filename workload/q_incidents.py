"""Incident, dashboard, monitoring and job queries (W14-W18, W22, W26, I, D, K, J)."""

from pyspark.sql import functions as F

from siftline.functions.dates import format_datetime
from siftline.operators import incidents as inc
from siftline.operators import monitoring as mon
from siftline.session import work_path
from siftline.sources import writers
from workload import tables as tb
from workload.registry import query

BASE = tb.with_tables("incidents", "tags", "incident_tags")


def _tables(spark, sf):
    return (
        tb.incidents(spark, sf), tb.sources(spark, sf), tb.tags(spark, sf), tb.incident_tags(spark, sf)
    )


def _flat(view):
    """A view without nested columns, for comparison."""
    return view.select(
        "id", "title", "source_reference",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
        F.col("source.name").alias("source_name"),
        F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("tag_names"),
    )


def _flat_sql(rows: str) -> str:
    return f"""SELECT i.id, i.title, i.source_reference, strftime(i.created_at, '%Y-%m-%d %H:%M:%S') AS created,
       s.name AS source_name, coalesce(string_agg(t.name, ',' ORDER BY t.id), '') AS tag_names
FROM ({rows}) i LEFT JOIN sources s ON s.id = i.source_id
LEFT JOIN incident_tags it ON it.incident_id = i.id LEFT JOIN tags t ON t.id = it.tag_id GROUP BY ALL"""


def _incoming(spark, sf):
    """Every chat message reported as an incident, tagged with role and a mark;
    messages with the same tags repeat their tag names."""
    return tb.raw(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.lit(None).cast("bigint").alias("source_id"),
        F.concat(F.lit("https://chat.example.org/"), F.col("conv_id").cast("string")).alias("source_reference"),
        F.array(F.col("role"), F.lit("toxic"), F.col("role")).alias("tags"),
    )


NEW_SQL = """incoming AS (
  SELECT conv_id * 1000 + turn AS seq, split_part(text, chr(10), 1) AS title, text AS description, role,
         'https://chat.example.org/' || conv_id AS source_reference,
         (SELECT max(id) FROM incidents) + row_number() OVER (ORDER BY conv_id * 1000 + turn) AS id FROM conversations),
named AS (SELECT id AS incident_id, seq, 0 AS pos, role AS name FROM incoming
          UNION SELECT id, seq, 1, 'toxic' FROM incoming),
new_tags AS (
  SELECT name, (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY seq, pos, name) AS id
  FROM (SELECT name, min(seq) AS seq, arg_min(pos, seq * 10 + pos) AS pos FROM named
        WHERE name NOT IN (SELECT name FROM tags) GROUP BY name)),
all_tags AS (SELECT id, name FROM tags UNION ALL SELECT id, name FROM new_tags)"""


@query(
    "W14_create_incidents",
    tb.with_tables("incidents", "tags", extra=NEW_SQL)
    + f"""SELECT id, title, description, coalesce(source_id, -1) AS source_id, source_reference, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM incidents
          UNION ALL SELECT id, title, description, -1, source_reference, '{tb.NOW.replace("T", " ")}' FROM incoming""",
)
def _(spark, sf):
    i, _, t, link = _tables(spark, sf)
    rows, _, _ = inc.create_incidents(i, t, link, _incoming(spark, sf), tb.NOW)
    return rows.select(
        "id", "title", "description", F.coalesce("source_id", F.lit(-1)).alias("source_id"), "source_reference",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
    )


@query("W14_created_tags", tb.with_tables("incidents", "tags", extra=NEW_SQL) + "SELECT id, name FROM all_tags")
def _(spark, sf):
    i, _, t, link = _tables(spark, sf)
    return inc.create_incidents(i, t, link, _incoming(spark, sf), tb.NOW)[1].select("id", "name")


@query(
    "W14_created_links",
    tb.with_tables("incidents", "incident_tags", extra=NEW_SQL)
    + """SELECT incident_id, tag_id FROM incident_tags
         UNION ALL SELECT incident_id, a.id FROM named n JOIN all_tags a ON a.name = n.name""",
)
def _(spark, sf):
    i, _, t, link = _tables(spark, sf)
    return inc.create_incidents(i, t, link, _incoming(spark, sf), tb.NOW)[2]


DOMAIN_SQL = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query(
    "W15_get_or_create_sources",
    tb.with_tables("sources")
    + f"""SELECT id, name, url FROM sources UNION ALL
          SELECT (SELECT max(id) FROM sources) + row_number() OVER (ORDER BY seq), name, url
          FROM (SELECT {DOMAIN_SQL} AS name, min(page_id) AS seq, arg_min(url, page_id) AS url FROM pages GROUP BY 1)
          WHERE name NOT IN (SELECT name FROM sources)""",
)
def _(spark, sf):
    from siftline.functions.text import domain_of

    incoming = tb.raw(spark, sf, "pages").select(
        F.col("page_id").alias("seq"), "url", domain_of(F.col("url")).alias("domain")
    )
    return inc.get_or_create_sources(tb.sources(spark, sf), incoming, tb.NOW).select("id", "name", "url")


def _patches(spark, sf):
    """Labelled incidents: toxic ones get a title and new tags, others an empty
    title (no change) and no tag list."""
    toxic = F.col("toxic") == 1
    return tb.raw(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("seq"),
        F.when(toxic, F.concat(F.lit("patched "), F.col("doc_id").cast("string"))).otherwise("").alias("title"),
        F.when(~toxic, F.lit("checked")).alias("description"),
        F.lit(None).cast("bigint").alias("source_id"),
        F.lit(None).cast("string").alias("source_reference"),
        F.when(toxic, F.array(F.lit("reviewed"), F.lit("toxic"))).alias("tags"),
    )


@query(
    "W16_patch_incidents",
    BASE
    + f"""SELECT i.id, CASE WHEN toxic = 1 THEN 'patched ' || i.id ELSE title END AS title,
            CASE WHEN toxic = 0 THEN 'checked' ELSE description END AS description, source_id, source_reference,
            CASE WHEN l.doc_id IS NULL THEN strftime(updated_at, '%Y-%m-%d %H:%M:%S') ELSE '{tb.NOW.replace("T", " ")}' END AS updated
          FROM incidents i LEFT JOIN labels l ON l.doc_id = i.id""",
)
def _(spark, sf):
    i, _, t, link = _tables(spark, sf)
    rows, _, _ = inc.patch_incidents(i, t, link, _patches(spark, sf), tb.NOW)
    return rows.select(
        "id", "title", "description", "source_id", "source_reference",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"),
    )


@query(
    "W16_patched_links",
    BASE
    + """SELECT incident_id, tag_id FROM incident_tags WHERE incident_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
         UNION ALL SELECT doc_id, (SELECT id FROM tags WHERE name = 'toxic') FROM labels WHERE toxic = 1
         UNION ALL SELECT doc_id, (SELECT max(id) + 1 FROM tags) FROM labels WHERE toxic = 1""",
)
def _(spark, sf):
    i, _, t, link = _tables(spark, sf)
    return inc.patch_incidents(i, t, link, _patches(spark, sf), tb.NOW)[2]


def _gone(spark, sf):
    return tb.raw(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))


@query("W17_delete_incidents", BASE + "SELECT id, title FROM incidents WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, sf):
    i, _, _, link = _tables(spark, sf)
    return inc.delete_incidents(i, link, _gone(spark, sf))[0].select("id", "title")


@query(
    "W17_deleted_links",
    BASE + "SELECT incident_id, tag_id FROM incident_tags WHERE incident_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
)
def _(spark, sf):
    i, _, _, link = _tables(spark, sf)
    return inc.delete_incidents(i, link, _gone(spark, sf))[1]


@query(
    "W18_create_tags",
    tb.with_tables("tags")
    + """SELECT id, name FROM tags UNION ALL
         SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY seq), event_type FROM (
           SELECT event_type, min(event_id) AS seq FROM events GROUP BY event_type)""",
)
def _(spark, sf):
    names = tb.raw(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"))
    return inc.create_tags(tb.tags(spark, sf), names, tb.NOW).select("id", "name")


EXEC_COLUMNS = "id, job_id, url, start_time, end_time, status, urls_processed, relevant_found, error"


@query("W22_append_executions", tb.with_tables("job_executions") + f"SELECT {EXEC_COLUMNS} FROM job_executions")
def _(spark, sf):
    path = work_path(spark, "executions")
    rows = tb.job_executions(spark, sf)
    writers.append_executions(rows.filter("status = 'failed'"), path)
    writers.append_executions(rows.filter("status <> 'failed'"), path)
    return spark.read.parquet(path).select(*EXEC_COLUMNS.split(", "))


METRICS_SQL = BASE + """SELECT count(*) AS incidents_total, (SELECT count(*) FROM sources) AS sources_total,
  (SELECT count(*) FROM tags) AS tags_total, max_by(id, created_at) AS last_incident_id,
  max_by(title, created_at) AS last_incident_title,
  strftime(max(created_at), '%Y-%m-%dT%H:%M:%S') AS last_incident_created_at FROM incidents"""


@query("W26_write_snapshot", METRICS_SQL)
def _(spark, sf):
    i, s, t, _ = _tables(spark, sf)
    path = work_path(spark, "status")
    metrics = mon.system_metrics(i, s, t)
    writers.write_snapshot(metrics, path)
    return spark.read.schema(metrics.schema).json(path)


@query("I1_incident_view", BASE + _flat_sql("SELECT * FROM incidents"))
def _(spark, sf):
    return _flat(inc.incident_view(*_tables(spark, sf)))


@query("I2_get_incident", BASE + _flat_sql("SELECT * FROM incidents WHERE id = 7"))
def _(spark, sf):
    return _flat(inc.get_incident(*_tables(spark, sf), 7))


TAGGED = """SELECT * FROM incidents WHERE source_id = 3 AND id IN (
  SELECT incident_id FROM incident_tags WHERE tag_id = (SELECT id FROM tags WHERE name = 'en'))"""


@query("I3_list_incidents", BASE + _flat_sql(f"SELECT * FROM ({TAGGED}) ORDER BY created_at DESC, id LIMIT 10 OFFSET 10"))
def _(spark, sf):
    return _flat(inc.list_incidents(*_tables(spark, sf), source_id=3, tag_name="en", page=2, per_page=10)[0])


@query(
    "I3_page_info",
    BASE + f"""SELECT count(*) AS total, CAST(2 AS INTEGER) AS page, CAST(10 AS INTEGER) AS per_page,
      CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM ({TAGGED})""",
)
def _(spark, sf):
    return inc.list_incidents(*_tables(spark, sf), source_id=3, tag_name="en", page=2, per_page=10)[1]


@query("I4_recent_incidents", BASE + _flat_sql("SELECT * FROM incidents ORDER BY created_at DESC, id LIMIT 10"))
def _(spark, sf):
    return _flat(inc.recent_incidents(*_tables(spark, sf)))


SEARCH_SQL = """SELECT i.id, title, description, s.name AS source_name FROM incidents i LEFT JOIN sources s ON s.id = i.source_id
  WHERE title ILIKE '%tion%' OR description ILIKE '%tion%' OR s.name ILIKE '%tion%' ORDER BY i.id LIMIT 50"""


@query("I5_search_incidents", BASE + SEARCH_SQL)
def _(spark, sf):
    return inc.search_incidents(tb.incidents(spark, sf), tb.sources(spark, sf), "TION")


@query("I6_list_sources", tb.with_tables("sources") + "SELECT id, name, url FROM sources")
def _(spark, sf):
    return inc.list_sources(tb.sources(spark, sf))


@query("I6_get_source", tb.with_tables("sources") + "SELECT id, name, url FROM sources WHERE id = 4")
def _(spark, sf):
    return inc.get_source(tb.sources(spark, sf), 4)


@query("I7_list_tags", tb.with_tables("tags") + "SELECT id, name FROM tags")
def _(spark, sf):
    return inc.list_tags(tb.tags(spark, sf))


@query("I7_get_tag", tb.with_tables("tags") + "SELECT id, name FROM tags WHERE id = 2")
def _(spark, sf):
    return inc.get_tag(tb.tags(spark, sf), 2)


@query(
    "D1_dashboard_kpis",
    BASE + """SELECT (SELECT count(*) FROM incidents) AS total_incidents, (SELECT count(*) FROM sources) AS total_sources,
      (SELECT count(*) FROM tags) AS total_tags""",
)
def _(spark, sf):
    i, s, t, _ = _tables(spark, sf)
    return inc.dashboard_kpis(i, s, t)


def _by_source_sql(rows: str) -> str:
    return BASE + f"""SELECT s.id AS source_id, s.name, count(i.id) AS incidents
      FROM sources s LEFT JOIN ({rows}) i ON i.source_id = s.id GROUP BY s.id, s.name"""


@query("D2_incidents_by_source", _by_source_sql("SELECT * FROM incidents"))
def _(spark, sf):
    return inc.incidents_by_source(tb.incidents(spark, sf), tb.sources(spark, sf))


@query("D4_recent_by_source", _by_source_sql("SELECT * FROM incidents ORDER BY created_at DESC, id LIMIT 10"))
def _(spark, sf):
    return inc.incidents_by_source(tb.incidents(spark, sf), tb.sources(spark, sf), recent_limit=10)


@query(
    "D3_incidents_timeline",
    BASE + """SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d, '%b %-d') AS label, count(i.id) AS incidents
      FROM (SELECT unnest(range(DATE '2024-01-17', DATE '2024-02-16', INTERVAL 1 DAY)) AS d)
      LEFT JOIN incidents i ON CAST(i.created_at AS DATE) = CAST(d AS DATE) GROUP BY d""",
)
def _(spark, sf):
    out = inc.incidents_timeline(tb.incidents(spark, sf), "2024-02-15")
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "D5_format_datetime",
    r"""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d %H:%M')
         WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE event_type END AS shown FROM events""",
)
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(F.col("event_type") == "error", F.concat(iso, F.lit("Z")))
        .when(F.col("event_type") == "click", iso)
        .otherwise(F.col("event_type"))
    )
    return tb.raw(spark, sf, "events").select(F.col("event_id").alias("id"), format_datetime(text).alias("shown"))


@query(
    "D7_search_display",
    BASE + f"""SELECT id, title, source_name, CASE WHEN length(description) <= 105 THEN description
        ELSE regexp_replace(left(description, 97), '(?s) [^ ]*$', '') || '...' END AS description FROM ({SEARCH_SQL})""",
)
def _(spark, sf):
    hits = inc.search_incidents(tb.incidents(spark, sf), tb.sources(spark, sf), "TION")
    return inc.search_display(hits)


@query(
    "D7_recent_display",
    BASE + f"""SELECT id, title, source_name, strftime(CAST(created AS TIMESTAMP), '%Y-%m-%d %H:%M') AS created,
        replace(tag_names, ',', ', ') AS tag_names
      FROM ({_flat_sql("SELECT * FROM incidents ORDER BY created_at DESC, id LIMIT 10")})""",
)
def _(spark, sf):
    return inc.recent_display(inc.recent_incidents(*_tables(spark, sf)))


@query("K1_system_metrics", METRICS_SQL)
def _(spark, sf):
    i, s, t, _ = _tables(spark, sf)
    return mon.system_metrics(i, s, t)


JOB_COLUMNS = "job_id, url, interval_minutes, max_urls, next_run, status, last_run, run_count, created_at"


@query(
    "J2_due_jobs",
    tb.with_tables("jobs")
    + f"SELECT {JOB_COLUMNS} FROM jobs WHERE status <> 'running' AND (next_run IS NULL OR next_run <= '2024-01-30T22')",
)
def _(spark, sf):
    return mon.due_jobs(tb.jobs(spark, sf), "2024-01-30T22")


@query("J5_job_history", tb.with_tables("job_executions") + f"SELECT {EXEC_COLUMNS} FROM job_executions ORDER BY end_time DESC, id DESC LIMIT 10")
def _(spark, sf):
    return mon.job_history(tb.job_executions(spark, sf)).select(*EXEC_COLUMNS.split(", "))


@query("J5_job_history_one", tb.with_tables("job_executions") + f"SELECT {EXEC_COLUMNS} FROM job_executions WHERE job_id = 'job-8'")
def _(spark, sf):
    return mon.job_history(tb.job_executions(spark, sf), "job-8", None).select(*EXEC_COLUMNS.split(", "))

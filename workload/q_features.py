"""Label and feature queries."""

from pyspark.sql import functions as F

from siftline.functions import labels as lb
from siftline.operators import features as ft
from siftline.plans.dataset import prepare_dataset
from workload import tables as tb
from workload.q_text import sql_terms, sql_tokens
from workload.registry import query

MAX_FEATURES = ft.FeatureSettings().max_features

# (id, term, tf) and the fitted vocabulary over a set of (id, content) rows
TF_SQL = f"""tf AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest({sql_terms('t')}) AS term FROM (SELECT id, {sql_tokens('content')} AS t FROM rows_in))
  GROUP BY id, term),
vocab AS (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, cnt AS count, df,
         ln((1 + (SELECT count(*) FROM rows_in)) / (1 + df)::DOUBLE) + 1 AS idf
  FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS cnt, count(*) AS df FROM tf GROUP BY term
        ORDER BY cnt DESC, term LIMIT {MAX_FEATURES}))"""
WEIGHTS_SQL = """weights AS (
  SELECT id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight
  FROM (SELECT tf.id, v.term, v.idx, tf.tf * v.idf AS w FROM tf JOIN vocab v ON v.term = tf.term))"""
ROWS_LABELED = "rows_in AS (SELECT id, content FROM labeled)"
ROWS_ALL = "rows_in AS (SELECT doc_id AS id, text AS content FROM documents)"


def feature_sql(rows: str, *more: str) -> str:
    return tb.with_tables("labeled", extra=",\n".join([rows, TF_SQL, *more]))


@query(
    "N1_parse_labels",
    tb.with_tables("articles")
    + "SELECT id, json_extract_string(labels, '$.labeled_by') AS labeled_by FROM articles",
)
def _(spark, sf):
    v = lb.parse_labels(F.col("labels"))
    return tb.articles(spark, sf).select(
        "id", F.try_variant_get(v, "$.labeled_by", "string").alias("labeled_by")
    )


@query(
    "N2_resolve_label",
    tb.with_tables("articles")
    + """SELECT id, CASE json_extract_string(labels, '$.is_relevant') WHEN 'true' THEN 1 ELSE 0 END AS label
         FROM articles WHERE content <> '' AND json_extract_string(labels, '$.is_relevant') IN ('true', 'false')""",
)
def _(spark, sf):
    return lb.resolve_label(tb.articles(spark, sf)).select("id", "label")


# json values of the events: numbers decide only when they are 0 or 1
@query(
    "N2_resolve_label_numbers",
    """SELECT event_id AS id, CAST(json_extract(props, '$.k') AS INTEGER) AS label FROM events
       WHERE CAST(json_extract(props, '$.k') AS INTEGER) IN (0, 1)""",
)
def _(spark, sf):
    rows = tb.raw(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("content"),
        F.concat(F.lit('{"is_relevant": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("labels"),
    )
    return lb.resolve_label(rows).select("id", "label")


@query("F1_vocabulary", feature_sql(ROWS_LABELED) + "SELECT term, idx, count, df, round(idf, 6) AS idf FROM vocab")
def _(spark, sf):
    return ft.vocabulary_table(tb.labeled(spark, sf)).withColumn("idf", F.round("idf", 6))


@query("F1_vocabulary_all_documents", feature_sql(ROWS_ALL) + "SELECT term, idx, count, df, round(idf, 6) AS idf FROM vocab")
def _(spark, sf):
    return ft.vocabulary_table(tb.documents(spark, sf)).withColumn("idf", F.round("idf", 6))


@query("F2_count_features", feature_sql(ROWS_LABELED) + "SELECT id, v.idx, tf FROM tf JOIN vocab v ON v.term = tf.term")
def _(spark, sf):
    rows = tb.labeled(spark, sf)
    return ft.count_features(rows, ft.fit_vocabulary(rows))


@query(
    "F3_tfidf_features",
    feature_sql(ROWS_LABELED, WEIGHTS_SQL) + "SELECT id, idx, round(weight, 6) AS weight FROM weights",
)
def _(spark, sf):
    rows = tb.labeled(spark, sf)
    return ft.tfidf_features(rows, ft.fit_vocabulary(rows)).withColumn("weight", F.round("weight", 6))


# vocabulary of the labelled rows, applied to every document
@query(
    "F4_transform_features",
    feature_sql(ROWS_LABELED)
    + f""", all_tf AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest({sql_terms('t')}) AS term
    FROM (SELECT doc_id AS id, {sql_tokens('text')} AS t FROM documents)) GROUP BY id, term)
SELECT d.doc_id AS id, count(v.idx) AS n_terms,
       CASE WHEN count(v.idx) > 0 THEN 1.0 ELSE 0.0 END AS norm
FROM documents d LEFT JOIN all_tf a ON a.id = d.doc_id LEFT JOIN vocab v ON v.term = a.term
GROUP BY d.doc_id""",
)
def _(spark, sf):
    vocab = ft.fit_vocabulary(tb.labeled(spark, sf))
    return ft.transform_features(tb.documents(spark, sf), vocab).select(
        "id", F.col("n_terms").cast("bigint").alias("n_terms"), F.round("norm", 6).alias("norm")
    )


@query("F5_feature_names", feature_sql(ROWS_LABELED) + "SELECT idx, term FROM vocab ORDER BY idx")
def _(spark, sf):
    return ft.feature_names(ft.vocabulary_table(tb.labeled(spark, sf)))


@query(
    "F6_vectorize",
    feature_sql(ROWS_LABELED, WEIGHTS_SQL)
    + """SELECT id, count(*) AS nnz, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest,
                CAST(min(idx) AS BIGINT) AS first_idx, CAST(max(idx) AS BIGINT) AS last_idx
         FROM weights GROUP BY id""",
)
def _(spark, sf):
    rows = tb.labeled(spark, sf)
    v = F.unwrap_udt(F.col("features"))
    # a plain filter would be pushed to the scan with all of the vectoriser in it, several times over
    kept = F.filter(F.array(v), lambda x: F.size(x["values"]) > 0)
    out = ft.vectorize(rows, ft.fit_vocabulary(rows)).select("id", F.explode_outer(kept).alias("v"))
    return out.filter(F.col("v").isNotNull()).select(
        "id",
        F.size("v.values").cast("bigint").alias("nnz"),
        F.round(F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.array_max("v.values"), 6).alias("largest"),
        F.array_min("v.indices").cast("bigint").alias("first_idx"),
        F.array_max("v.indices").cast("bigint").alias("last_idx"),
    )


SPLIT_SQL = """sizes AS (
  SELECT label, count(*) AS n, ceil(0.2 * sum(count(*)) OVER ()) * count(*) / sum(count(*)) OVER () AS exact,
         ceil(0.2 * sum(count(*)) OVER ()) AS n_test FROM labeled GROUP BY label),
take AS (
  SELECT label, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
         <= n_test - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS n_take FROM sizes),
split AS (
  SELECT r.id, r.label, CASE WHEN rk <= n_take THEN 'test' ELSE 'train' END AS split
  FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS rk FROM labeled) r
  JOIN take ON take.label = r.label)"""


@query("F7_stratified_split", tb.with_tables("labeled", extra=SPLIT_SQL) + "SELECT id, label, split FROM split")
def _(spark, sf):
    return ft.stratified_split(tb.labeled(spark, sf).select("id", "label"))


@query(
    "F8_prepare_dataset",
    tb.with_tables("labeled", extra=",\n".join([ROWS_LABELED, TF_SQL, SPLIT_SQL]))
    + """SELECT s.id, s.label, s.split, count(v.idx) AS n_terms FROM split s
         LEFT JOIN tf ON tf.id = s.id LEFT JOIN vocab v ON v.term = tf.term GROUP BY ALL""",
)
def _(spark, sf):
    ds = prepare_dataset(tb.articles(spark, sf, heavy=True))
    return ds.rows.select(
        "id", "label", "split",
        F.size(F.unwrap_udt(F.col("features"))["values"]).cast("bigint").alias("n_terms"),
    )


@query(
    "F9_dataset_metadata",
    tb.with_tables("labeled", extra=",\n".join([ROWS_LABELED, TF_SQL, SPLIT_SQL]))
    + """SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label = 0) AS class_0, count(*) FILTER (WHERE label = 1) AS class_1,
                CAST((SELECT count(*) FROM vocab) AS INTEGER) AS n_features FROM split GROUP BY split""",
)
def _(spark, sf):
    return prepare_dataset(tb.articles(spark, sf, heavy=True)).metadata()


# the first end-to-end query: strongest terms of every class
TOP_TERMS_SQL = feature_sql(ROWS_LABELED, WEIGHTS_SQL) + """
SELECT label, term, n_docs, round(total, 6) AS total FROM (
  SELECT l.label, w.term, count(*) AS n_docs, sum(w.weight) AS total,
         row_number() OVER (PARTITION BY l.label ORDER BY round(sum(w.weight), 9) DESC, w.term) AS rk
  FROM weights w JOIN labeled l ON l.id = w.id GROUP BY l.label, w.term) WHERE rk <= 20"""


@query("top_terms_per_class", TOP_TERMS_SQL)
def top_terms_per_class(spark, sf):
    from pyspark.sql import Window

    rows = tb.labeled(spark, sf)
    vocab = ft.fit_vocabulary(rows)
    entries = ft.vector_entries(
        ft.vectorize(rows, vocab).select(F.struct("id", "label").alias("key"), "features"), "key"
    )
    # at most max_features rows per class after the aggregate
    totals = entries.groupBy(F.col("key.label").alias("label"), "idx").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("value").alias("total")
    )
    named = totals.join(F.broadcast(vocab.to_df(spark).select("idx", "term")), "idx")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("total", 9)), "term"))
    return named.withColumn("rk", rank).filter(F.col("rk") <= 20).select(
        "label", "term", "n_docs", F.round("total", 6).alias("total")
    )

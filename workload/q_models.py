"""Model queries (M1-M18) and persistent bundles."""

from pyspark.sql import functions as F

from siftline.operators import features as ft
from siftline.operators import model as md
from siftline.plans.dataset import predict_rows, prepare_dataset, train_model
from siftline.session import work_path
from siftline.sources import bundles
from workload import tables as tb
from workload.q_features import ROWS_LABELED, SPLIT_SQL, feature_sql
from workload.q_text import sql_terms, sql_tokens
from workload.registry import query

INTERCEPT = 0.05


def frozen_model(spark, sf) -> md.LinearModel:
    """A stored model stand-in: fixed weights by term index over the vocabulary of
    the labelled rows, so that SQL can score with the same numbers."""
    vocab = ft.fit_vocabulary(tb.labeled(spark, sf))
    weights = [((i * 7919 + 13) % 2001 - 1000) / 1000.0 for i in range(len(vocab.terms))]
    return md.LinearModel(
        "logistic_regression", weights, INTERCEPT, vocab,
        {"model_type": "logistic_regression", "training_samples": vocab.n_docs},
    )



def scores_sql(rows: str) -> str:
    """Scores ``scores(id, p)`` of the rows (id, text) of a table."""
    return f"""coef AS (SELECT term, idx, idf, ((idx * 7919 + 13) % 2001 - 1000) / 1000.0::DOUBLE AS c FROM vocab),
all_tf AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest({sql_terms('t')}) AS term
    FROM (SELECT id, {sql_tokens('text')} AS t FROM {rows})) GROUP BY id, term),
scores AS (
  SELECT d.id, 1 / (1 + exp(-({INTERCEPT} + coalesce(
           sum(a.tf * c.idf * c.c) / sqrt(sum(a.tf * c.idf * a.tf * c.idf)), 0)))) AS p
  FROM {rows} d LEFT JOIN all_tf a ON a.id = d.id LEFT JOIN coef c ON c.term = a.term
  GROUP BY d.id)"""


SCORES_SQL = scores_sql("(SELECT doc_id AS id, text FROM documents)")
SCORED = feature_sql(ROWS_LABELED, SCORES_SQL)
EVAL_SQL = """SELECT round((tp + tn) / total::DOUBLE, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1_score,
  tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM preds)"""
PREDS = "WITH preds AS (SELECT quality AS label, 1 - toxic AS prediction FROM labels)\n"
RATIOS = ("accuracy", "precision", "recall", "f1_score")


def _preds(spark, sf):
    """Ground truth against a simple guess: non-toxic means relevant."""
    return tb.raw(spark, sf, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction")
    )


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in RATIOS})


def _coefficients(spark, sf):
    return frozen_model(spark, sf).coefficient_table(spark)


@query("M1_train_logistic_regression")
def _(spark, sf):
    ds = prepare_dataset(tb.articles(spark, sf, heavy=True))
    model = md.train(ds.part("train"), "logistic_regression", {"C": 1.0}, ds.vocabulary)
    return md.evaluate(predict_rows(ds.part("test"), model))


@query("M2_train_linear_svc")
def _(spark, sf):
    ds = prepare_dataset(tb.articles(spark, sf, heavy=True))
    model = md.train(ds.part("train"), "linear_svc", {}, ds.vocabulary)
    return md.evaluate(predict_rows(ds.part("test"), model))


# every term of the vocabulary, with the objective's slope at its weight as good as zero
OPTIMAL = feature_sql(ROWS_LABELED) + "SELECT term, TRUE AS optimal FROM vocab"


def _optimal(dataset, model):
    slopes = md.optimality(dataset.part("train"), model)
    return slopes.select("term", (F.abs("gradient") <= 1.001 * md.MODEL_PARAMS["tol"]).alias("optimal"))


@query("M1_optimality", OPTIMAL)
def _(spark, sf):
    ds = prepare_dataset(tb.articles(spark, sf, heavy=True))
    return _optimal(ds, md.train(ds.part("train"), "logistic_regression", {"C": 1.0}, ds.vocabulary))


@query("M2_optimality", OPTIMAL)
def _(spark, sf):
    ds = prepare_dataset(tb.articles(spark, sf, heavy=True))
    return _optimal(ds, md.train(ds.part("train"), "linear_svc", {}, ds.vocabulary))


@query("M18_optimality", OPTIMAL)
def _(spark, sf):
    """As trained end to end, stored and read back."""
    ds = prepare_dataset(tb.articles(spark, sf, heavy=True))
    path = work_path(spark, "model")
    bundles.save_model(spark, train_model(ds), path, tb.NOW)
    return _optimal(ds, bundles.load_model(spark, path))


@query("M4_evaluate", PREDS + EVAL_SQL)
def _(spark, sf):
    return _rounded(md.evaluate(_preds(spark, sf)))


@query(
    "M5_predict_with_score",
    SCORED + "SELECT id, p > 0.5 AS is_relevant, round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, 6) AS confidence FROM scores",
)
def _(spark, sf):
    out = md.predict_with_score(tb.documents(spark, sf), frozen_model(spark, sf))
    return out.select("id", "is_relevant", F.round("confidence", 6).alias("confidence"))


@query("M6_predict_threshold", SCORED + "SELECT id, p >= 0.52 AS is_relevant FROM scores")
def _(spark, sf):
    return md.predict(tb.documents(spark, sf), frozen_model(spark, sf), 0.52).select("id", "is_relevant")


@query(
    "M7_evaluate_texts",
    SCORED
    + f"""SELECT s.id, p > 0.5 AS relevant, round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, 6) AS confidence,
             length(text) AS text_length, length(array_to_string({sql_tokens('text')}, ' ')) AS preprocessed_length,
             'logistic_regression' AS model_type, CAST((SELECT count(*) FROM labeled) AS INTEGER) AS training_samples
          FROM scores s JOIN documents d ON d.doc_id = s.id""",
)
def _(spark, sf):
    out = md.evaluate_texts(tb.documents(spark, sf), frozen_model(spark, sf))
    return out.select(
        "id", "relevant", F.round("confidence", 6).alias("confidence"),
        F.col("text_length").cast("bigint").alias("text_length"),
        F.col("preprocessed_length").cast("bigint").alias("preprocessed_length"),
        "model_type", "training_samples",
    )


M8_SQL = (
    tb.with_tables("articles", "labeled", extra=",\n".join([ROWS_LABELED, feature_sql(ROWS_LABELED, SCORES_SQL).split(ROWS_LABELED + ",\n")[1].rstrip()]))
    + """SELECT a.id, url, title, p > 0.5 AS is_relevant,
                round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, 6) AS confidence
         FROM articles a
         JOIN scores s ON s.id = a.id WHERE a.content <> ''"""
)


@query("M8_classify_articles", M8_SQL)
def _(spark, sf):
    out = md.classify_articles(tb.articles(spark, sf), frozen_model(spark, sf))
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "M8_classify_newest",
    M8_SQL.replace("articles a", "(SELECT * FROM articles ORDER BY date_extracted DESC, id LIMIT 100) a"),
)
def _(spark, sf):
    out = md.classify_articles(tb.articles(spark, sf), frozen_model(spark, sf), 100)
    return out.withColumn("confidence", F.round("confidence", 6))


LINES_SQL = r"""lines AS (SELECT row_number() OVER () AS id, line AS text FROM (
  SELECT regexp_replace(unnest(string_split_regex(text, '\r\n|\n|\r')), '^\s+|\s+$', '', 'g') AS line FROM documents)
  WHERE line <> '')"""


@query(
    "M9_classify_lines",
    feature_sql(ROWS_LABELED, LINES_SQL, scores_sql("lines")) + """SELECT text, p > 0.5 AS is_relevant,
         round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, 6) AS confidence FROM scores JOIN lines USING (id)""",
)
def _(spark, sf):
    from siftline.sources.readers import read_text_lines

    path = work_path(spark, "lines")
    tb.raw(spark, sf, "documents").select(F.col("text").alias("value")).write.text(path)
    return md.classify_lines(read_text_lines(spark, path), frozen_model(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(
    "M10_classification_summary",
    SCORED + "SELECT count(*) AS total, count(*) FILTER (WHERE p > 0.5) AS relevant, count(*) FILTER (WHERE NOT p > 0.5) AS not_relevant FROM scores",
)
def _(spark, sf):
    return md.classification_summary(md.predict_with_score(tb.documents(spark, sf), frozen_model(spark, sf)))


@query(
    "M11_classify_by_key",
    SCORED
    + """SELECT id, p > 0.5 AS relevant, round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, 6) AS confidence
         FROM scores WHERE id = (SELECT max(doc_id) FROM documents WHERE lang = 'en')""",
)
def _(spark, sf):
    key = tb.raw(spark, sf, "documents").filter("lang = 'en'").agg(F.max("doc_id").alias("id"))
    out = md.classify_by_key(tb.articles(spark, sf), key, frozen_model(spark, sf))
    return out.select("id", "relevant", F.round("confidence", 6).alias("confidence"))


@query(
    "M13_feature_importance",
    SCORED + "SELECT term, round(abs(c), 6) AS importance FROM coef ORDER BY abs(c) DESC, term LIMIT 20",
)
def _(spark, sf):
    return md.feature_importance(_coefficients(spark, sf)).withColumn("importance", F.round("importance", 6))


@query(
    "M14_dataset_statistics",
    """SELECT count(*) AS total_samples, count(*) FILTER (WHERE quality = 1) AS positive_samples, count(*) FILTER (WHERE quality = 0) AS negative_samples,
              round(count(*) FILTER (WHERE quality = 1) * 100.0 / count(*), 6)::DOUBLE AS positive_percentage,
              round(count(*) FILTER (WHERE quality = 0) * 100.0 / count(*), 6)::DOUBLE AS negative_percentage FROM labels""",
)
def _(spark, sf):
    out = md.dataset_statistics(tb.raw(spark, sf, "labels"), "quality")
    return out.withColumns({c: F.round(c, 6) for c in ("positive_percentage", "negative_percentage")})


@query(
    "M15_label_distribution",
    """SELECT quality AS label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 6) AS share
       FROM labels GROUP BY quality""",
)
def _(spark, sf):
    return md.label_distribution(tb.raw(spark, sf, "labels"), "quality").withColumn("share", F.round("share", 6))


@query(
    "M16_confusion_matrix",
    PREDS
    + """SELECT g.label, g.prediction, count(p.label) AS n
         FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(label, prediction)
         LEFT JOIN preds p ON p.label = g.label AND p.prediction = g.prediction GROUP BY g.label, g.prediction""",
)
def _(spark, sf):
    return md.confusion_matrix(_preds(spark, sf))


# every report table in one long form
@query(
    "M17_model_report",
    feature_sql(ROWS_LABELED, SCORES_SQL, "preds AS (SELECT quality AS label, 1 - toxic AS prediction FROM labels)",
                f"m AS ({EVAL_SQL})")
    + """SELECT 'metrics' AS part, name, round(value, 6) AS value FROM (
           SELECT 'accuracy' AS name, accuracy AS value FROM m UNION ALL SELECT 'precision', precision FROM m
           UNION ALL SELECT 'recall', recall FROM m UNION ALL SELECT 'f1_score', f1_score FROM m)
         UNION ALL SELECT 'statistics', 'positive_samples', count(*) FILTER (WHERE label = 1)::DOUBLE FROM preds
         UNION ALL SELECT 'label_distribution', label::VARCHAR, count(*)::DOUBLE FROM preds GROUP BY label
         UNION ALL SELECT 'confusion_matrix', '1/1', true_positives::DOUBLE FROM m
         UNION ALL SELECT 'feature_importance', term, round(abs(c), 6) FROM (SELECT term, c FROM coef ORDER BY abs(c) DESC, term LIMIT 20)""",
)
def _(spark, sf):
    preds = _preds(spark, sf)
    r = md.model_report(preds, preds, _coefficients(spark, sf))

    def part(name, df, key, value):
        return df.select(
            F.lit(name).alias("part"), key.alias("name"), F.round(value.cast("double"), 6).alias("value")
        )

    c = F.col
    return (
        part("metrics", r["metrics"], c("metric"), c("value"))
        .unionByName(part("statistics", r["statistics"], F.lit("positive_samples"), c("positive_samples")))
        .unionByName(part("label_distribution", r["label_distribution"], c("label").cast("string"), c("n")))
        .unionByName(part(
            "confusion_matrix", r["confusion_matrix"].filter("label = 1 and prediction = 1"), F.lit("1/1"), c("n")))
        .unionByName(part("feature_importance", r["feature_importance"], c("term"), c("importance")))
    )


@query("M18_train_model")
def _(spark, sf):
    model = train_model(prepare_dataset(tb.articles(spark, sf, heavy=True)))
    path = work_path(spark, "model")
    bundles.save_model(spark, model, path, tb.NOW)
    loaded = bundles.load_model(spark, path)
    return md.predict_with_score(tb.documents(spark, sf), loaded).select("id", "is_relevant", "confidence")


@query(
    "W23_dataset_bundle",
    tb.with_tables("labeled", extra=SPLIT_SQL) + "SELECT split, label, count(*) AS n FROM split GROUP BY split, label",
)
def _(spark, sf):
    path = work_path(spark, "dataset")
    bundles.save_dataset(prepare_dataset(tb.articles(spark, sf, heavy=True)), path, tb.NOW)
    dataset, _ = bundles.load_dataset(spark, path)
    return dataset.rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("W24_vectorizer_bundle", feature_sql(ROWS_LABELED) + "SELECT term, idx, count, df, round(idf, 6) AS idf FROM vocab")
def _(spark, sf):
    path = work_path(spark, "vectorizer")
    bundles.save_vectorizer(spark, ft.fit_vocabulary(tb.labeled(spark, sf)), path)
    return bundles.load_vectorizer(spark, path).to_df(spark).withColumn("idf", F.round("idf", 6))


@query("W25_model_bundle", SCORED + "SELECT idx, term, round(c, 6) AS coefficient FROM coef")
def _(spark, sf):
    path = work_path(spark, "model")
    bundles.save_model(spark, frozen_model(spark, sf), path, tb.NOW)
    table = bundles.load_model(spark, path).coefficient_table(spark)
    return table.withColumn("coefficient", F.round("coefficient", 6))

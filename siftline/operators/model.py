"""Training, scoring and evaluation of the relevance classifier."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import linear_fit
from siftline.operators.articles import get_articles, search_articles
from siftline.operators.features import Vocabulary, vector_entries, vectorize
from siftline.session import cut_lineage

MODEL_TYPES = ("logistic_regression", "linear_svc")
# accepted parameters with their defaults
MODEL_PARAMS = {
    "C": 1.0, "max_iter": 200, "tol": 1e-4, "fit_intercept": True, "class_weight": None, "penalty": "l2",
    "intercept_scaling": 1.0,
}


@dataclass
class LinearModel:
    """A trained linear classifier over a vocabulary (one weight per term)."""

    model_type: str
    coefficients: list[float]
    intercept: float
    vocabulary: Vocabulary | None = None
    metadata: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)

    @property
    def has_probability(self) -> bool:
        return self.model_type == "logistic_regression"

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        terms = self.vocabulary.terms if self.vocabulary else [None] * len(self.coefficients)
        rows = [(i, t, float(c)) for i, (t, c) in enumerate(zip(terms, self.coefficients))]
        return spark.createDataFrame(rows, "idx int, term string, coefficient double")


def train(
    df: DataFrame, model_type: str = "logistic_regression", params: dict | None = None,
    vocabulary: Vocabulary | None = None, features: str = "features", label: str = "label",
    start: LinearModel | None = None,
) -> LinearModel:
    """M1, M2: fit on rows with a vector and a 0/1 label.

    Logistic regression has an L2 penalty on the weights, or none (``penalty`` None), and
    a free intercept; the SVC has squared hinge loss and a penalised intercept, which
    ``intercept_scaling`` frees.  ``start`` is a model over the same terms whose weights
    the search begins with.  The training vectors are
    written to the shared folder once because every pass reads them again.
    """
    if model_type not in MODEL_TYPES:
        raise ValueError(f"Unsupported model type: {model_type}; choose from {MODEL_TYPES}")
    params = dict(params or {})
    unknown = set(params) - set(MODEL_PARAMS)
    if unknown:
        raise ValueError(f"Unsupported model parameters: {sorted(unknown)}")
    settings = {**MODEL_PARAMS, **params}
    svc = model_type == "linear_svc"
    if settings["penalty"] not in ("l2", None) or (svc and settings["penalty"] is None):
        raise ValueError(f"Unsupported penalty of {model_type}: {settings['penalty']}")
    if not settings["intercept_scaling"] > 0:
        raise ValueError("intercept_scaling must be above 0")
    started = time.time()
    data = cut_lineage(
        df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"))
    )
    counts = {int(r[0]): r[1] for r in data.groupBy("label").agg(F.count(F.lit(1))).collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        raise ValueError("training needs both classes")
    class_weight = settings["class_weight"] or {}
    if class_weight == "balanced":
        class_weight = {c: n / (len(counts) * k) for c, k in counts.items()}
    weight = F.lit(1.0)
    for c, w in class_weight.items():
        weight = F.when(F.col("label") == float(c), F.lit(float(w))).otherwise(weight)
    vector = F.unwrap_udt(F.col("features"))
    # dense vectors carry no size of their own
    width = F.coalesce(vector["size"], F.size(vector["values"]))
    n_features = len(vocabulary.terms) if vocabulary else data.select(width).first()[0]
    if start is not None and len(start.coefficients) != n_features:
        raise ValueError(f"start has {len(start.coefficients)} weights, the vectors {n_features}")
    coefficients, intercept, steps, slope = linear_fit.fit(
        data.withColumn("weight", weight), n_features,
        linear_fit.squared_hinge if svc else linear_fit.logistic,
        float(settings["C"]), settings["fit_intercept"], svc, settings["max_iter"], settings["tol"],
        penalize=settings["penalty"] is not None,
        # a free intercept needs no scaling
        constant=float(settings["intercept_scaling"]) if svc else 1.0,
        start=None if start is None else [*start.coefficients, start.intercept],
    )
    ended = time.time()
    converged = slope <= settings["tol"]
    if not converged:
        warnings.warn(f"{model_type}: gradient {slope:.2g} after {steps} steps, wanted {settings['tol']:.2g}", stacklevel=2)
    stamp = "%Y-%m-%dT%H:%M:%S"
    return LinearModel(
        model_type,
        coefficients.tolist(),
        intercept,
        vocabulary,
        metadata={
            "model_type": model_type,
            "model_params": params,
            "training_samples": n,
            "feature_count": n_features,
            "iterations": steps,
            "converged": converged,
            "gradient": slope,
            "training_start": time.strftime(stamp, time.gmtime(started)),
            "training_end": time.strftime(stamp, time.gmtime(ended)),
            "training_duration_seconds": ended - started,
            "class_distribution": {"0": counts.get(0, 0), "1": counts.get(1, 0)},
        },
    )


def optimality(
    df: DataFrame, model: LinearModel, key: str = "id", features: str = "features", label: str = "label",
) -> DataFrame:
    """(idx, term, coefficient, gradient): the training objective's slope at the weights.

    Made from the vectors' entries by grouping on the index, apart from the fit's own sums;
    at a fitted model every entry is within the fit's tolerance.  The intercept has no row.
    """
    settings = {**MODEL_PARAMS, **model.metadata.get("model_params", {})}
    if settings["class_weight"]:
        raise ValueError("optimality covers models without class weights")
    side = F.when(F.col(label) == 1, -1.0).otherwise(1.0)
    folded = side * F.col("margin")
    slope = 2.0 * F.greatest(1.0 + folded, F.lit(0.0)) if model.model_type == "linear_svc" else _sigmoid(folded)
    scored = with_margin(df, model, features).select(key, features, (side * slope).alias("slope"))
    rows = vector_entries(scored, key, features, carry=("slope",))
    pulls = rows.groupBy("idx").agg(F.sum(F.col("value") * F.col("slope")).alias("pull"))
    n = df.select(F.count(F.lit(1))).scalar()
    weights = model.coefficient_table(df.sparkSession)
    pull = F.coalesce("pull", F.lit(0.0))
    held_back = 1.0 if settings["penalty"] else 0.0
    return weights.join(pulls, "idx", "left").select(
        "idx", "term", "coefficient", ((settings["C"] * pull + held_back * F.col("coefficient")) / (settings["C"] * n)).alias("gradient")
    )


def with_margin(df: DataFrame, model: LinearModel, features: str = "features", out: str = "margin") -> DataFrame:
    """Decision value of vectors under the model."""
    dot = linear_fit.add_margin(df, model.coefficients, features, out)
    return dot.withColumn(out, F.col(out) + model.intercept)


def _sigmoid(margin):
    return 1.0 / (1.0 + F.exp(-margin))


def score(df: DataFrame, model: LinearModel, text_col: str = "content") -> DataFrame:
    """Vectorise and add the margin; every input column is kept."""
    if model.vocabulary is None:
        raise ValueError("No feature extractor loaded")
    return with_margin(vectorize(df, model.vocabulary, None, text_col, "_features"), model, "_features").drop("_features")


def predict_with_score(df: DataFrame, model: LinearModel, text_col: str = "content") -> DataFrame:
    """M5: ``is_relevant`` and the confidence of the predicted class."""
    scored = score(df, model, text_col).withColumn("is_relevant", F.col("margin") > 0)
    if model.has_probability:
        p = _sigmoid(F.col("margin"))
        confidence = F.when(F.col("is_relevant"), p).otherwise(1.0 - p)
    else:
        confidence = F.lit(1.0)
    return scored.withColumn("confidence", confidence).drop("margin")


def predict(df: DataFrame, model: LinearModel, threshold: float = 0.5, text_col: str = "content") -> DataFrame:
    """M6: probability at or above the threshold (ignored without probabilities)."""
    scored = score(df, model, text_col)
    hit = (
        _sigmoid(F.col("margin")) >= threshold if model.has_probability else F.col("margin") > 0
    )
    return scored.withColumn("is_relevant", hit).drop("margin")


def evaluate_texts(df: DataFrame, model: LinearModel, text_col: str = "content") -> DataFrame:
    """M7: prediction with text lengths and model facts."""
    flags = model.vocabulary.settings.text_flags
    out = predict_with_score(df, model, text_col).withColumnRenamed("is_relevant", "relevant")
    return out.withColumns({
        "text_length": F.length(text_col),
        "preprocessed_length": F.length(tx.preprocess(F.col(text_col), **flags)),
        "model_type": F.lit(model.metadata.get("model_type", "unknown")),
        "training_samples": F.lit(int(model.metadata.get("training_samples", 0))),
    })


def classify_articles(articles: DataFrame, model: LinearModel, limit: int | None = None) -> DataFrame:
    """M8: all stored articles, or the ``limit`` newest; those without content are
    skipped after the limit."""
    newest = search_articles(articles, limit=limit).filter(F.coalesce("content", F.lit("")) != "")
    return predict_with_score(newest, model).select("id", "url", "title", "is_relevant", "confidence")


def classify_by_key(articles: DataFrame, keys: DataFrame, model: LinearModel, key: str = "id") -> DataFrame:
    """Detailed prediction of stored articles looked up by id or url."""
    return evaluate_texts(get_articles(articles, keys, key), model)


def classify_lines(texts: DataFrame, model: LinearModel, text_col: str = "text") -> DataFrame:
    """M9: every text line with its prediction."""
    return predict_with_score(texts, model, text_col).select(text_col, "is_relevant", "confidence")


def classification_summary(predictions: DataFrame) -> DataFrame:
    """M10."""
    return predictions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_relevant").alias("relevant"),
        F.count_if(~F.col("is_relevant")).alias("not_relevant"),
    )


def evaluate(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M4: one row of metrics for positive class 1; empty ratios are 0."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    counts = predictions.agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
    )
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")
    )

    def ratio(num, den):
        return F.when(den == 0, F.lit(0.0)).otherwise(num / den)

    return counts.select(
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        "true_negatives", "false_positives", "false_negatives", "true_positives",
    )


def feature_importance(coefficients: DataFrame, n: int = 20) -> DataFrame:
    """The n largest absolute weights with their terms."""
    return (
        coefficients.select("term", F.abs("coefficient").alias("importance"))
        .orderBy(F.desc("importance"), "term")
        .limit(n)
    )


def dataset_statistics(labels: DataFrame, label: str = "label") -> DataFrame:
    """Counts and percentages of the two classes."""
    y = F.col(label)
    stats = labels.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(y == 1).alias("positive_samples"),
        F.count_if(y == 0).alias("negative_samples"),
    )
    return stats.select(
        "*",
        F.try_divide(F.col("positive_samples") * 100.0, "total_samples").alias("positive_percentage"),
        F.try_divide(F.col("negative_samples") * 100.0, "total_samples").alias("negative_percentage"),
    )


def label_distribution(labels: DataFrame, label: str = "label") -> DataFrame:
    """Count and share per label (the window sees one row per label)."""
    counts = labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def confusion_matrix(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The full 2x2 grid as rows, zero cells included."""
    cells = evaluate(predictions, label, prediction)
    return cells.select(
        F.expr(
            "stack(4, 0, 0, true_negatives, 0, 1, false_positives, "
            "1, 0, false_negatives, 1, 1, true_positives) as (label, prediction, n)"
        )
    )


def model_report(
    labels: DataFrame, predictions: DataFrame, coefficients: DataFrame, n_features: int = 20
) -> dict[str, DataFrame]:
    """The tables behind the model report."""
    metrics = evaluate(predictions)
    return {
        "metrics": metrics.select(
            F.expr(
                "stack(4, 'accuracy', accuracy, 'precision', precision, "
                "'recall', recall, 'f1_score', f1_score) as (metric, value)"
            )
        ),
        "statistics": dataset_statistics(labels),
        "label_distribution": label_distribution(labels),
        "confusion_matrix": confusion_matrix(predictions),
        "feature_importance": feature_importance(coefficients, n_features),
    }

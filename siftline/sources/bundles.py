"""Persistent datasets, vocabularies and models.

Everything is a Parquet table plus a one-row JSON table, so nothing depends on a
language-specific object format.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from siftline.operators.features import FeatureSettings, Vocabulary
from siftline.operators.model import LinearModel
from siftline.plans.dataset import Dataset


def _write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_vectorizer(spark: SparkSession, vocab: Vocabulary, path: str) -> None:
    """W24."""
    vocab.to_df(spark).write.mode("overwrite").parquet(f"{path}/terms")
    s = vocab.settings
    _write_json(
        spark,
        {"n_docs": vocab.n_docs, "max_features": s.max_features, "ngram_range": list(s.ngram_range),
         "use_tfidf": s.use_tfidf, "text_flags": s.text_flags},
        f"{path}/settings",
    )


def load_vectorizer(spark: SparkSession, path: str) -> Vocabulary:
    """W24."""
    s = _read_json(spark, f"{path}/settings")
    settings = FeatureSettings(s["max_features"], tuple(s["ngram_range"]), s["use_tfidf"], s["text_flags"])
    rows = spark.read.parquet(f"{path}/terms").collect()
    return Vocabulary.from_rows(rows, s["n_docs"], settings)


def save_dataset(dataset: Dataset, path: str, created_at: str) -> None:
    """Sparse rows, vocabulary and metadata."""
    spark = dataset.rows.sparkSession
    dataset.rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    save_vectorizer(spark, dataset.vocabulary, f"{path}/vectorizer")
    stored = Dataset(spark.read.parquet(f"{path}/rows"), dataset.vocabulary)
    parts = {r["split"]: r for r in stored.metadata().collect()}
    n_features = len(dataset.vocabulary.terms)

    def size(split):
        return parts[split]["n_rows"] if split in parts else 0

    _write_json(
        spark,
        {
            "created_at": created_at,
            "test_size": dataset.test_size,
            "random_state": dataset.seed,
            "X_train_shape": [size("train"), n_features],
            "X_test_shape": [size("test"), n_features],
            "y_train_shape": [size("train")],
            "y_test_shape": [size("test")],
            "n_features": n_features,
            "class_distribution": {
                s: {"0": r["class_0"], "1": r["class_1"]} for s, r in parts.items()
            },
        },
        f"{path}/metadata",
    )


def load_dataset(spark: SparkSession, path: str) -> tuple[Dataset, dict]:
    """The dataset and its metadata."""
    meta = _read_json(spark, f"{path}/metadata")
    rows = spark.read.parquet(f"{path}/rows").select("id", "label", "split", "features")
    vocab = load_vectorizer(spark, f"{path}/vectorizer")
    return Dataset(rows, vocab, meta["test_size"], meta["random_state"]), meta


def save_model(spark: SparkSession, model: LinearModel, path: str, saved_at: str) -> None:
    """Weights, vocabulary, metadata and metrics."""
    model.coefficient_table(spark).write.mode("overwrite").parquet(f"{path}/coefficients")
    if model.vocabulary is not None:
        save_vectorizer(spark, model.vocabulary, f"{path}/vectorizer")
    _write_json(
        spark,
        {**model.metadata, "model_type": model.model_type, "intercept": model.intercept,
         "has_vectorizer": model.vocabulary is not None, "saved_at": saved_at},
        f"{path}/metadata",
    )
    _write_json(spark, model.metrics, f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> LinearModel:
    """W25."""
    meta = _read_json(spark, f"{path}/metadata")
    rows = spark.read.parquet(f"{path}/coefficients").orderBy("idx").collect()
    vocab = load_vectorizer(spark, f"{path}/vectorizer") if meta["has_vectorizer"] else None
    return LinearModel(
        meta["model_type"], [r["coefficient"] for r in rows], meta["intercept"], vocab, meta,
        _read_json(spark, f"{path}/metrics"),
    )



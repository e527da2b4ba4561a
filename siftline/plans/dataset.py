"""Dataset preparation (F8) and end-to-end training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.labels import is_labeled, resolve_label
from siftline.functions.text import clean_tokens
from siftline.operators.features import (
    FeatureSettings, Vocabulary, class_counts, dataset_metadata, fit_vocabulary, stratified_split,
    vectorize,
)
from siftline.operators.model import LinearModel, evaluate, train, with_margin
from siftline.session import cut_lineage


@dataclass(frozen=True)
class Dataset:
    """Rows (id, label, split, features) with the vocabulary they were made under."""

    rows: DataFrame
    vocabulary: Vocabulary
    test_size: float = 0.2
    seed: int = 42

    def part(self, split: str) -> DataFrame:
        return self.rows.filter(F.col("split") == split)

    def metadata(self) -> DataFrame:
        return dataset_metadata(self.rows, len(self.vocabulary.terms))


def prepare_dataset(
    articles: DataFrame, settings: FeatureSettings = FeatureSettings(), test_size: float = 0.2,
    seed: int = 42, fit_on: str = "all",
) -> Dataset:
    """F8: load labelled articles, fit features, split.

    The vocabulary is fitted on all rows, test rows included; ``fit_on='train'``
    keeps the test rows out of it.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    # the text is cleaned once; vocabulary and vectors are both made from the stored words
    words = clean_tokens(F.col("content"), **settings.text_flags)
    labeled = cut_lineage(
        resolve_label(articles.filter(is_labeled(F.col("labels")))).select("id", "label", words.alias("words")),
        "labeled",
    )
    counts = class_counts(labeled)
    split = stratified_split(labeled, "label", "id", test_size, seed, counts)
    if fit_on == "all":
        vocabulary = fit_vocabulary(split, settings, text_col="words", n_docs=sum(counts.values()))
    else:
        vocabulary = fit_vocabulary(split.filter(F.col("split") == "train"), settings, text_col="words")
    rows = vectorize(split, vocabulary, text_col="words").select("id", "label", "split", "features")
    return Dataset(rows, vocabulary, test_size, seed)


def predict_rows(rows: DataFrame, model: LinearModel) -> DataFrame:
    """Class predictions for vectors that are already built."""
    return with_margin(rows, model).withColumn("prediction", (F.col("margin") > 0).cast("int"))


def train_model(
    dataset: Dataset, model_type: str = "logistic_regression", params: dict | None = None
) -> LinearModel:
    """Train on the train part, evaluate on the test part."""
    model = train(dataset.part("train"), model_type, params, dataset.vocabulary)
    model.metrics = evaluate(predict_rows(dataset.part("test"), model)).first().asDict()
    return model



"""Vocabulary, count and TF-IDF features, stratified split."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from siftline.functions import text as tx
from siftline.operators.ranking import dense_ids, hash_cuts
from siftline.session import cut_lineage

VOCABULARY_SCHEMA = "term string, idx int, count bigint, df bigint, idf double"


#: Largest vocabulary that is broadcast: about 100 MB of terms and numbers.
MOST_FEATURES = 1_000_000


@dataclass(frozen=True)
class FeatureSettings:
    max_features: int = 10_000
    ngram_range: tuple[int, int] = (1, 2)
    use_tfidf: bool = True
    text_flags: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= self.max_features <= MOST_FEATURES:
            raise ValueError(f"max_features must be 1 to {MOST_FEATURES}: it bounds what is broadcast")


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vectoriser: at most ``max_features`` terms, in index order."""

    terms: list[str]
    counts: list[int]
    dfs: list[int]
    idfs: list[float]
    n_docs: int
    settings: FeatureSettings = FeatureSettings()

    @staticmethod
    def from_rows(rows, n_docs: int, settings: FeatureSettings) -> "Vocabulary":
        rows = sorted(rows, key=lambda r: r["idx"])
        return Vocabulary(
            [r["term"] for r in rows],
            [r["count"] for r in rows],
            [r["df"] for r in rows],
            [r["idf"] for r in rows],
            n_docs,
            settings,
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.terms, range(len(self.terms)), self.counts, self.dfs, self.idfs))
        return spark.createDataFrame(rows, VOCABULARY_SCHEMA)


def with_terms(
    df: DataFrame, settings: FeatureSettings = FeatureSettings(), text_col: str = "content",
    out: str = "terms",
) -> DataFrame:
    """Add the n-gram array of the cleaned text; an array column holds cleaned words already."""
    cleaned = isinstance(df.schema[text_col].dataType, ArrayType)
    tokens = F.col(text_col) if cleaned else tx.clean_tokens(F.col(text_col), **settings.text_flags)
    return (
        df.withColumn("_tokens", tokens)
        .withColumn(out, tx.ngrams(F.col("_tokens"), settings.ngram_range))
        .drop("_tokens")
    )


def term_occurrences(
    df: DataFrame, settings: FeatureSettings = FeatureSettings(), key: str = "id",
    text_col: str = "content",
) -> DataFrame:
    """(key, term, last): every term occurrence, ``last`` = 1 once per document.

    The terms of a document are sorted inside its row, so the last of a run of
    equal terms is seen by looking at the next one; document frequencies then need
    no grouping by document.
    """
    terms = F.col("terms")
    marked = F.zip_with(
        terms,
        F.slice(terms, 2, F.size(terms)),
        lambda term, nxt: F.struct(
            term.alias("term"), F.when(term.eqNullSafe(nxt), 0).otherwise(1).alias("last")
        ),
    )
    return (
        with_terms(df.select(key, text_col), settings, text_col)
        .select(key, F.sort_array("terms").alias("terms"))
        .select(key, F.inline(marked))
    )


def idf_column(n_docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((n_docs + 1) / (df + 1)) + 1.0


def _cut_of(totals: DataFrame, most: int):
    """The least count that still fits among the ``most`` largest, with the number of terms
    at it and above it; None without terms.  Found in a histogram, one row per count."""
    above = F.sum("terms").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1))
    histogram = totals.groupBy("count").agg(F.count(F.lit(1)).alias("terms")).withColumn("above", F.coalesce(above, F.lit(0)))
    return histogram.filter(F.col("above") < most).orderBy("count").first()


def most_frequent(totals: DataFrame, most: int) -> DataFrame:
    """The ``most`` terms of largest count, ties by term.

    A histogram of the counts, one row per different count, finds the least count that
    still fits.  Terms above it are taken as they are; only those at it are ordered, by
    ranges of the term, so no task ever holds the best terms of all the others.
    """
    cut = _cut_of(totals, most)
    if cut is None or cut["above"] + cut["terms"] <= most:
        return totals if cut is None else totals.filter(F.col("count") >= cut["count"])
    at_cut = dense_ids(totals.filter(F.col("count") == cut["count"]), "count", id_col="_rank", ties=["term"])
    tied = at_cut.filter(F.col("_rank") <= most - cut["above"]).drop("_rank")
    return totals.filter(F.col("count") > cut["count"]).unionByName(tied)


#: Words whose n-grams are counted together inside a task.
SLICE_WORDS = 1_000_000


def _row_slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_WORDS words."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        seen = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, seen + SLICE_WORDS, side="right")))
        yield start, end
        start = end


def _gram_counter(words: list[str], high: int):
    """Arrow batches of word lists -> (code, count, df) of their n-grams of known words.

    A word's digit is its place in ``words`` plus one; an n-gram's code reads its digits in
    base ``len(words) + 1``.
    """
    known, base = pa.array(words, pa.string()), len(words) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for start, end in _row_slices(sizes):
                values = batch.column(0).slice(start, end - start).flatten()
                digits = pc.fill_null(pc.index_in(values, value_set=known.cast(values.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                row = np.repeat(np.arange(end - start), sizes[start:end])
                codes, rows = [], []
                for n in range(1, high + 1):
                    m = max(len(digits) - n + 1, 0)
                    code, whole = np.zeros(m, np.int64), row[:m] == row[n - 1:]
                    for k in range(n):
                        code = code * base + digits[k:k + m]
                        whole &= digits[k:k + m] > 0
                    codes.append(code[whole])
                    rows.append(row[:m][whole])
                different, place, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
                # one pair per n-gram and row
                pairs = np.unique(place.astype(np.int64) * (end - start) + np.concatenate(rows))
                in_rows = np.bincount(pairs // (end - start), minlength=len(different)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(different), pa.array(times.astype(np.int64)), pa.array(in_rows)], ["code", "count", "df"])

    return count


def term_totals(
    df: DataFrame, settings: FeatureSettings = FeatureSettings(), key: str = "id", text_col: str = "content",
) -> DataFrame:
    """(term, count, df): every term that can be among the ``max_features`` most frequent.

    An n-gram is at most as frequent as each of its words, and the words alone fill the
    vocabulary down to a count found first; n-grams with a rarer word cannot reach it.  So
    the words above it are numbered, and n-grams are counted as numbers.  Where single
    words are no terms or the numbers would be too many, all terms are counted as text.
    """
    low, high = settings.ngram_range
    if isinstance(df.schema[text_col].dataType, ArrayType):
        words = df.select(F.col(text_col).alias("words"))
    else:
        words = cut_lineage(df.select(tx.clean_tokens(F.col(text_col), **settings.text_flags).alias("words")), "words")
    if low == 1:
        counts = cut_lineage(
            words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count")), "counts"
        )
        cut = _cut_of(counts, settings.max_features)
        n_kept = cut["above"] + cut["terms"] if cut else 0
        if n_kept <= MOST_FEATURES and (n_kept + 1) ** high < 1 << 63:
            least = cut["count"] if cut else 1
            return _numbered_totals(words, counts.filter(F.col("count") >= least), least, high)
    occurrences = term_occurrences(words.withColumn(key, F.lit(None)), settings, key, "words")
    return occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.sum("last").alias("df"))


def _numbered_totals(words: DataFrame, frequent: DataFrame, least: int, high: int) -> DataFrame:
    names = sorted(r["word"] for r in frequent.select("word").collect())
    counted = words.mapInArrow(_gram_counter(names, high), "code bigint, count bigint, df bigint")
    totals = counted.groupBy("code").agg(F.sum("count").alias("count"), F.sum("df").alias("df")).filter(F.col("count") >= least)
    table = words.sparkSession.createDataFrame([(i, w) for i, w in enumerate(names, 1)], "digit bigint, word string")
    base = len(names) + 1
    for k in range(high):
        digit = F.expr(f"code div {base ** k}L % {base}L")
        totals = totals.withColumn("digit", digit).join(table.withColumnRenamed("word", f"word{k}"), "digit", "left").drop("digit")
    # an n-gram shorter than the longest has no word at the front
    term = F.concat_ws(" ", *(f"word{k}" for k in reversed(range(high))))
    return totals.select(term.alias("term"), "count", "df")


def vocabulary_table(
    df: DataFrame, settings: FeatureSettings = FeatureSettings(), key: str = "id",
    text_col: str = "content", n_docs: int | None = None,
) -> DataFrame:
    """the most frequent terms, indexed alphabetically.

    The totals are stored.  The index window runs over at most ``max_features`` rows.
    """
    totals = cut_lineage(term_totals(df, settings, key, text_col), "totals")
    top = most_frequent(totals, settings.max_features)
    docs = df.select(F.count(F.lit(1))).scalar() if n_docs is None else F.lit(n_docs)
    return top.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
        "count",
        "df",
        idf_column(docs, F.col("df")).alias("idf"),
    )


def fit_vocabulary(
    df: DataFrame, settings: FeatureSettings = FeatureSettings(), key: str = "id",
    text_col: str = "content", n_docs: int | None = None,
) -> Vocabulary:
    """F1, fitted: brings back at most ``max_features`` rows."""
    n_docs = df.count() if n_docs is None else n_docs
    rows = vocabulary_table(df, settings, key, text_col, n_docs).collect()
    return Vocabulary.from_rows(rows, n_docs, settings)


def vectorize(
    df: DataFrame, vocab: Vocabulary, use_tfidf: bool | None = None,
    text_col: str = "content", out: str = "features",
) -> DataFrame:
    """sparse vectors under a frozen vocabulary, row by row, no shuffle.

    Unknown terms are ignored; text without known terms gives the zero vector.
    """
    tfidf = vocab.settings.use_tfidf if use_tfidf is None else use_tfidf
    counted = CountVectorizerModel.from_vocabulary(
        vocab.terms, inputCol="_terms", outputCol="_tf" if tfidf else out
    ).transform(with_terms(df, vocab.settings, text_col, "_terms"))
    if not tfidf:
        return counted.drop("_terms")
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense(vocab.idfs), inputCol="_tf", outputCol="_w"
    ).transform(counted)
    return (
        Normalizer(p=2.0, inputCol="_w", outputCol=out)
        .transform(weighted)
        .drop("_terms", "_tf", "_w")
    )


def vector_entries(df: DataFrame, key: str = "id", vector: str = "features", carry: tuple[str, ...] = ()) -> DataFrame:
    """Vectors as (key, idx, value) rows, with the ``carry`` columns."""
    raw = F.unwrap_udt(F.col(vector))
    # a dense vector has no indices: its values stand in order
    places = F.expr("coalesce(v.indices, if(size(v.values) = 0, array(), sequence(0, size(v.values) - 1)))")
    return (
        df.select(key, *carry, raw.alias("v"))
        .select(key, *carry, F.explode_outer(F.arrays_zip(places.alias("indices"), F.col("v.values").alias("values"))).alias("e"))
        .filter(F.col("e").isNotNull())
        .select(key, *carry, F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))
    )


def count_features(df: DataFrame, vocab: Vocabulary, key: str = "id", text_col: str = "content") -> DataFrame:
    """(key, idx, tf)."""
    vectors = vectorize(df.select(key, text_col), vocab, False, text_col)
    return vector_entries(vectors, key).withColumn("value", F.col("value").cast("bigint")) \
        .withColumnRenamed("value", "tf")


def tfidf_features(df: DataFrame, vocab: Vocabulary, key: str = "id", text_col: str = "content") -> DataFrame:
    """(key, idx, weight), L2-normalised per document."""
    vectors = vectorize(df.select(key, text_col), vocab, True, text_col)
    return vector_entries(vectors, key).withColumnRenamed("value", "weight")


def transform_features(df: DataFrame, vocab: Vocabulary, key: str = "id", text_col: str = "content") -> DataFrame:
    """one row per document with its number of known terms and norm."""
    vectors = vectorize(df.select(key, text_col), vocab, None, text_col)
    values = F.unwrap_udt(F.col("features"))["values"]
    squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)
    return vectors.select(
        key, "features", F.size(values).alias("n_terms"), F.sqrt(squares).alias("norm")
    )


def feature_names(vocab: DataFrame) -> DataFrame:
    """terms by index."""
    return vocab.orderBy("idx").select("idx", "term")


def split_sizes(counts: dict[int, int], test_size: float = 0.2) -> dict[int, int]:
    """Test rows per class: ``ceil(test_size * n)`` in all, largest remainders first."""
    if not counts:
        raise ValueError("no labelled rows to split")
    total = sum(counts.values())
    n_test = math.ceil(test_size * total)
    if min(counts.values()) < 2:
        raise ValueError("every class needs at least two rows for a stratified split")
    if n_test < len(counts) or total - n_test < len(counts):
        raise ValueError("test_size leaves fewer rows than classes on one side")
    exact = {label: n_test * n / total for label, n in counts.items()}
    take = {label: math.floor(x) for label, x in exact.items()}
    order = sorted(counts, key=lambda label: (-(exact[label] - take[label]), label))
    for label in order[: n_test - sum(take.values())]:
        take[label] += 1
    return take


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    """Rows per class (a handful of classes)."""
    return {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "id", test_size: float = 0.2, seed: int = 42,
    counts: dict[int, int] | None = None,
) -> DataFrame:
    """add ``split`` ('train' or 'test') with exact stratified sizes.

    Membership follows the md5 order of seed and key, so it does not depend on
    partitioning.  The cut hashes are found first; marking rows is row-local.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    counts = counts or class_counts(df, label)
    cuts = hash_cuts(hashed, label, "_h", split_sizes(counts, test_size))
    in_test = F.lit(False)
    for value, cut in cuts.items():
        if cut is not None:
            in_test = in_test | ((F.col(label) == value) & (F.col("_h") <= cut))
    return hashed.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("_h")


def dataset_metadata(dataset: DataFrame, n_features: int) -> DataFrame:
    """rows per split and class, with the feature count."""
    return dataset.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == 0).alias("class_0"),
        F.count_if(F.col("label") == 1).alias("class_1"),
    ).withColumn("n_features", F.lit(n_features))

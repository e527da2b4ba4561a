import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from siftline.operators import features as ft
from siftline.operators import model as md
from siftline.operators.ranking import dense_ids
from siftline.plans.dataset import prepare_dataset, train_model
from siftline.sources import bundles

DOCS = ["breach found breach", "patch released", "", "breach patch notes", "cat pictures", "cat found"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "id bigint, content string")


def grams(text):
    w = text.split()
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def test_vocabulary_and_tfidf(docs):
    settings = ft.FeatureSettings(max_features=7)
    vocab = ft.fit_vocabulary(docs, settings)
    total = Counter(g for t in DOCS for g in grams(t))
    top = sorted(total, key=lambda g: (-total[g], g))[:7]
    assert vocab.terms == sorted(top) and vocab.n_docs == 6
    df = {g: sum(g in grams(t) for t in DOCS) for g in top}
    idf = {g: math.log(7 / (1 + df[g])) + 1 for g in top}
    assert vocab.dfs == [df[g] for g in vocab.terms]
    got = {(r.id, vocab.terms[r.idx]): r.weight for r in ft.tfidf_features(docs, vocab).collect()}
    want = {}
    for i, t in enumerate(DOCS):
        w = {g: n * idf[g] for g, n in Counter(grams(t)).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, g): x / norm for g, x in w.items()})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    norms = {r.id: r.norm for r in ft.transform_features(docs, vocab).collect()}
    assert all(abs(n - 1) < 1e-12 or n == 0 for n in norms.values()) and norms[2] == 0
    assert sum(r.tf for r in ft.count_features(docs, vocab).collect()) == sum(total[g] for g in top)


def test_split_sizes():
    assert ft.split_sizes({0: 58, 1: 341}) == {0: 12, 1: 68}
    assert sum(ft.split_sizes({0: 7, 1: 6}).values()) == 3
    with pytest.raises(ValueError):
        ft.split_sizes({0: 1, 1: 9})


def test_split_is_exact_and_complete(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    rows = ft.stratified_split(df).collect()
    sizes = Counter((r.label, r.split) for r in rows)
    want = ft.split_sizes({1: 143, 0: 857})
    assert len({r.id for r in rows}) == 1000
    assert sizes[(1, "test")] == want[1] and sizes[(0, "test")] == want[0]
    again = {r.id: r.split for r in ft.stratified_split(df.repartition(9)).collect()}
    assert again == {r.id: r.split for r in rows}


def test_dense_ids(spark):
    seqs = [5, 2**17, 2**17 + 1, 2**40, 1, 2**33]
    df = spark.createDataFrame([(s,) for s in seqs], "seq bigint").repartition(5)
    got = {r.seq: r.id for r in dense_ids(df, "seq", 100).collect()}
    assert got == {s: 101 + i for i, s in enumerate(sorted(seqs))}


def training_rows(spark, n=80, d=4):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)) * np.array([1, 0.5, 1.5, 0.7])
    y = (x @ np.array([1.0, 1.5, -0.6, 0.5]) + rng.normal(size=n) > 0.3).astype(int)
    rows = [(int(i), int(y[i]), Vectors.dense(x[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, ["id", "label", "features"]).repartition(3)


@pytest.mark.parametrize("model_type, params", [
    ("logistic_regression", {"tol": 1e-7}),
    ("logistic_regression", {"tol": 1e-7, "C": 0.1, "class_weight": "balanced"}),
    ("logistic_regression", {"tol": 1e-7, "fit_intercept": False}),
    ("logistic_regression", {"tol": 1e-7, "penalty": None}),
    ("linear_svc", {"tol": 1e-7}),
    ("linear_svc", {"tol": 1e-7, "intercept_scaling": 5.0}),
])
def test_training_reaches_the_optimum(spark, model_type, params):
    x, y, df = training_rows(spark)
    m = md.train(df, model_type, params)
    w, b, c = np.array(m.coefficients), m.intercept, params.get("C", 1.0)
    z = x @ w + b
    s = np.ones(len(y))
    if params.get("class_weight"):
        s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    if model_type == "linear_svc":
        t = 2 * y - 1
        slope, extra = -2 * t * np.maximum(1 - t * z, 0), b / params.get("intercept_scaling", 1.0) ** 2
    else:
        slope, extra = 1 / (1 + np.exp(-z)) - y, 0.0
    held_back = w if params.get("penalty", "l2") else 0.0
    assert np.abs(x.T @ (c * s * slope) + held_back).max() < 1e-4
    if params.get("fit_intercept", True):
        assert abs((c * s * slope).sum() + extra) < 1e-4
    else:
        assert b == 0


@pytest.mark.parametrize("model_type", md.MODEL_TYPES)
def test_start_weights(spark, model_type):
    _, _, df = training_rows(spark)
    params = {"tol": 1e-6, "intercept_scaling": 3.0}
    first = md.train(df, model_type, params)
    again = md.train(df, model_type, params, start=first)
    assert again.metadata["iterations"] == 0 < first.metadata["iterations"]
    assert np.allclose(again.coefficients, first.coefficients) and np.isclose(again.intercept, first.intercept)
    with pytest.raises(ValueError):
        md.train(df, model_type, start=md.LinearModel(model_type, [1.0], 0.0))
    with pytest.raises(ValueError):
        md.train(df, model_type, {"intercept_scaling": 0})
    with pytest.raises(ValueError):
        md.train(df, "linear_svc", {"penalty": None})


def test_pass_equals_plain_sums(spark):
    from siftline.operators import linear_fit as lf

    x, y, df = training_rows(spark)
    width = x.shape[1]
    rows = df.select(F.col("features").alias("x"), F.col("label").cast("double").alias("label"), F.lit(2.0).alias("weight"))
    folded = lf.fold_label(rows, width)
    w = np.array([0.1, 2.0, -0.3, 0.4])[:width]
    z = np.where(np.array(y) == 1, -1.0, 1.0)[:, None] * x
    t = z @ w
    want = {
        lf.logistic: (np.logaddexp(0, t), 1 / (1 + np.exp(-t))),
        lf.squared_hinge: (np.maximum(1 + t, 0) ** 2, 2 * np.maximum(1 + t, 0)),
    }
    for loss, (value, slope) in want.items():
        for groups in (1, 3):
            v, g = lf.loss_pass(folded, loss, w, z.sum(axis=0), groups)
            assert np.isclose(v, 2 * value.sum()) and np.allclose(g, 2 * z.T @ slope, atol=1e-6)


def test_a_pass_reads_blocks_of_dense_and_sparse_vectors(spark):
    """Vectors are taken apart once, not in every pass; blocks end anywhere, rows may have no entry."""
    from siftline.operators import linear_fit as lf

    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 6)) * (rng.random((20, 6)) < 0.5)
    x[4] = 0
    vectors = [Vectors.dense(r) if i % 3 == 0 else Vectors.sparse(6, [(int(j), float(r[j])) for j in np.flatnonzero(r)]) for i, r in enumerate(x)]
    weight = rng.random(20) * (np.arange(20) % 7 > 0)
    df = spark.createDataFrame([(v, float(w)) for v, w in zip(vectors, weight)], ["z", "weight"]).coalesce(2)
    blocks = lf.in_blocks(df, 3).persist()
    assert blocks.count() >= 7 and blocks.columns == [c.split()[0] for c in lf._BLOCK.split(", ")]
    w = rng.normal(size=6)
    t = x @ w
    value, gradient = lf.loss_pass(blocks, lf.logistic, w, groups=2)
    assert np.isclose(value, weight @ np.logaddexp(0, t)) and np.allclose(gradient, x.T @ (weight / (1 + np.exp(-t))))
    blocks.unpersist()


def test_optimality_sees_other_weights(spark):
    _, _, df = training_rows(spark)
    rows = df.withColumn("id", F.monotonically_increasing_id())
    for kind in md.MODEL_TYPES:
        model = md.train(rows, kind)
        model.vocabulary = None
        slopes = [abs(r.gradient) for r in md.optimality(rows, model).collect()]
        assert len(slopes) == len(model.coefficients) and max(slopes) <= 1.001e-4
        model.coefficients[0] += 0.5
        assert max(abs(r.gradient) for r in md.optimality(rows, model).collect()) > 1e-3


def test_most_frequent_terms_and_ties(spark):
    rng = random.Random(9)
    totals = [(f"t{k:03d}", rng.choice([1, 1, 1, 2, 2, 3, 7, 50]), 1) for k in range(300)]
    df = spark.createDataFrame(totals, "term string, count bigint, df bigint").repartition(5)
    for most in (1, 5, 60, 150, 299, 300, 1000):
        want = sorted(totals, key=lambda r: (-r[1], r[0]))[:most]
        got = ft.most_frequent(df, most)
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(want)
    assert ft.most_frequent(df.limit(0), 3).count() == 0


def test_bad_training_input(spark):
    _, _, df = training_rows(spark, 10)
    with pytest.raises(ValueError):
        md.train(df, "random_forest")
    with pytest.raises(ValueError):
        md.train(df, params={"depth": 3})
    with pytest.raises(ValueError):
        md.train(df.filter("label = 1"))


@pytest.mark.parametrize("pairs, want", [
    ([(1, 1), (1, 1)], (1.0, 1.0, 1.0, 1.0, 0, 0, 0, 2)),
    ([(0, 0)], (1.0, 0.0, 0.0, 0.0, 1, 0, 0, 0)),
    ([(0, 1), (1, 0)], (0.0, 0.0, 0.0, 0.0, 0, 1, 1, 0)),
    ([(1, 1), (1, 0), (0, 1), (0, 0)], (0.5, 0.5, 0.5, 0.5, 1, 1, 1, 1)),
])
def test_evaluate(spark, pairs, want):
    df = spark.createDataFrame(pairs, "label int, prediction int")
    assert tuple(md.evaluate(df).first()) == want
    assert md.confusion_matrix(df).count() == 4


@pytest.fixture(scope="module")
def labeled(spark):
    rows = []
    for i in range(40):
        word = "breach malware" if i % 2 else "cat picture"
        rows.append((i, f"{word} number{i % 5}", '{"is_relevant": %s}' % ("true" if i % 2 else "false")))
    rows.append((99, "unlabelled", "{}"))
    return spark.createDataFrame(rows, "id bigint, content string, labels string")


def test_end_to_end(spark, labeled, tmp_path):
    ds = prepare_dataset(labeled)
    assert {r.split: (r.n_rows, r.class_0, r.class_1) for r in ds.metadata().collect()} == {
        "train": (32, 16, 16), "test": (8, 4, 4)}
    only_train = prepare_dataset(labeled, fit_on="train")
    assert only_train.vocabulary.n_docs == 32
    bundles.save_dataset(ds, str(tmp_path / "ds"), "now")
    loaded, meta = bundles.load_dataset(spark, str(tmp_path / "ds"))
    assert meta["X_train_shape"] == [32, len(ds.vocabulary.terms)] and meta["class_distribution"]["test"] == {"0": 4, "1": 4}
    model = train_model(loaded)
    assert model.metrics["accuracy"] == 1.0 and model.metadata["training_samples"] == 32
    bundles.save_model(spark, model, str(tmp_path / "m"), "now")
    back = bundles.load_model(spark, str(tmp_path / "m"))
    assert back.metrics == model.metrics and back.vocabulary == model.vocabulary
    texts = spark.createDataFrame([("malware breach",), ("cat",), ("",)], "content string")
    got = md.predict_with_score(texts, back).collect()
    assert [r.is_relevant for r in got[:2]] == [True, False] and all(r.confidence >= 0.5 for r in got)
    assert [r.is_relevant for r in md.predict(texts, back, 0.0).collect()] == [True] * 3
    detail = md.evaluate_texts(texts, back).first()
    assert (detail.text_length, detail.preprocessed_length, detail.model_type) == (14, 14, "logistic_regression")
    svc = train_model(loaded, "linear_svc")
    assert {r.confidence for r in md.predict_with_score(texts, svc).collect()} == {1.0}
    top = md.feature_importance(model.coefficient_table(spark), 3).collect()
    assert len(top) == 3 and top[0].importance >= top[2].importance


def test_numbered_totals_equal_counted_text(spark, monkeypatch):
    """n-grams counted as numbers give the counts of the terms as text, cut and ties included."""
    import random
    from collections import Counter

    from siftline.operators import features as ft

    monkeypatch.setattr(ft, "SLICE_WORDS", 7)
    rng = random.Random(3)
    docs = [[f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randrange(25))] for _ in range(60)] + [[], None]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, words array<string>").repartition(3)
    for high, most in ((1, 5), (2, 20), (3, 30), (2, 5000)):
        terms = [[" ".join(d[i:i + n]) for n in range(1, high + 1) for i in range(len(d) - n + 1)] for d in docs if d]
        counts, dfs = Counter(t for d in terms for t in d), Counter(t for d in terms for t in set(d))
        best = sorted(counts, key=lambda t: (-counts[t], t))[:most]
        settings = ft.FeatureSettings(most, (1, high))
        got = ft.vocabulary_table(rows, settings, text_col="words").collect()
        assert [(r.term, r.idx, r["count"], r.df) for r in got] == [(t, i, counts[t], dfs[t]) for i, t in enumerate(sorted(best))]
        every = {r.term for r in ft.term_totals(rows, settings, text_col="words").collect()}
        # rare terms are not made at all
        assert set(best) <= every and (most > 100 or len(every) < len(counts))


def test_vectors_are_not_filtered_at_the_scan(spark, monkeypatch):
    """the vectoriser stands in the plan once."""
    from workload import all_queries
    from workload import tables as tb

    rows = spark.createDataFrame([(1, "alpha beta", 1), (2, "alpha", 0), (3, "", 1)], "id bigint, content string, label int")
    monkeypatch.setattr(tb, "labeled", lambda spark, sf: rows)
    out = all_queries()["F6_vectorize"](spark, "unused")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and sorted(r.id for r in out.collect()) == [1, 2]

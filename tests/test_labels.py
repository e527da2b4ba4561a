from siftline.functions import labels as lb
from siftline.operators import articles as ar
from pyspark.sql import functions as F

CASES = [
    # labels text, expected nested label
    (None, None), ("", None), ("{}", None), ('{"is_relevant": true}', 1), ('{"is_relevant": false}', 0),
    ('{"is_relevant": 1}', 1), ('{"is_relevant": 0}', 0), ('{"is_relevant": 1.0}', 1),
    ('{"is_relevant": 2}', None), ('{"is_relevant": "true"}', None), ('{"is_relevant": null}', None), ("{bad", None),
]


def frame(spark):
    rows = [(i, "text", c[0]) for i, c in enumerate(CASES)]
    return spark.createDataFrame(rows, "id bigint, content string, labels string")


def test_resolve_nested(spark):
    got = {r.id: r.label for r in lb.resolve_label(frame(spark)).collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES) if c[1] is not None}


def test_direct_label_wins_even_when_invalid(spark):
    good = '{"is_relevant": true}'
    rows = [(1, "t", good, "-1"), (2, "t", good, "0"), (3, "t", good, None), (4, "", good, "1"), (5, "t", None, "true")]
    df = spark.createDataFrame(rows, "id bigint, content string, labels string, is_relevant string")
    got = {r.id: r.label for r in lb.resolve_label(df, "is_relevant").collect()}
    assert got == {2: 0, 3: 1, 5: 1}


def test_load_articles(spark):
    df = frame(spark)
    labeled = [r.id for r in ar.load_articles(df).collect()]
    assert labeled == [i for i, c in enumerate(CASES) if c[0] not in (None, "", "{}")]
    assert [r.id for r in ar.load_articles(df, only_relevant=True).collect()] == [3, 5, 7]
    assert len(ar.load_articles(df, only_labeled=False, only_relevant=True, limit=4).collect()) == 4


def test_export_flag(spark):
    got = [r[0] for r in frame(spark).orderBy("id").select(lb.flag_or_minus_one(F.col("labels"))).collect()]
    assert got == [-1, -1, -1, 1, 0, 1, 0, 1, 2, -1, -1, -1]


def test_fallback_only_when_empty(spark):
    stored = frame(spark)
    other = spark.createDataFrame([(9, "x", None, "1")], "id bigint, content string, labels string, is_relevant string")
    assert 9 not in [r.id for r in ar.load_labeled_data(stored, other).collect()]
    assert [r.id for r in ar.load_labeled_data(stored.filter("id < 3"), other).collect()] == [9]


def test_labeled_json_array(spark, tmp_path):
    from siftline.sources.readers import read_labeled_json

    path = tmp_path / "l.json"
    path.write_text(
        '[{"id": 1, "content": "a", "labels": {"is_relevant": true}},\n'
        ' {"id": 2, "content": "b", "labels": {"is_relevant": "true"}},\n'
        ' {"id": 3, "content": "c", "is_relevant": 0, "labels": {"is_relevant": true}},\n'
        ' {"id": 4, "content": "d", "is_relevant": -1, "labels": {"is_relevant": true}}]'
    )
    df = read_labeled_json(spark, str(path))
    got = {r.id: r.label for r in lb.resolve_label(df, "is_relevant").collect()}
    assert got == {1: 1, 3: 0}

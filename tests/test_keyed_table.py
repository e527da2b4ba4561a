import os
import random

from pyspark.sql import functions as F

from siftline.operators import articles as ar
from siftline.operators.ranking import dense_ids
from siftline.schemas import ARTICLE_COLUMNS
from siftline.sources.keyed_table import KeyedTable

NOW = "2024-05-01T00:00:00"


def state(df):
    return {r.url: (r.id, r.title, r.date_stored) for r in df.collect()}


def test_merge_rewrites_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "articles")
    schema = ", ".join(f"{c} {'bigint' if c == 'id' else 'int' if c == 'status' else 'string'}" for c in ARTICLE_COLUMNS)
    table = KeyedTable.create(spark, path, schema, "url", parts=16, buckets=3)
    rng = random.Random(2)
    plain, last = {}, 0
    for batch, size in enumerate((300, 2, 40, 0)):
        seqs = rng.sample(range(10**12), size)
        records = [(s, f"http://h.org/{rng.randrange(200)}", f"t{s}") for s in seqs] + [(7 if size else 8, None, "no url")]
        incoming = spark.createDataFrame(records, "seq bigint, url string, title string")
        files = {d: set(os.listdir(tmp_path / "articles" / d)) for d in (os.listdir(path) if os.path.isdir(path) else []) if d.startswith("part=")}
        touched = ar.upsert_stored(table, incoming, f"{NOW}{batch}")
        for k, (s, url, title) in enumerate(sorted((r for r in records if r[1]), key=lambda r: r[0])):
            plain[url] = (last + k + 1, title, f"{NOW}{batch}")
        last = max(v[0] for v in plain.values())
        assert state(table.rows()) == plain
        after = {d: set(os.listdir(tmp_path / "articles" / d)) for d in (os.listdir(path) if os.path.isdir(path) else []) if d.startswith("part=")}
        changed = {int(d[5:]) for d in after if files.get(d) != after[d]}
        assert changed == set(touched) and (batch == 0 or len(touched) < 16)
    # opened again by path, and as a plain read
    again = KeyedTable.open(spark, path, schema, "url", parts=16, buckets=3)
    assert state(again.rows()) == plain == state(spark.read.parquet(path))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.kept(spark.createDataFrame([("x",)], "url string"), [1, 2])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # only the incoming keys are shuffled, and other parts are not read
    assert plan.count("Exchange") == 1 and plan.index("FileScan") < plan.index("Exchange")
    assert "SelectedBucketsCount: 3 out of 3" in plan and "part#" in plan.split("PartitionFilters")[1][:40]


def test_bodies_are_not_aggregated(spark):
    rows = spark.createDataFrame([(s, f"u{s % 3}", "t", "c") for s in range(9)], "seq bigint, url string, title string, content string")
    stored = spark.createDataFrame([], ", ".join(f"{c} {'bigint' if c == 'id' else 'string'}" for c in ARTICLE_COLUMNS))
    merged, _ = ar.upsert_articles(stored, rows, NOW)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert {r.url: r.id for r in merged.collect()} == {"u0": 7, "u1": 8, "u2": 9}


def test_dense_ids_of_sparse_numbers_and_ties(spark):
    rng = random.Random(4)
    seqs = rng.sample(range(-10**15, 10**15), 500)
    df = spark.createDataFrame([(s, i % 5) for i, s in enumerate(seqs)], "seq bigint, x int").repartition(7)
    got = {r.seq: r.id for r in dense_ids(df, "seq", 10).collect()}
    assert got == {s: 11 + k for k, s in enumerate(sorted(seqs))}
    tied = spark.createDataFrame([(1, c) for c in "edcba"], "seq bigint, name string")
    assert {r.name: r.id for r in dense_ids(tied, "seq", F.lit(0), ties=["name"]).collect()} == dict(zip("abcde", range(1, 6)))
    assert dense_ids(tied.limit(0), "seq").count() == 0

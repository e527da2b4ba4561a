"""The queries of the operators on the smallest tables, and the pipeline against plain versions."""

import hashlib
import os
import random
import sys
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from siftline.llm import mixing, quality  # noqa: E402
from siftline.llm.queries import ORACLES, QUERIES  # noqa: E402
from test_corpus_operators import plain_components, repeated  # noqa: E402
from test_text_operators import tokens  # noqa: E402, F401
from workload.check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        problem = compare(got, connect(SF).execute(ORACLES[name]).fetchdf())
        assert problem is None, problem


def test_entry_serves_all(spark):
    import __spark_entry__ as contract

    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


def sql(docs: pd.DataFrame, query: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.register("documents", docs)
    return con.execute(query).fetchdf()


def test_pipeline_stages_match_plain_versions(spark, tokens):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    stages = [f for _, f in corpus_pipeline.STAGES]
    before = docs.toPandas()

    kept = stages[0](spark, docs, SF)
    assert kept.columns == docs.columns
    verdict = sql(before, quality.ORACLE_SQL)
    rows = kept.toPandas()
    assert sorted(rows["doc_id"]) == sorted(verdict.loc[verdict["kept"], "doc_id"])
    untouched = set(verdict.loc[verdict["n_removed_lines"] == 0, "doc_id"])
    text = dict(zip(before["doc_id"], before["text"]))
    assert all(t == text[i] for i, t in zip(rows["doc_id"], rows["text"]) if i in untouched)

    rows = rows.sort_values("doc_id").reset_index(drop=True)
    one = stages[1](spark, kept, SF)
    roots, _ = plain_components(rows["text"].tolist(), 5, 80)
    assert one.columns == docs.columns
    rows = one.toPandas().sort_values("doc_id").reset_index(drop=True), rows
    assert rows[0]["doc_id"].tolist() == [rows[1]["doc_id"][i] for i in sorted(set(roots))]

    rows = rows[0]
    clean = stages[2](spark, one, SF)
    want = repeated(rows["text"].tolist(), corpus_pipeline.PASSAGE_BYTES)
    after = clean.toPandas()
    assert sorted(after["doc_id"]) == sorted(i for i, (n, gone, _, _) in zip(rows["doc_id"], want) if not gone or gone < n)

    mixed = stages[3](spark, clean, SF).toPandas()
    taken = sql(after, mixing.ORACLE_SQL)
    words = Counter()
    for i, t in zip(mixed["doc_id"], mixed["text"]):
        words[i] += len(t.split())
    assert dict(words) == {i: n for i, n in zip(taken["doc_id"], taken["taken"]) if n}

    out = stages[4](spark, spark.createDataFrame(mixed), SF).toPandas()
    ids = Counter((i, tuple(tokens.encode_ordinary(t))) for i, t in zip(mixed["doc_id"], mixed["text"]))
    assert Counter((i, tuple(x)) for i, x in zip(out["doc_id"], out["ids"])) == ids


def test_pipeline_removes_repeated_passages_of_fifty_words(spark):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 7))) for _ in range(n))
    passage = text(52)
    assert len(passage) < 400
    docs = spark.createDataFrame([(i, f"{text(80)} {passage} {text(80)}", "en", "s", 0) for i in range(2)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.substring_stage(spark, docs, SF).collect()
    assert len(left) == 2 and not any(passage in r["text"] for r in left)
    want = repeated([r["text"] for r in docs.collect()], corpus_pipeline.PASSAGE_BYTES)
    assert sorted(len(r["text"]) for r in left) == sorted(n - gone for n, gone, _, _ in want)


def test_pipeline_runs_from_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_substring_query_returns_what_is_left_as_text(spark):
    """The reviewer's reader found no text in ``kept`` and went by ``n_bytes``, the input's length."""
    rows = QUERIES["op7_suffix_dedup"](spark, SF).collect()
    whole = [r for r in rows if "\ufffd" not in r["text"]]
    assert whole and any(r["n_removed"] for r in whole)
    assert all(len(r["text"].encode()) == r["n_bytes"] - r["n_removed"] for r in whole)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in whole)

"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from workload import all_queries
from workload.check import compare, connect
from workload.registry import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    got = all_queries()[name](spark, SF).toPandas()
    if name in ORACLES:
        problem = compare(got, con.execute(ORACLES[name]).fetchdf())
        assert problem is None, problem


def test_tokenize_blank_texts(spark, tmp_path):
    """Texts without tokens, which the given tables do not have."""
    texts = ["two words", "one", "", " \n\t ", None, " in between "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "one"), (None, "")]
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(at)
    got = all_queries()["T9_tokenize"](spark, str(tmp_path))
    want = [
        (0, 2, "two", "words"), (1, 1, "one", "one"), (2, 0, None, None), (3, 0, None, None),
        (4, None, None, None), (5, 2, "in", "between"), (1, 1, "one", "one"), (None, 0, None, None),
    ]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    twin = duckdb.sql(f"WITH documents AS (FROM '{at}/*.parquet') {ORACLES['T9_tokenize']}").fetchall()
    assert sorted(twin, key=str) == sorted(want, key=str)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 40
    assert set(contract.oracle_sql()) <= set(contract.queries())

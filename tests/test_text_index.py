"""Substring search over blocks: whole results, and fewer rows read for rare keywords."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions.text import contains_text
from siftline.operators import articles as ar
from siftline.operators.text_index import TextIndex, block_ranges, keyword_grams


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(2, 8))) for _ in range(300)]
    rows = [(i, rng.choice(words), " ".join(rng.choices(words, k=30)) + (" Needle_%" if i in (77, 1500) else "")) for i in range(2000)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "ab", "É\n\U0001f600xy")]
    df = spark.createDataFrame(rows, "id bigint, title string, content string")
    return df, TextIndex.create(df, ["title", "content"], "id", block_rows=64, files=4)


KEYWORDS = ["needle", "NEEDLE_", "needle_%", "abc", "ab", "é", "a%b_c", "_", "É\n", "\U0001f600xy", "zzzz", "n__dle", "%eed%dl%"]


@pytest.mark.parametrize("keyword", KEYWORDS)
def test_results_equal_the_scan(stored, keyword):
    df, index = stored
    want = df.filter(contains_text(F.col("title"), keyword) | contains_text(F.col("content"), keyword))
    assert sorted(r["id"] for r in index.search(keyword).collect()) == sorted(r["id"] for r in want.collect())


def test_rare_keywords_read_few_rows(stored):
    df, index = stored
    assert index.rows().count() == df.count() == index.candidates("ab").count()
    assert index.candidates("needle").count() <= 128 and index.candidates("zzzz").count() == 0
    plan = index.candidates("needle")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(block" in plan


def test_many_blocks_are_joined(stored, monkeypatch):
    df, index = stored
    before = sorted(r["id"] for r in index.search("abc").collect())
    monkeypatch.setattr("siftline.operators.text_index.MAX_PUSHED_BLOCKS", 1)
    assert before and sorted(r["id"] for r in index.search("abc").collect()) == before


def test_appended_rows_are_found(spark, stored):
    df, _ = stored
    index = TextIndex.create(df.limit(0), ["title", "content"], "id", block_rows=64)
    assert index.search("needle").count() == 0
    index.append(df.filter("id < 1000"), "id", files=2)
    index.append(df.filter("id >= 1000"), "id", files=2)
    assert sorted(r["id"] for r in index.search("needle").collect()) == [77, 1500]
    assert index.rows().count() == df.count() and index.candidates("needle").count() <= 128


def test_page_of_indexed_articles_has_labels_as_object(spark):
    rows = [(i, f"http://d/{i}", f"t{i}", "some needle text" if i % 3 == 0 else "plain", "d", f"2024-01-0{i}", '{"is_relevant": true}' if i % 2 else "") for i in range(1, 10)]
    df = spark.createDataFrame(rows, "id bigint, url string, title string, content string, domain string, date_extracted string, labels string")
    index = TextIndex.create(df, ["title", "content"], "id", block_rows=2)
    page = ar.search_indexed(index, "NEEDLE", domain="d", end_date="2024-01-08", limit=2)
    got = [(r["id"], r["flag"]) for r in page.select("id", F.try_variant_get("labels", "$.is_relevant", "boolean").alias("flag")).collect()]
    assert got == [(6, None), (3, True)] and page.schema["labels"].dataType.typeName() == "variant"


def test_grams_and_ranges():
    assert keyword_grams("AbCd%xy_é12") == ["abc", "bcd", "é12"] and keyword_grams("a_b%") == []
    assert block_ranges([], 3) == [] and block_ranges([4], 3) == [(4, 4)]
    assert block_ranges([1, 2, 3, 10, 11, 50, 90], 3) == [(1, 11), (50, 50), (90, 90)]


def test_grams_of_blocks_are_those_of_their_texts(spark, monkeypatch):
    """trigrams found as numbers are the overlapping ones of every text, A-Z folded."""
    from siftline.operators import text_index as ti

    monkeypatch.setattr(ti, "_HELD_CHARS", 8)
    texts = ["AbcABC\n\U0001f600é", "ab", "", None, "xyzÀÉ", "abcd" * 5]
    rows = spark.createDataFrame([(i, t, t and t[::-1]) for i, t in enumerate(texts)], "id int, a string, b string")
    index = ti.TextIndex.create(rows, ["a", "b"], "id", block_rows=2, files=1)
    fold = str.maketrans(ti._UPPER, ti._LOWER)
    want = {
        (i // 2, s[k:k + 3]) for i, t in enumerate(texts) if t for s in (t.translate(fold), t[::-1].translate(fold)) for k in range(len(s) - 2)}
    got = [(r.block, r.gram) for r in index._batches("grams").collect()]
    assert set(got) == want and len(got) == len(want)

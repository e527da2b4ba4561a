import pytest
from pyspark.sql import functions as F

from siftline import schemas
from siftline.operators import articles as ar
from siftline.operators import content_store as cs

NOW = "2024-05-01T00:00:00"


def stored(spark):
    rows = [
        (1, "u1", "One", "alpha", "d1", "", "2024-01-01", "s", "crawler", 1, '{"is_relevant": true}'),
        (2, "u2", "Two", "beta", "d2", "", "2024-01-02", "s", "crawler", 1, "{}"),
        (5, "u5", "Five 100%", "gamma", "d1", "", "2024-01-03", "s", "crawler", 1, None),
    ]
    return spark.createDataFrame(rows, schemas.ARTICLES)


def test_upsert(spark):
    incoming = spark.createDataFrame(
        [(1, "u1", None, "new", None), (2, None, "t", "c", None), (3, "u9", "N", "c1", "{}"),
         (4, "u9", "N2", None, '{"a":1}'), (10**7, "u8", "far", "c", None)],
        "seq bigint, url string, title string, content string, labels string",
    )
    table, added = ar.upsert_articles(stored(spark), incoming, NOW)
    rows = {r.url: r for r in table.collect()}
    assert added.first().added == 4
    assert sorted(rows) == ["u1", "u2", "u5", "u8", "u9"]
    assert (rows["u1"].id, rows["u1"].status, rows["u1"].labels, rows["u1"].title) == (6, 0, "{}", "")
    assert (rows["u9"].id, rows["u9"].title, rows["u9"].content, rows["u9"].labels) == (8, "N2", "", '{"a":1}')
    assert rows["u8"].id == 9 and rows["u2"].id == 2 and rows["u8"].date_stored == NOW


def test_upsert_takes_metadata(spark):
    incoming = spark.sql(
        "select 1L seq, 'u7' url, 't' title, 'c' content, named_struct('publish_date', cast(null as string), 'domain', 'd7') metadata"
        " union all select 2L, 'u6', 't', 'c', null"
    )
    rows = {r.url: r for r in ar.upsert_articles(stored(spark), incoming, NOW)[0].collect()}
    assert (rows["u7"].domain, rows["u7"].publish_date) == ("d7", None)
    assert (rows["u6"].domain, rows["u6"].publish_date) == ("", "")


def test_strict_insert(spark):
    incoming = spark.createDataFrame(
        [(1, "a", "t", "c"), (2, "b", None, "c"), (3, None, "t", "c"), (4, "c", "t", None)],
        "seq bigint, url string, title string, content string",
    )
    table, added = ar.insert_articles_strict(stored(spark), incoming, NOW)
    assert added.first().added == 1 and table.filter("url in ('b', 'c')").count() == 0


def test_patch(spark):
    patches = spark.createDataFrame(
        [(1, 1, ["title"], None, 7), (2, 1, ["title", "status"], "x", 9), (3, 1, ["title"], None, 0),
         (4, 2, [], "ignored", 4)],
        "seq bigint, id bigint, fields array<string>, title string, status int",
    )
    rows = {r.id: r for r in ar.patch_articles(stored(spark), patches, NOW, "id", "seq").collect()}
    assert (rows[1].title, rows[1].status, rows[1].date_stored) == (None, 9, NOW)
    assert (rows[2].title, rows[2].date_stored) == ("Two", "s")
    assert rows[5].title == "Five 100%"


def test_patch_by_url_serialises_labels(spark):
    patches = spark.sql("select 'u2' url, array('labels') fields, named_struct('is_relevant', false) labels")
    rows = {r.url: r for r in ar.patch_articles(stored(spark), patches, NOW, "url").collect()}
    assert rows["u2"].labels == '{"is_relevant":false}' and rows["u2"].id == 2
    with pytest.raises(Exception, match="need seq"):
        ar.patch_articles(stored(spark), patches.union(patches), NOW, "url").collect()


def test_delete_and_get(spark):
    keys = spark.createDataFrame([("u1",), ("nope",)], "url string")
    assert [r.id for r in ar.delete_articles(stored(spark), keys, "url").orderBy("id").collect()] == [2, 5]
    got = ar.get_articles(stored(spark), keys, "url").select(
        "id", F.try_variant_get("labels", "$.is_relevant", "boolean").alias("r")).collect()
    assert [(r.id, r.r) for r in got] == [(1, True)]


def test_search_and_count(spark):
    df = stored(spark)
    assert [r.id for r in ar.search_articles(df).collect()] == [5, 2, 1]
    assert [r.id for r in ar.search_articles(df, domain="d1", limit=1, offset=1).collect()] == [1]
    assert [r.id for r in ar.search_articles(df, content_filter="0%").collect()] == [5]
    assert [r.id for r in ar.search_articles(df, content_filter="ALPHA").collect()] == [1]
    assert ar.count_articles(df, start_date="2024-01-02", end_date="2024-01-02").first().total == 1
    assert ar.count_articles(df, domain="").first().total == 3


def test_queue_limits_before_excluding(spark):
    done = spark.createDataFrame([(5,)], "id bigint")
    assert [r.id for r in ar.labeling_queue(stored(spark), done, 1).collect()] == []
    assert [r.id for r in ar.labeling_queue(stored(spark), done, 2).collect()] == [2]


def test_labels_and_stats(spark):
    decisions = spark.createDataFrame([(2, 1), (5, -1)], "id bigint, label int")
    rows = {r.id: r for r in ar.apply_labels(stored(spark), decisions, NOW).collect()}
    assert rows[2].labels == '{"is_relevant":true,"labeled_by":"manual","labeled_date":"%s"}' % NOW
    assert rows[5].labels is None
    stats = ar.labeling_stats(decisions).first()
    assert (stats.total_labeled, stats.skipped, stats.relevance_percentage) == (1, 1, 100.0)
    assert ar.labeling_stats(decisions.filter("label = -1")).first().relevance_percentage is None


def test_content_store(spark):
    df = spark.createDataFrame(
        [(1, "a/b", "first"), (2, "a?b", "second"), (3, None, "none")], "seq bigint, url string, body string"
    )
    store, saved = cs.write_content(None, df, NOW)
    assert saved.first().saved == 2
    assert [(r.content_id, r.body) for r in store.collect()] == [("a_b", "first")]
    again, _ = cs.write_content(store, df, NOW, overwrite=True)
    assert cs.read_content(again, "a/b").first().body == "second"
    assert [r.content_id for r in cs.list_contents(again).collect()] == ["a_b"]


def test_csv_roundtrip(spark, tmp_path):
    from siftline.sources import writers

    row = [(1, "u", ' lead "q", x\nline ', "c", "d", "", "2024", "s", "crawler", 0, "{}")]
    df = spark.createDataFrame(row, schemas.ARTICLES)
    path = str(tmp_path / "csv")
    assert writers.export_csv(df, path)
    assert writers.read_csv(spark, path, schemas.ARTICLES).first().title == ' lead "q", x\nline '
    assert not writers.export_csv(df, str(tmp_path / "none"), {"domain": "zzz"})
    assert not (tmp_path / "none").exists()


def test_pages_of_any_size(spark):
    from siftline.operators import ranking

    df = spark.range(60).select(
        "id", F.when(F.col("id") % 4 != 0, (F.col("id") % 7).cast("string")).alias("by"), F.lit("wide").alias("rest"))
    def key(r):  # descending with nulls last, then id
        return (r[1] is None, -int(r[1] or 0), r[0])
    want = [r[0] for r in sorted(df.collect(), key=key)]
    got = ranking.page_of(df, df, "by", True, 30, 20).collect()
    assert [r.id for r in got] == want[20:50]
    assert ranking.page_of(df, df.filter("id < 50"), limit=None).count() == 50
    assert ranking.page_of(df, df.filter("id < 0"), "by").count() == 0

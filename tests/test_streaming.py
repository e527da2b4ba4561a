import time

from siftline import schemas
from siftline.streaming import incremental as st

TEXT = "<title>T</title><p>" + "w" * 50 + "</p>"
COLS = "seq bigint, url string, html string, status int"
NOW = "2024-05-01T00:00:00"


def test_scoring_sees_each_url_once_and_merges_idempotently(spark, tmp_path):
    inbox, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    first = [(i, f"http://h{i % 2}.org/{i}", TEXT, 200) for i in range(6)]
    second = first[3:] + [(10, "http://h0.org/10", TEXT, 200), (11, "http://h0.org/11", "<p>x</p>", 200)]
    spark.createDataFrame(first, COLS).coalesce(1).write.mode("append").parquet(inbox)
    scored = st.score_stream(st.stream_pages(spark, inbox, COLS), None, keep=["seq"])
    st.run_available(scored, sink, progress)
    spark.createDataFrame(second, COLS).coalesce(1).write.mode("append").parquet(inbox)
    st.run_available(scored, sink, progress)
    out = spark.read.parquet(sink)
    assert out.count() == 8 and out.select("url").distinct().count() == 8

    empty = {
        "articles": schemas.ARTICLES, "incidents": schemas.INCIDENTS, "sources": schemas.SOURCES,
        "tags": schemas.TAGS, "incident_tags": schemas.INCIDENT_TAGS,
    }
    tables = {n: spark.createDataFrame([], s) for n, s in empty.items()}
    once = st.merge_scored(out, *tables.values(), NOW)
    assert {n: t.count() for n, t in once.items()} == {
        "articles": 7, "incidents": 7, "sources": 2, "tags": 1, "incident_tags": 7}
    again = st.merge_scored(out, *[once[n] for n in empty], NOW)
    assert {n: t.count() for n, t in again.items()} == {n: t.count() for n, t in once.items()}


def test_state_is_bounded_and_late_repeats_are_merged_once(spark, tmp_path):
    inbox, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    totals = []
    for k in range(6):
        # five new urls a run, and one that every run brings
        rows = [(100 * k + i, f"http://h.org/{k}-{i}", TEXT, 200) for i in range(5)] + [(100 * k + 50, "http://h.org/again", TEXT, 200)]
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(inbox)
        scored = st.score_stream(st.stream_pages(spark, inbox, COLS), None, keep=["seq"], repeat_within="1 second")
        time.sleep(1.2)
        done = st.run_available(scored, sink, progress)
        totals += [op["numRowsTotal"] for p in done for op in p["stateOperators"]]
        assert any("rocksdb" in name for p in done for op in p["stateOperators"] for name in op["customMetrics"])
    # 36 pages have passed; the state holds those of the last run or two
    assert len(totals) >= 6 and max(totals) <= 12
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(sink)
    assert out.filter("url = 'http://h.org/again'").count() > 1
    tables = [spark.createDataFrame([], s) for s in (schemas.ARTICLES, schemas.INCIDENTS, schemas.SOURCES, schemas.TAGS, schemas.INCIDENT_TAGS)]
    merged = st.merge_scored(out, *tables, NOW)
    assert merged["incidents"].count() == merged["incidents"].select("source_reference").distinct().count() == 31
    assert merged["articles"].count() == 31


def test_html_is_parsed_before_the_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "http://h.org/1", TEXT, 200)], COLS).write.parquet(str(tmp_path / "in"))
    scored = st.score_stream(st.stream_pages(spark, str(tmp_path / "in"), COLS), None)
    plan = scored._jdf.queryExecution().analyzed().toString()
    assert plan.index("DeduplicateWithinWatermark") < plan.index("MapInPandas")


def test_daily_counts_close_days_and_add_open_ones(spark, tmp_path):
    inbox, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def arrive(*times):
        spark.sql("select explode(array({})) created_at".format(", ".join(f"timestamp'{t}'" for t in times))).coalesce(1).write.mode("append").parquet(inbox)
        st.run_available(st.daily_counts(st.stream_pages(spark, inbox, "created_at timestamp")), sink, progress)
        closed = spark.read.schema("day timestamp, incidents bigint").parquet(sink)
        totals = st.daily_totals(closed, spark.read.parquet(inbox))
        return [{str(r.day)[8:10]: r.incidents for r in df.collect()} for df in (closed, totals)]

    closed, totals = arrive(*(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00" for h in range(4 * 24 + 13)))
    # the last row is of day 5, 12:00; one day earlier day 4 is still open
    assert closed == {"01": 24, "02": 24, "03": 24}
    assert totals == closed | {"04": 24, "05": 13}
    # late by less than a day: counted; late by days: the closed day stays as it was
    closed, totals = arrive("2024-01-04 13:30:00", "2024-01-01 05:00:00")
    assert closed == {"01": 24, "02": 24, "03": 24}
    assert totals == closed | {"04": 25, "05": 13}
    closed, totals = arrive("2024-01-07 00:00:00")
    assert closed == {"01": 24, "02": 24, "03": 24, "04": 25, "05": 13}
    assert totals == closed | {"07": 1}
    plan = st.daily_totals(spark.read.parquet(sink), spark.read.parquet(inbox))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at,2024-01-06" in plan


def test_daily_totals_without_a_closed_day(spark):
    rows = spark.sql("select explode(array(timestamp'2024-01-01 01:00:00', null)) created_at")
    none = spark.createDataFrame([], "day timestamp, incidents bigint")
    assert [r.incidents for r in st.daily_totals(none, rows).collect()] == [1]


def test_a_named_table_streams_from_a_file_and_from_a_folder(spark, tmp_path):
    """large tables are folders of part files, small ones single files."""
    spark.createDataFrame([(i, f"http://h.org/{i}", TEXT, 200) for i in range(8)], COLS).repartition(2).write.parquet(str(tmp_path / "all" / "pages.parquet"))
    parts = sorted((tmp_path / "all" / "pages.parquet").glob("part-*.parquet"))
    assert len(parts) == 2
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "pages.parquet").write_bytes(parts[0].read_bytes())
    (tmp_path / "one" / "other.parquet").write_bytes(parts[1].read_bytes())
    counts = {}
    for kind in ("all", "one"):
        sink, progress = (str(tmp_path / kind / n) for n in ("out", "progress"))
        pages = st.stream_pages(spark, str(tmp_path / kind), COLS, glob="pages.parquet")
        for _ in range(2):
            st.run_available(pages.select("seq"), sink, progress)
        counts[kind] = spark.read.schema("seq bigint").parquet(sink).count()
    assert counts == {"all": 8, "one": spark.read.parquet(str(parts[0])).count()}

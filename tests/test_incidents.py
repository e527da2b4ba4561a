import pytest
from pyspark.sql import functions as F

from siftline import schemas
from siftline.operators import incidents as inc
from siftline.operators import monitoring as mon
from siftline.operators import ranking

NOW = "2024-05-01T00:00:00"
T = "timestamp_ntz'2024-04-30 10:00:00'"


@pytest.fixture(scope="module")
def tables(spark):
    incidents = spark.sql(f"""select * from values
        (1L, 'Alpha', 'first one', 1L, 'r1', {T}, {T}), (2L, 'Beta', null, 2L, 'r2', {T}, {T}),
        (3L, 'Gamma', 'it''s ÉTÉ', null, 'r3', timestamp_ntz'2024-04-29 23:59:59', {T}),
        (4L, 'Delta', '', 1L, 'r4', timestamp_ntz'2024-03-01 00:00:00', {T})
        as t(id, title, description, source_id, source_reference, created_at, updated_at)""")
    sources = spark.sql(f"select * from values (1L, 'Blog', 'http://b', {T}, {T}), (2L, 'News', null, {T}, {T}), (3L, 'Idle', null, {T}, {T}) as t(id, name, url, created_at, updated_at)")
    tags = spark.sql(f"select * from values (1L, 'x', {T}), (2L, 'y', {T}), (3L, 'z', {T}) as t(id, name, created_at)")
    links = spark.createDataFrame([(1, 2), (1, 1), (1, 3), (2, 1)], schemas.INCIDENT_TAGS)
    return incidents, sources, tags, links


def test_view(tables):
    rows = {r.id: r for r in inc.incident_view(*tables).collect()}
    assert [t.name for t in rows[1].tags] == ["x", "y", "z"] and rows[1].source.name == "Blog"
    assert rows[3].source is None and rows[3].tags == []
    assert inc.get_incident(*tables, 99).count() == 0


def test_list_and_pages(tables):
    items, info = inc.list_incidents(*tables, tag_name="x")
    assert [r.id for r in items.collect()] == [1, 2]
    assert [t.name for t in items.first().tags] == ["x", "y", "z"]
    items, info = inc.list_incidents(*tables, page=2, per_page=3)
    assert [r.id for r in items.collect()] == [4]
    assert tuple(info.first()) == (4, 2, 3, 2)
    assert [r.id for r in inc.recent_incidents(*tables, limit=3).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        inc.list_incidents(*tables, per_page=101)


def test_search(tables):
    i, s, _, _ = tables
    assert [r.id for r in inc.search_incidents(i, s, "bLoG").collect()] == [1, 4]
    assert [r.id for r in inc.search_incidents(i, s, "été").collect()] == []
    shown = {r.id: r for r in inc.search_display(inc.search_incidents(i, s, "ta")).collect()}
    assert (shown[2].description, shown[2].source_name) == ("No description", "News")
    assert shown[4].description == "No description"
    with pytest.raises(ValueError):
        inc.search_incidents(i, s, "a")


def test_dashboard(tables):
    i, s, t, _ = tables
    assert tuple(inc.dashboard_kpis(i, s, t).first()) == (4, 3, 3)
    assert {r.name: r.incidents for r in inc.incidents_by_source(i, s).collect()} == {"Blog": 2, "News": 1, "Idle": 0}
    assert {r.name: r.incidents for r in inc.incidents_by_source(i, s, 1).collect()} == {"Blog": 1, "News": 0, "Idle": 0}
    line = {str(r.day): (r.label, r.incidents) for r in inc.incidents_timeline(i, "2024-04-30").collect()}
    assert len(line) == 30 and line["2024-04-30"] == ("Apr 30", 2) and line["2024-04-29"][1] == 1
    assert min(line) == "2024-04-01" and line["2024-04-01"][0] == "Apr 1"
    m = mon.system_metrics(i, s, t).first()
    assert (m.incidents_total, m.last_incident_id, m.last_incident_created_at) == (4, 1, "2024-04-30T10:00:00")


def test_create(spark, tables):
    i, s, t, link = tables
    incoming = spark.sql("""select * from values
        (10L, 'N1', 'd', 1L, 'r1', array('new', 'x', 'new')), (11L, 'N2', 'd', 1L, 'r1', array('later', 'new')),
        (12L, null, 'd', 1L, 'r1', array('lost')) as v(seq, title, description, source_id, source_reference, tags)""")
    rows, tags, links = inc.create_incidents(i, t, link, incoming, NOW)
    assert [(r.id, r.title) for r in rows.filter("id > 4").orderBy("id").collect()] == [(5, "N1"), (6, "N2")]
    ids = {r.name: r.id for r in tags.collect()}
    assert ids == {"x": 1, "y": 2, "z": 3, "new": 4, "later": 5}
    assert sorted(tuple(r) for r in links.filter("incident_id > 4").collect()) == [(5, 1), (5, 4), (6, 4), (6, 5)]


def test_create_without_rows(spark, tables):
    i, s, t, link = tables
    none = spark.createDataFrame([], "seq bigint, title string, description string, source_id bigint, source_reference string, tags array<string>")
    rows, tags, links = inc.create_incidents(i, t, link, none, NOW)
    assert (rows.count(), tags.count(), links.count()) == (4, 3, 4)


def test_lookup_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HOT_KEYS", 8)
    names = ["hot"] * 600 + [f"k{n % 100}" for n in range(400)] + [None, "unknown"]
    df = spark.createDataFrame(list(enumerate(names)), "row bigint, name string").repartition(4)
    table = spark.createDataFrame([(0, "hot"), (-1, "unused")] + [(n + 1, f"k{n}") for n in range(100)], "id bigint, name string")
    found = ranking.lookup(df, table, "name")
    want = {n: 0 if name == "hot" else int(name[1:]) + 1 for n, name in enumerate(names) if name and name != "unknown"}
    rows = found.collect()
    assert len(rows) == 1000 and {r.row: r.id for r in rows} == want
    assert ranking.lookup(df.filter("row < 0"), table, "name").count() == 0


def test_search_of_all_rows_and_unknown_sources(spark, tables):
    i, s, _, _ = tables
    assert [(r.id, r.source_name) for r in inc.search_incidents(i, s, "mm").collect()] == [(3, None)]
    assert sorted(r.id for r in inc.search_incidents(i, s, "bl", limit=None).collect()) == [1, 4]


def test_sources_first_url(spark, tables):
    incoming = spark.createDataFrame(
        [(2, "n.org", "http://n.org/2"), (1, "n.org", "http://n.org/1"), (3, "Blog", "http://x")],
        "seq bigint, domain string, url string",
    )
    rows = inc.get_or_create_sources(tables[1], incoming, NOW).filter("id > 3").collect()
    assert [(r.id, r.name, r.url) for r in rows] == [(4, "n.org", "http://n.org/1")]


def test_patch(spark, tables):
    i, _, t, link = tables
    patches = spark.sql("""select * from values
        (1L, 1L, '', 'new text', cast(null as bigint), cast(null as string), cast(null as array<string>)),
        (2L, 2L, 'T', '', 3L, null, array()), (3L, 3L, null, null, null, null, array('q', 'x')),
        (4L, 99L, 'gone', null, null, null, array('never')) as v(seq, id, title, description, source_id, source_reference, tags)""")
    rows, tags, links = inc.patch_incidents(i, t, link, patches, NOW)
    r = {x.id: x for x in rows.collect()}
    assert (r[1].title, r[1].description, r[1].source_id) == ("Alpha", "new text", 1)
    assert (r[2].title, r[2].description, r[2].source_id) == ("T", "", 3)
    assert str(r[3].updated_at) == "2024-05-01 00:00:00" and str(r[4].updated_at) == "2024-04-30 10:00:00"
    assert {x.name for x in tags.collect()} == {"x", "y", "z", "q"}
    assert sorted(tuple(x) for x in links.collect()) == [(1, 1), (1, 2), (1, 3), (3, 1), (3, 4)]


def test_delete(spark, tables):
    i, _, _, link = tables
    rows, links = inc.delete_incidents(i, link, spark.createDataFrame([(1,)], "id bigint"))
    assert rows.count() == 3 and [tuple(x) for x in links.collect()] == [(2, 1)]


def test_jobs(spark):
    jobs = spark.createDataFrame(
        [("a", "running", None), ("b", "idle", None), ("c", "idle", "2024-01-02"), ("d", "failed", "2024-01-01T00:00")],
        "job_id string, status string, next_run string",
    )
    assert sorted(r.job_id for r in mon.due_jobs(jobs, "2024-01-01T00:00").collect()) == ["b", "d"]
    runs = spark.createDataFrame([(i, f"j{i % 2}", f"2024-01-{i:02d}") for i in range(1, 20)], "id bigint, job_id string, end_time string")
    assert [r.id for r in mon.job_history(runs, limit=2).collect()] == [19, 18]
    assert mon.job_history(runs, "j1", None).count() == 10

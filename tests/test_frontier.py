import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import frontier as fr
from siftline.plans import workflow as wf


def host(url):
    return url.split("//")[1].split("/")[0]


def random_graph(seed, n=40):
    rng = random.Random(seed)
    urls = [f"http://h{i % 3}.org/{i}" for i in range(n)]
    status = {u: rng.choice([200, 200, 200, 404]) for u in urls[: n - 4]}
    links = {u: [rng.choice(urls) for _ in range(rng.randrange(6))] for u in urls}
    return urls, status, links


def frames(spark, status, links):
    pages = spark.createDataFrame(list(status.items()), "url string, status int")
    edges = spark.createDataFrame(
        [(u, i, v) for u, ls in links.items() for i, v in enumerate(ls)], "src_url string, pos int, link string"
    )
    return pages, edges


def plain_bfs(seeds, status, links, max_depth, max_urls):
    queue, visited = [(s, 0) for s in seeds], {}
    while queue and (max_urls is None or len(visited) < max_urls):
        url, depth = queue.pop(0)
        if url in visited or depth > max_depth:
            continue
        visited[url] = (depth, status.get(url, 0))
        if status.get(url) == 200 and depth < max_depth:
            queue += [(v, depth + 1) for v in links[url] if v not in visited]
    return {(u, d, s) for u, (d, s) in visited.items()}


def graphs(edges, pages):
    """The plain graph, the stored one, and one in which nearly every page is a hub."""
    return [fr.plain_graph(edges, pages), fr.store_graph(edges, pages), fr.store_graph(edges, pages, hub_links=2, buckets=3)]


@pytest.mark.parametrize("seed, max_depth, max_urls", [(1, 2, 100), (2, 3, 9), (3, 2, 5), (4, 3, None), (5, 0, 100)])
def test_bfs(spark, seed, max_depth, max_urls):
    urls, status, links = random_graph(seed)
    pages, edges = frames(spark, status, links)
    start = [urls[0], urls[7], urls[0]]
    seeds = spark.createDataFrame([(u, i) for i, u in enumerate(start)], "url string, pos int")
    want = sorted(plain_bfs(start, status, links, max_depth, max_urls))
    for graph in graphs(edges, pages)[seed % 2:]:
        got = fr.bfs(seeds, graph, max_depth, max_urls).select("url", "depth", "status")
        assert sorted(map(tuple, got.collect())) == want


def test_hub_links_are_dealt_into_parts(spark):
    links = {"http://a.org/hub": [f"http://a.org/{i}" for i in range(500)], "http://a.org/1": ["http://a.org/hub"]}
    pages, edges = frames(spark, {u: 200 for u in links}, links)
    graph = fr.store_graph(edges, pages, hub_links=50, buckets=4)
    parts = {r.src_url[-1] + str(r.part): r["count"] for r in graph.links.groupBy("src_url", "part").count().collect()}
    assert len(parts) == 11 and sum(parts.values()) == 501 and max(parts.values()) < 100
    seeds = spark.createDataFrame([("http://a.org/1", 0)], "url string, pos int")
    assert fr.bfs(seeds, graph).count() == 501


def test_a_level_does_not_shuffle_the_links(spark):
    urls, status, links = random_graph(6)
    graph = fr.store_graph(*reversed(frames(spark, status, links)), buckets=4)
    frontier = graph.pages.filter("status = 200").select("url", "parts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.follow(frontier)._jdf.queryExecution().executedPlan().toString()
        seen = frontier.select("url").distinct().join(graph.pages.select("url"), "url", "left_anti")
        alone = seen._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the only exchange lies above the frontier's scan, the links' scan comes after it
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("FileScan") < plan.rindex("FileScan")
    assert "SelectedBucketsCount: 4 out of 4" in plan and "Exchange" not in alone


def test_bfs_filters_links_not_seeds(spark):
    pages, edges = frames(spark, {"http://a.org/1": 200, "http://b.org/1": 200, "http://a.org/2": 200},
                          {"http://b.org/1": ["http://a.org/1", "http://b.org/2", "http://a.org/2"]})
    seeds = spark.createDataFrame([("http://b.org/1", 0)], "url string, pos int")
    got = fr.bfs(seeds, fr.plain_graph(edges, pages), allowed_domains=["a.org"], url_patterns=["/1$", "zzz"])
    assert sorted(r.url for r in got.collect()) == ["http://a.org/1", "http://b.org/1"]


def plain_workflow(seed, success, relevant, links, max_depth, max_urls):
    seen, level, depth = [seed], [seed], 0
    while level and (max_depth is None or depth < max_depth):
        depth += 1
        first = {}
        for url in level:
            for pos, v in enumerate(links[url] if relevant.get(url) else []):
                if v not in seen:
                    key = (host(v) != host(seed), pos, v)
                    first[v] = min(first.get(v, key), key)
        level = [v for _, _, v in sorted(first.values())]
        if max_urls is not None:
            level = level[:max(0, max_urls - len(seen))]
        seen += level
    ok = [u for u in seen if success.get(u)]
    return len(seen), sum(relevant[u] for u in ok), len(seen) - len(ok), len(seen)


@pytest.mark.parametrize("seed, max_depth, max_urls", [(1, None, None), (2, None, 8), (3, 2, None), (4, 1, 12), (5, None, 1), (6, 3, 5)])
def test_workflow(spark, seed, max_depth, max_urls):
    urls, status, links = random_graph(seed, 30)
    rng = random.Random(seed + 100)
    success = {u: s == 200 for u, s in status.items()}
    relevant = {u: success[u] and rng.random() < 0.8 for u in status}
    _, edges = frames(spark, status, links)
    states = spark.createDataFrame([(u, success[u], relevant[u]) for u in status], "url string, success boolean, relevant boolean")
    start = urls[:3]
    seeds = spark.createDataFrame([(u,) for u in start], "url string")
    got = {r.seed_url: tuple(r)[1:] for r in wf.run_workflow(seeds, states, edges, max_depth, max_urls).collect()}
    assert got == {u: plain_workflow(u, success, relevant, links, max_depth, max_urls) for u in start}


def test_workflow_numbers_urls_and_moves_lists(spark, monkeypatch):
    """pairs are numbers; hubs in parts, states that repeat and urls without a state all count."""
    monkeypatch.setattr(wf, "HUB_LINKS", 3)
    url = "http://a.org/{}".format
    links = {url(0): [url(i) for i in range(1, 12)], url(1): [url(0), url(2), "mailto:x", None], url(2): [url(90)]}
    edges = spark.createDataFrame([(u, i, v) for u, ls in links.items() for i, v in enumerate(ls + ls)], "src_url string, pos int, link string")
    states = [(url(0), True, True), (url(1), True, True), (url(1), True, False), (url(2), True, False), (url(3), False, None), (None, True, True)]
    frame = spark.createDataFrame(states, "url string, success boolean, relevant boolean")
    for some, extra in ((frame, 1), (frame.filter("relevant or url <> 'http://a.org/1'"), 0)):
        seeds = spark.createDataFrame([(url(0),), (url(1),), (url(1),), (None,)], "url string")
        got = sorted((tuple(r) for r in wf.run_workflow(seeds, some, edges).collect()), key=str)
        assert got == sorted([
            (url(0), 12 + extra, 2, 9, 12), (url(1), 12 + extra, 2, 9, 12), (None, 1, 0, 1, 0)], key=str)
    numbers = wf._number_urls(seeds, frame, edges, None)
    hubs, lists = wf._link_lists(edges.filter("link is not null").select(F.xxhash64("src_url").alias("src"), F.xxhash64("link").alias("target")))
    assert dict(numbers.dtypes)["code"] == "bigint" and hubs.count() == 2
    assert lists.agg(F.sum(F.size("targets"))).first()[0] == 11 + 3 + 1


def test_new_links_and_admission(spark):
    links = spark.createDataFrame(
        [("s", i, v) for i, v in enumerate(["http://b.org/1", "http://a.org/1", "ftp://a.org/2", "mailto:x", "http://a.org/3", "http://b.org/1", "http://c.org/1"])],
        "src_url string, pos int, link string",
    )
    seen = spark.createDataFrame([("http://a.org/3",)], "url string")
    none = seen.limit(0)
    fresh = fr.new_links(links, seen, none, ["a.org", "b.org"])
    assert sorted(r.pos for r in fresh.collect()) == [0, 1, 2, 5]
    assert [r.pos for r in fr.prioritize(fresh, "a.org").collect()] == [1, 2, 0, 5]
    queue = spark.createDataFrame([("http://q.org/",)], "url string")
    assert [r.url for r in fr.admit(queue, fresh, "a.org", seen, 3).collect()] == ["http://a.org/1", "ftp://a.org/2"]
    assert fr.admit(queue, fresh, "a.org", seen, 1).count() == 0


def test_admission_sorts_no_links(spark):
    """F8: the least place of a link is kept in a hash table; an unknown place comes first."""
    rows = [("http://a.org/1", 5), ("http://a.org/1", 3), ("http://b.org/1", 4), ("http://b.org/1", None), (None, 2)]
    links = spark.createDataFrame(rows, "link string, pos bigint")
    queue = spark.createDataFrame([("http://q.org/",)], "url string")
    out = fr.admit(queue, links, "a.org")
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("http://a.org/1", 0, 3), ("http://b.org/1", 1, None), (None, None, 2)], key=str)


def test_should_follow(spark):
    df = spark.createDataFrame([("http://a.org/x1",), ("http://b.org/x1",), ("http://a.org/y",)], "url string")
    def follow(*args):
        return [r.follow for r in fr.should_follow(df, *args).collect()]
    assert follow() == [True, True, True]
    assert follow(["a.org"]) == [True, False, True]
    assert follow(None, ["x\\d", "^https"]) == [True, True, False]
    assert follow(["a.org"], ["x\\d"]) == [True, False, False]


def test_process_pages_without_model(spark):
    text = "<p>" + "w" * 50 + "</p>"
    pages = spark.createDataFrame(
        [("http://a.org/1", text, 200), ("http://a.org/2", text, 500), ("http://a.org/3", "<p>x</p>", 200), ("http://a.org/4", None, 200)],
        "url string, html string, status int",
    )
    got = {r.url[-1]: (r.success, r.relevant, r.confidence) for r in wf.process_pages(pages, None).collect()}
    assert got == {"1": (True, True, 1.0), "2": (False, False, None), "3": (False, False, None), "4": (False, False, None)}

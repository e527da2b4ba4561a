"""Link frontier: filters, breadth-first expansion, queue admission."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import domain_of, scheme_of
from siftline.operators.ranking import tasks_of
from siftline.session import bucketed_table, cut_lineage

#: Links of a url above which they are dealt into parts.
HUB_LINKS = 100_000


def follow_condition(
    url: Column, allowed_domains: Iterable[str] | None = None, url_patterns: Iterable[str] | None = None
) -> Column:
    """C1 as a condition: allowed authority, then any pattern found."""
    ok = F.lit(True)
    if allowed_domains:
        ok = domain_of(url).isin(list(allowed_domains))
    if url_patterns:
        hit = F.lit(False)
        for pattern in url_patterns:
            hit = hit | url.rlike(pattern)
        ok = ok & hit
    return ok


def should_follow(
    df: DataFrame, allowed_domains: Iterable[str] | None = None,
    url_patterns: Iterable[str] | None = None, url: str = "url",
) -> DataFrame:
    """Add ``follow``."""
    return df.withColumn("follow", follow_condition(F.col(url), allowed_domains, url_patterns))


@dataclass(frozen=True)
class LinkGraph:
    """pages(url, status, parts) and links(src_url, part, pos, link).

    ``part`` deals the links of a hub into ``parts`` parts.  With ``buckets`` the pages lie
    in hash buckets of url and the links in those of (src_url, part), so that a level
    shuffles its frontier and never the links.
    """

    pages: DataFrame
    links: DataFrame
    buckets: int | None = None

    def store(self, level: DataFrame, keys: list[str]) -> DataFrame:
        """A level, cut from its lineage, where the next ones leave it out unmoved."""
        return bucketed_table(level, "level", keys, self.buckets) if self.buckets else cut_lineage(level, "level")

    def follow(self, frontier: DataFrame) -> DataFrame:
        """The links of the urls of (url, parts, ...) rows: those columns, pos and link."""
        part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        at = frontier.select("*", part).withColumnRenamed("url", "src_url")
        return at.join(self.links, ["src_url", "part"]).drop("part").withColumnRenamed("src_url", "url")


def _best_pages(pages: DataFrame) -> DataFrame:
    """A page stored more than once counts once, with its best status."""
    return pages.groupBy("url").agg(F.min_by("status", F.struct(F.col("status") != 200, "status")).alias("status"))


def plain_graph(edges: DataFrame, pages: DataFrame) -> LinkGraph:
    """The tables as they are: enough for a few levels, or for frontiers small enough to be
    sent to the links."""
    held = cut_lineage(_best_pages(pages).withColumn("parts", F.lit(1)), "pages")
    return LinkGraph(held, edges.select("src_url", F.lit(0).alias("part"), "pos", "link"))


def store_graph(edges: DataFrame, pages: DataFrame, hub_links: int = HUB_LINKS, buckets: int | None = None) -> LinkGraph:
    """Bucket edges(src_url, pos, link) and pages(url, status), for deep or repeated searches.

    ``edges`` is read twice and should be a stored table.  A url with more than
    ``hub_links`` links is a hub; a url that has links but no page row has no page here either.
    """
    buckets = buckets or tasks_of(edges)
    counts = edges.filter(F.col("src_url").isNotNull()).groupBy("src_url").agg(F.count(F.lit(1)).alias("n"))
    # stored, so that its true size decides how the links are joined with it
    hubs = cut_lineage(counts.filter(F.col("n") > hub_links).select("src_url", F.ceil(F.col("n") / hub_links).cast("int").alias("parts")), "hubs")
    whole = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("link"), whole).cast("int")
    dealt = edges.join(hubs, "src_url", "left").select("src_url", part.alias("part"), "pos", "link")
    held = _best_pages(pages).join(hubs.withColumnRenamed("src_url", "url"), "url", "left").select("url", "status", whole.alias("parts"))
    return LinkGraph(
        bucketed_table(held, "pages", ["url"], buckets), bucketed_table(dealt, "links", ["src_url", "part"], buckets), buckets
    )


def bfs(
    seeds: DataFrame, graph: LinkGraph, max_depth: int = 2, max_urls: int | None = None,
    allowed_domains: Iterable[str] | None = None, url_patterns: Iterable[str] | None = None,
) -> DataFrame:
    """Pages visited breadth-first from the seeds(url, pos).

    A url without a page row counts as failed.  Each visited url carries its path of
    positions from the seed; comparing paths reproduces the queue order, so no level has to
    be numbered.  One job per level; a level is reduced to one row per url with a map-side
    combined minimum, and the levels before it are left out one by one.
    Returns url, depth, status, path.
    """
    follow = follow_condition(F.col("link"), allowed_domains, url_patterns)
    level = seeds.select("url", F.array(F.col("pos").cast("bigint")).alias("path"))
    levels: list[DataFrame] = []
    used = 0
    for depth in range(max_depth + 1):
        fresh = level.groupBy("url").agg(F.min("path").alias("path"))
        for seen in levels:
            fresh = fresh.join(seen.select("url"), "url", "left_anti")
        if max_urls is not None:
            fresh = fresh.orderBy("path", "url").limit(max_urls - used)
        reached = graph.store(
            fresh.join(graph.pages, "url", "left").select(
                "url", F.lit(depth).alias("depth"), F.coalesce("status", F.lit(0)).alias("status"), "path", "parts"
            ),
            ["url"],
        )
        levels.append(reached)
        if depth == max_depth:
            break
        if max_urls is not None:
            used += reached.count()
            if used >= max_urls:
                break
        level = (
            graph.follow(reached.filter(F.col("status") == 200).select("url", "parts", "path"))
            .filter(follow)
            .select(F.col("link").alias("url"), F.concat("path", F.array(F.col("pos").cast("bigint"))).alias("path"))
        )
    return reduce(DataFrame.unionByName, levels).select("url", "depth", "status", "path")


def new_links(
    links: DataFrame, visited: DataFrame, queued: DataFrame, allowed_domains: Iterable[str] | None = None
) -> DataFrame:
    """Links with scheme and authority, allowed, neither visited nor queued.

    Any scheme is accepted here; order and duplicates are kept.
    """
    link = F.col("link")
    ok = (scheme_of(link) != "") & (domain_of(link) != "")
    if allowed_domains:
        ok = ok & domain_of(link).isin(list(allowed_domains))
    seen = visited.select(F.col("url").alias("link")).unionByName(
        queued.select(F.col("url").alias("link"))
    )
    return links.filter(ok).join(seen, "link", "left_anti").select(*links.columns)


def prioritize(links: DataFrame, seed_domain: str) -> DataFrame:
    """C4: add ``priority`` (0 for links of the seed domain) and order by it."""
    away = (domain_of(F.col("link")) != seed_domain).cast("int")
    return links.withColumn("priority", away).orderBy("priority", "pos")


def admit(
    queue: DataFrame, links: DataFrame, seed_domain: str, visited: DataFrame | None = None,
    max_queue_size: int | None = None,
) -> DataFrame:
    """The links added to the queue.

    Without a limit these are all different new links.  With one, the queue's
    length is counted first and the links up to the limit come in order.
    """
    seen = queue.select(F.col("url").alias("link"))
    if visited is not None:
        seen = seen.unionByName(visited.select(F.col("url").alias("link")))
    away = (domain_of(F.col("link")) != seed_domain).cast("int")
    # the priority follows from the link; a minimum of plain numbers is kept in a hash table,
    # one of structs would sort all links.  A place that is unknown comes first.
    first = (
        links.groupBy("link")
        .agg(F.min("pos").alias("_least"), F.max(F.col("pos").isNull()).alias("_unknown"))
        .select(F.col("link").alias("url"), away.alias("priority"), F.when(~F.col("_unknown"), F.col("_least")).alias("pos"))
    )
    fresh = first.join(seen.withColumnRenamed("link", "url"), "url", "left_anti")
    if max_queue_size is None:
        return fresh
    return fresh.orderBy("priority", "pos", "url").limit(max(max_queue_size - queue.count(), 0))

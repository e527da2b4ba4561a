"""Page extraction (X1-X11): one parse per page, all fields from it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import domain_of
from siftline.operators import page_dom as dom

_PARSED = (
    "title string, content string, publish_date string, page_title string, links array<string>"
)


#: Pages parsed before their fields are handed on.
PAGES_AT_ONCE = 64


def _parse_row(url: str, html: str | None, want: frozenset, min_length: int) -> tuple:
    if not html:
        return "", "", None, None, []
    try:
        page = dom.Page(html)
    except (AssertionError, ValueError):
        # markup the parser rejects counts as an empty page
        return "", "", None, None, []
    title = dom.title_of(page) if "title" in want else ""
    date = dom.publish_date_of(page) if "publish_date" in want else None
    head = next((page.text_of(i).strip() for i in page.elements("title")), None)
    links = dom.links_of(page, url) if "links" in want else []
    content = dom.content_of(page, min_length) if "content" in want else ""
    return title, content, date, head, links


def parse_pages(
    pages: DataFrame, keep: list[str], want: tuple[str, ...] = ("title", "content", "publish_date", "links"),
    min_content_length: int = 300,
) -> DataFrame:
    """Parse every page once; ``keep`` columns ride along, html is not emitted.

    ``want`` leaves out work that the caller does not use.
    """
    wanted = frozenset(want)
    columns = list(dict.fromkeys([*keep, "url"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ["title", "content", "publish_date", "page_title", "links"]
        for batch in batches:
            # a task holds the fields of few pages, however many a batch has
            for start in range(0, len(batch), PAGES_AT_ONCE):
                some = batch.iloc[start:start + PAGES_AT_ONCE]
                parsed = [_parse_row(u, h, wanted, min_content_length) for u, h in zip(some["url"], some["html"])]
                out = some[columns].reset_index(drop=True)
                yield pd.concat([out, pd.DataFrame(parsed, columns=fields)], axis=1)

    types = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    return pages.select(*columns, "html").mapInPandas(run, f"{types}, {_PARSED}")


def as_articles(parsed: DataFrame, now: str, extra: list[str] | None = None) -> DataFrame:
    """Parsed pages in extracted-article shape."""
    return parsed.select(
        "url",
        "title",
        "content",
        F.lit(now).alias("date_extracted"),
        F.struct("publish_date", domain_of(F.col("url")).alias("domain")).alias("metadata"),
        *(extra or []),
    )


def extract_articles(
    pages: DataFrame, now: str, min_content_length: int = 300, keep: list[str] | None = None
) -> DataFrame:
    """Title, content, publish date and domain of every page."""
    keep = keep or []
    parsed = parse_pages(pages, keep, ("title", "content", "publish_date"), min_content_length)
    return as_articles(parsed, now, keep)


def links_table(parsed: DataFrame, key: str = "url", http_only: bool = True) -> DataFrame:
    """(src_url, pos, link); duplicates and order kept."""
    rows = parsed.select(F.col(key).alias("src_url"), F.posexplode("links").alias("pos", "link"))
    if http_only:
        rows = rows.filter(F.col("link").startswith("http://") | F.col("link").startswith("https://"))
    return rows


def extract_links(pages: DataFrame, http_only: bool = True) -> DataFrame:
    """X10 straight from pages."""
    return links_table(parse_pages(pages, [], ("links",)), http_only=http_only)


def crawl_summary(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """X11: processed, successful, failed and extracted pages in one row."""
    with_text = extracted.filter(F.col("content") != "").select(F.count(F.lit(1))).scalar()
    return pages.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("status") == 200).alias("success"),
    ).select(
        "processed",
        "success",
        (F.col("processed") - F.col("success")).alias("failed"),
        with_text.alias("extracted"),
    )


SUMMARY_COLUMNS = ["depth", "status", "fetched_at", "has_content"]


def parse_crawl(pages: DataFrame) -> DataFrame:
    """Pages parsed once, with what ``summary_rows`` needs riding along."""
    has_content = F.col("html").isNotNull() & (F.col("html") != "")
    return parse_pages(pages.withColumn("has_content", has_content), SUMMARY_COLUMNS)


def summary_rows(parsed: DataFrame) -> DataFrame:
    """One summary row per crawled page; the title falls back to ``<title>``.

    ``parsed`` comes from ``parse_crawl``; a page crawled twice has two rows.
    """
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(F.col("page_title"))
    return parsed.select(
        "url", "depth", "status", F.col("fetched_at").alias("timestamp"), "has_content", title.alias("title")
    )

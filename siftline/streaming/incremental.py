"""Structured Streaming jobs: incremental scoring (ST1) and daily counts (ST2)."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import domain_of
from siftline.operators.articles import upsert_articles
from siftline.operators.model import LinearModel
from siftline.plans.workflow import process_pages, store_incidents
from siftline.session import cut_lineage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_pages(
    spark: SparkSession, path: str, schema: str, max_files_per_trigger: int = 1000,
    glob: str | None = None,
) -> DataFrame:
    """New page files as a stream.

    ``glob`` names what is read below ``path``: files, or folders of files.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    # braces make a plain name a pattern too, which may stand for a file as well as a folder
    return reader.parquet(f"{path.rstrip('/')}/{{{glob}}}" if glob else path)


def score_stream(
    pages: DataFrame, model: LinearModel | None, keep: list[str] | None = None, repeat_within: str = "7 days",
    arrived: str | None = None,
) -> DataFrame:
    """ST1, streaming half: pages extracted and scored, a url that repeats soon dropped.

    The html is parsed where it is read; only what was extracted is shuffled.  The state
    holds the urls of the last ``repeat_within`` and no others, so it does not grow with the
    stream.  A url that comes back later is passed on again and left to the merge.  Time is
    arrival, which no page is late for; ``arrived`` names a time column to be used instead,
    whose late rows are lost.
    """
    keep = list(keep or []) + ([arrived] if arrived else [])
    outcomes = process_pages(pages, model, keep=keep)
    clock = F.col(arrived) if arrived else F.current_timestamp()
    timed = outcomes.withColumn("arrived_at", clock).withWatermark("arrived_at", repeat_within)
    return timed.dropDuplicatesWithinWatermark(["url"]).drop("arrived_at")


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> list[dict]:
    """Process everything that has arrived, exactly once into a Parquet sink.

    State is kept in RocksDB, on the executors' disks and not in their memory.  Returns
    the progress of the triggers that were run.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)
    try:
        # the query keeps the settings it was started with
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start(sink)
        )
    finally:
        conf.set(name, before)
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def merge_scored(
    scored: DataFrame, articles: DataFrame, incidents: DataFrame, sources: DataFrame,
    tags: DataFrame, links: DataFrame, now: str, seq: str = "seq",
) -> dict[str, DataFrame]:
    """ST1, batch half: fold the sink into the tables.

    Of a url that stands in the sink more than once the row of smallest ``seq`` counts.
    Pages already stored are left out, so that running it again over the same sink, or
    over one that a later run has added to, stores nothing twice.
    """
    first = scored.groupBy("url").agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = cut_lineage(first.select("url", F.col(seq).alias("_first")), "repeated")
    scored = scored.join(repeated, "url", "left").filter(F.col("_first").isNull() | (F.col(seq) == F.col("_first"))).drop("_first")
    known_urls = incidents.select(F.col("source_reference").alias("url"))
    fresh = scored.join(known_urls, "url", "left_anti")
    rows, all_sources, all_tags, all_links = store_incidents(
        fresh, incidents, sources, tags, links, now, seq
    )
    new_articles = scored.filter("success").join(articles.select("url"), "url", "left_anti")
    records = new_articles.select(
        seq, "url", "title", "content", F.lit(now).alias("date_extracted"),
        F.struct("publish_date", domain_of(F.col("url")).alias("domain")).alias("metadata"),
    )
    merged, _ = upsert_articles(articles, records, now, seq)
    return {
        "articles": merged, "incidents": rows, "sources": all_sources, "tags": all_tags,
        "incident_tags": all_links,
    }


def daily_counts(stream: DataFrame, ts: str = "created_at", watermark: str = "1 day") -> DataFrame:
    """ST2, streaming half: incidents of every day that the watermark has closed.

    Rows that are late by less than the watermark count; the state holds open days only.
    """
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, "1 day"))
        .agg(F.count(F.lit(1)).alias("incidents"))
        .select(F.col("window.start").alias("day"), "incidents")
    )


def daily_totals(closed: DataFrame, rows: DataFrame, ts: str = "created_at") -> DataFrame:
    """ST2, batch half: the closed days of the sink, and the days after them counted now.

    The last closed day is known before the rows are read, so that the scan skips the
    files and row groups of closed days.
    """
    last = closed.agg(F.max("day")).first()[0]
    if last is not None:
        rows = rows.filter(F.col(ts) >= F.lit(last + timedelta(days=1)))
    still_open = (
        rows.filter(F.col(ts).isNotNull()).groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("incidents"))
        .select(F.col("window.start").alias("day"), "incidents")
    )
    return closed.select("day", "incidents").unionByName(still_open)

"""Exports and append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import labels as lb
from siftline.functions.text import crawl_key, domain_of
from siftline.operators.articles import labeled_export, search_articles
from siftline.operators.extract import as_articles, parse_crawl, summary_rows
from siftline.session import cut_lineage


def append_session(df: DataFrame, path: str, config_columns: list[str]) -> None:
    """Append crawl sessions; the config columns become one JSON text."""
    rest = [c for c in df.columns if c not in config_columns]
    df.select(*rest, F.to_json(F.struct(*config_columns)).alias("config")).write.mode("append").parquet(path)


def append_executions(df: DataFrame, path: str) -> None:
    """Append job executions."""
    df.write.mode("append").parquet(path)


def _filtered(df: DataFrame, filters: dict | None) -> DataFrame:
    args = dict(filters or {})
    args.setdefault("limit", None)
    return search_articles(df, **args)


def export_json(df: DataFrame, path: str, filters: dict | None = None) -> None:
    """Filtered search result as JSON lines, labels as an object; all rows unless
    ``filters`` gives a limit."""
    _filtered(df, filters).withColumn("labels", lb.parse_labels(F.col("labels"))) \
        .write.mode("overwrite").json(path)


# fields keep their blanks and line breaks; quotes are doubled
_CSV = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _write_csv(rows: DataFrame, path: str) -> bool:
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").options(**_CSV, emptyValue="", nullValue="").csv(path)
    return True


def read_csv(spark, path: str, schema: str) -> DataFrame:
    """Read a CSV export back, line breaks inside quoted fields included."""
    return spark.read.options(**_CSV, multiLine=True).schema(schema).csv(path)


def export_csv(df: DataFrame, path: str, filters: dict | None = None) -> bool:
    """Filtered search result as CSV, labels as JSON text; all rows unless ``filters``
    gives a limit, nothing is written for an empty result."""
    rows = _filtered(df, filters).withColumn("labels", F.to_json(lb.parse_labels(F.col("labels"))))
    return _write_csv(rows, path)


def export_labeled(df: DataFrame, path: str, fmt: str = "json") -> bool:
    """Labelled rows with their integer flag."""
    rows = labeled_export(df, fmt)
    if fmt == "csv":
        return _write_csv(
            rows.withColumn("labels", F.to_json(lb.parse_labels(F.col("labels")))), path
        )
    rows.withColumn("labels", lb.parse_labels(F.col("labels"))).write.mode("overwrite").json(path)
    return True


def write_crawl_outputs(pages: DataFrame, now: str, path: str) -> None:
    """Summary, raw html and extracted records below ``path``.

    One row per page keyed like a file of its own.  Pages are parsed once; both the
    summary and the records are written from that stored result.
    """
    parsed = cut_lineage(parse_crawl(pages), "parsed")
    summary_rows(parsed).write.mode("overwrite").json(f"{path}/summary")
    stored = pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))
    stored.select(crawl_key(F.col("url")).alias("key"), "url", "html").write.mode(
        "overwrite"
    ).parquet(f"{path}/html")
    as_articles(parsed, now).withColumn("key", crawl_key(F.col("url"))).withColumn(
        "domain", domain_of(F.col("url"))
    ).write.mode("overwrite").json(f"{path}/extracted")


def write_snapshot(df: DataFrame, path: str) -> None:
    """A status, workflow or job list snapshot as JSON."""
    df.write.mode("overwrite").json(path)

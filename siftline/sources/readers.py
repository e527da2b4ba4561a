"""Readers (S1, S3, S4) and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import schemas


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored crawl results; columns a store lacks get their fetched defaults."""
    raw = spark.read.parquet(path)
    defaults = {
        "depth": F.lit(0),
        "status": F.lit(200),
        "fetched_at": F.lit(None).cast("timestamp"),
    }
    columns = [F.col(c) if c in raw.columns else d.alias(c) for c, d in defaults.items()]
    return raw.select("url", "html", *columns)


def read_labeled_json(spark: SparkSession, path: str, fmt: str = "array") -> DataFrame:
    """S3: labelled articles from JSON files.

    ``labels`` and the top-level ``is_relevant`` arrive as JSON text, so that the
    type of each value can still be judged.  ``fmt`` tells whether a file is one
    ``array``, read by one task, or has one record in each of its ``lines``, which
    any number of tasks share.
    """
    if fmt not in ("array", "lines"):
        raise ValueError(f"Unsupported format: {fmt}")
    return spark.read.option("multiLine", fmt == "array").schema(schemas.LABELED_FILE).json(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped non-empty lines as ``text``."""
    stripped = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(stripped.alias("text")).filter(F.col("text") != "")

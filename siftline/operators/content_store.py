"""Keyed content store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import sanitize_key


def write_content(
    existing: DataFrame | None, df: DataFrame, now: str, id_field: str = "url",
    overwrite: bool = False, seq: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """Store records under their sanitised key.

    Without ``overwrite`` the first record of a key stays; with it the last one
    wins.  ``seq`` is the unique order number of the records.  Records without the id field are skipped.  Returns the new store
    (content_id, record columns, timestamp) and a one-row count of records taken.
    """
    valid = df.filter(F.col(id_field).isNotNull())
    stamped = valid.withColumn(
        "timestamp",
        F.coalesce(F.col("timestamp"), F.lit(now)) if "timestamp" in df.columns else F.lit(now),
    )
    keyed = stamped.withColumn("content_id", sanitize_key(F.col(id_field)))
    columns = [c for c in keyed.columns if c not in (seq, "content_id")]
    # decided on the key and the number alone, so that whole records are moved once
    best = F.max(seq) if overwrite else F.min(seq)
    winners = keyed.select("content_id", seq).groupBy("content_id").agg(best.alias(seq))
    incoming = keyed.join(winners, ["content_id", seq], "left_semi").select("content_id", *columns)
    saved = valid.agg(F.count(F.lit(1)).alias("saved"))
    if existing is None:
        return incoming, saved
    if overwrite:
        kept = existing.join(incoming.select("content_id"), "content_id", "left_anti")
        return kept.unionByName(incoming), saved
    added = incoming.join(existing.select("content_id"), "content_id", "left_anti")
    return existing.unionByName(added), saved


def read_content(store: DataFrame, content_id: str) -> DataFrame:
    """The record stored under a key (sanitised the same way)."""
    return store.filter(F.col("content_id") == sanitize_key(F.lit(content_id)))


def list_contents(store: DataFrame) -> DataFrame:
    """All content ids."""
    return store.select("content_id").distinct()

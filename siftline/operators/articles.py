"""Article table: writes (W1-W4), search and labelling (Q1-Q6), loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import labels as lb
from siftline.functions.text import contains_text
from siftline.operators.ranking import dense_ids, max_id, page_of
from siftline.operators.text_index import TextIndex
from siftline.schemas import ARTICLE_COLUMNS
from siftline.session import cut_lineage
from siftline.sources.keyed_table import KeyedTable


def _field(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """A column, or the default where it is missing or (with a default) null."""
    if name not in df.columns:
        return default if default is not None else F.lit(None).cast("string")
    return F.coalesce(F.col(name), default) if default is not None else F.col(name)


def normalize_incoming(incoming: DataFrame, now: str, seq: str = "seq") -> DataFrame:
    """Incoming records in article shape, records without url removed."""
    has_meta = "metadata" in incoming.columns
    empty = F.lit("")
    domain = F.coalesce(F.col("metadata.domain"), empty) if has_meta else empty
    # a record carrying metadata with a null date stores null, one without stores ''
    published = (
        F.when(F.col("metadata").isNull(), empty).otherwise(F.col("metadata.publish_date"))
        if has_meta else empty
    )
    return incoming.filter(F.col("url").isNotNull()).select(
        F.col(seq),
        "url",
        _field(incoming, "title", empty).alias("title"),
        _field(incoming, "content", empty).alias("content"),
        domain.alias("domain"),
        published.alias("publish_date"),
        _field(incoming, "date_extracted", empty).alias("date_extracted"),
        F.lit(now).alias("date_stored"),
        _field(incoming, "source", F.lit("crawler")).alias("source"),
        F.lit(0).alias("status"),
        _field(incoming, "labels", F.lit("{}")).alias("labels"),
    )


def upsert_articles(
    existing: DataFrame, incoming: DataFrame, now: str, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Insert or replace by url, last record wins.

    ``seq`` is the unique integer arrival order.  A replaced article gets a new
    id, status 0 and the labels of the new record.  Every accepted record takes
    an id, also one that a later record of the same batch replaces.  Returns the
    new table and a one-row count of accepted records.
    """
    rows = normalize_incoming(incoming, now, seq)
    winners = latest_ids(rows, max_id(existing), seq)
    kept = existing.select(*ARTICLE_COLUMNS).join(winners.select("url"), "url", "left_anti")
    latest = rows.join(winners, ["url", seq]).select(*ARTICLE_COLUMNS)
    merged = kept.select(*ARTICLE_COLUMNS).unionByName(latest)
    return merged, rows.agg(F.count(F.lit(1)).alias("added"))


def latest_ids(rows: DataFrame, start: Column | int, seq: str = "seq") -> DataFrame:
    """(url, seq, id): the last record of every url and its id.

    Made from (url, seq) alone; ids rise with ``seq``, so two maxima name the winner and
    copies of a hot url collapse before the shuffle.  Stored, so that its true size decides
    whether bodies and stored rows meet it where they are.
    """
    numbered = dense_ids(rows.select("url", seq), seq, start)
    return cut_lineage(numbered.groupBy("url").agg(F.max(seq).alias(seq), F.max("id").alias("id")), "winners")


def upsert_stored(table: KeyedTable, incoming: DataFrame, now: str, seq: str = "seq") -> list[int]:
    """W1 on a table in parts: only the parts with an incoming url are rewritten, and returned."""
    rows = normalize_incoming(incoming, now, seq)
    return table.merge(rows.join(latest_ids(rows, max_id(table.rows()), seq), ["url", seq]).drop(seq))


def insert_articles_strict(
    existing: DataFrame, incoming: DataFrame, now: str, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """As W1, but url, title and content must all be present."""
    complete = (
        F.col("url").isNotNull() & F.col("title").isNotNull() & F.col("content").isNotNull()
    )
    return upsert_articles(existing, incoming.filter(complete), now, seq)


def patch_articles(
    existing: DataFrame, patches: DataFrame, now: str, key: str = "id", seq: str | None = None
) -> DataFrame:
    """Change only the fields each patch supplies.

    ``patches`` has the key, ``fields array<string>`` naming the supplied columns
    (null is a legal new value) and those columns.  ``date_stored`` is refreshed
    by every non-empty patch.  With several patches per key the last one by
    ``seq`` wins, field by field; without ``seq`` a repeated key fails the job.
    """
    columns = [
        c for c in ARTICLE_COLUMNS if c in patches.columns and c not in ("id", key, "date_stored")
    ]
    order = F.col(seq) if seq else F.lit(0)
    given = {c: F.array_contains("fields", c) for c in columns}
    any_given = F.lit(False)
    for flag in given.values():
        any_given = any_given | flag
    touched = F.max(F.coalesce(any_given, F.lit(False)))
    if seq is None:
        repeated = F.raise_error(F.lit("several patches for one key need seq")).cast("boolean")
        touched = F.when(F.count(F.lit(1)) > 1, repeated).otherwise(touched)
    aggs = [touched.alias("_touched")]
    for c in columns:
        if c == "labels" and patches.schema[c].dataType.typeName() != "string":
            value = F.to_json(c)
        else:
            value = F.col(c)
        # wrapped in a struct: a supplied null must win over an earlier value
        aggs.append(F.max_by(F.struct(value.alias("v")), F.when(given[c], order)).alias(f"_p_{c}"))
    changes = patches.groupBy(key).agg(*aggs)
    joined = existing.join(changes, key, "left")
    out = []
    for c in ARTICLE_COLUMNS:
        if c in columns:
            new = F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v")).otherwise(F.col(c))
        elif c == "date_stored":
            new = F.when(F.coalesce("_touched", F.lit(False)), F.lit(now)).otherwise(F.col(c))
        else:
            new = F.col(c)
        out.append(new.alias(c))
    return joined.select(*out)


def delete_articles(existing: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """W4."""
    return existing.join(keys.select(key), key, "left_anti").select(*existing.columns)


def load_articles(
    df: DataFrame, only_labeled: bool = True, only_relevant: bool = False, limit: int | None = None
) -> DataFrame:
    """Articles in id order, optionally labelled or labelled relevant only."""
    out = df
    if only_labeled:
        out = out.filter(lb.is_labeled(F.col("labels")))
        if only_relevant:
            out = out.filter(lb.is_relevant_json(F.col("labels")))
    return page_of(df, out, limit=limit) if limit else out.orderBy("id")


def load_labeled_data(articles: DataFrame | None, fallback: DataFrame | None) -> DataFrame:
    """Labelled rows of the table, or of the file when the table has none.

    The file may carry a top-level ``is_relevant`` that overrides the labels.
    """
    if articles is not None:
        stored = articles.filter(lb.is_labeled(F.col("labels")))
        if not stored.isEmpty():
            return lb.resolve_label(stored)
    if fallback is None:
        raise ValueError("No labeled data found")
    direct = "is_relevant" if "is_relevant" in fallback.columns else None
    return lb.resolve_label(fallback, direct)


def _matching(
    df: DataFrame, domain: str | None, start_date: str | None, end_date: str | None,
    content_filter: str | None,
) -> DataFrame:
    """The filters given (empty means absent); dates compare as text."""
    if domain:
        df = df.filter(F.col("domain") == domain)
    if start_date:
        df = df.filter(F.col("date_extracted") >= start_date)
    if end_date:
        df = df.filter(F.col("date_extracted") <= end_date)
    if content_filter:
        df = df.filter(
            contains_text(F.col("title"), content_filter)
            | contains_text(F.col("content"), content_filter)
        )
    return df


def search_articles(
    df: DataFrame, domain: str | None = None, start_date: str | None = None,
    end_date: str | None = None, content_filter: str | None = None, limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    """Q1: filtered articles, newest first, one page (top-k, no full sort); without a limit
    all of them, unordered."""
    base = _matching(df, domain, start_date, end_date, None)
    hits = _matching(base, None, None, None, content_filter)
    if limit is None:
        return hits
    return page_of(base, hits, "date_extracted", True, limit, offset)


def search_results(df: DataFrame, **filters) -> DataFrame:
    """Q1 as handed to a caller: the page of ``search_articles`` with labels as an object."""
    return search_articles(df, **filters).withColumn("labels", lb.parse_labels(F.col("labels")))


def search_indexed(
    index: TextIndex, content_filter: str, domain: str | None = None, start_date: str | None = None,
    end_date: str | None = None, limit: int | None = 100, offset: int = 0,
) -> DataFrame:
    """Q1 over a stored index of title and content: only blocks that can match are read."""
    return search_results(
        index.candidates(content_filter), domain=domain, start_date=start_date, end_date=end_date,
        content_filter=content_filter, limit=limit, offset=offset,
    )


def count_articles(
    df: DataFrame, domain: str | None = None, start_date: str | None = None,
    end_date: str | None = None, content_filter: str | None = None,
) -> DataFrame:
    """Q2: number of articles under the same filters."""
    hits = _matching(df, domain, start_date, end_date, content_filter)
    return hits.agg(F.count(F.lit(1)).alias("total"))


def get_articles(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Q3: articles by id or url, labels parsed."""
    found = df.join(keys.select(key).distinct(), key, "left_semi")
    return found.withColumn("labels", lb.parse_labels(F.col("labels")))


def labeling_queue(df: DataFrame, labeled_ids: DataFrame | None = None, batch: int = 20) -> DataFrame:
    """Q4: newest unlabelled articles; ids done in this session are removed
    after the limit, so a batch may come out short."""
    unlabeled = F.col("labels").isNull() | F.col("labels").isin("{}", "")
    queue = page_of(df, df.filter(unlabeled), "date_extracted", True, batch)
    if labeled_ids is None:
        return queue
    return queue.join(labeled_ids.select("id"), "id", "left_anti")


def apply_labels(df: DataFrame, decisions: DataFrame, now: str, seq: str | None = None) -> DataFrame:
    """Q5: write manual labels (``decisions``: id, label 1/0) into the table."""
    label = F.struct(
        (F.col("label") != 0).alias("is_relevant"),
        F.lit("manual").alias("labeled_by"),
        F.lit(now).alias("labeled_date"),
    )
    columns = ["id"] + ([seq] if seq else [])
    patches = decisions.filter(F.col("label").isin(0, 1)).select(
        *columns, F.array(F.lit("labels")).alias("fields"), F.to_json(label).alias("labels")
    )
    return patch_articles(df, patches, now, "id", seq)


def labeling_stats(decisions: DataFrame, duration_seconds: float | None = None) -> DataFrame:
    """Q6: totals of a labelling session; label -1 is a skip."""
    y = F.col("label")
    stats = decisions.agg(
        F.count_if(y.isin(0, 1)).alias("total_labeled"),
        F.count_if(y == 1).alias("labeled_relevant"),
        F.count_if(y == 0).alias("labeled_not_relevant"),
        F.count_if(y == -1).alias("skipped"),
    )
    return stats.select(
        "*",
        F.lit(duration_seconds).cast("double").alias("duration_seconds"),
        F.when(
            F.col("total_labeled") > 0, F.col("labeled_relevant") * 100.0 / F.col("total_labeled")
        ).alias("relevance_percentage"),
    )


def labeled_export(df: DataFrame, fmt: str = "json") -> DataFrame:
    """The labelled rows as exported; CSV leaves the content out."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"Unsupported format: {fmt}")
    rows = (
        df.filter(lb.is_labeled(F.col("labels")))
        .withColumn("is_relevant", lb.flag_or_minus_one(F.col("labels")))
        .orderBy("id")
    )
    return rows.drop("content") if fmt == "csv" else rows

"""Incident tables: writes (W14-W18), views (I1-I7) and dashboard data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.dates import format_datetime
from siftline.functions.text import contains_text, truncate_words
from siftline.operators.ranking import dense_ids, lookup, max_id, page_of
from siftline.schemas import INCIDENT_COLUMNS
from siftline.session import cut_lineage


def _stamp(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def create_tags(tags: DataFrame, names: DataFrame, now: str, seq: str = "seq") -> DataFrame:
    """Add the names not stored yet; ids follow first appearance.

    Names are deduplicated with a map-side combined aggregate, then only the new
    ones are numbered.
    """
    ties = ["pos"] if "pos" in names.columns else []
    order = F.struct(seq, *ties)
    new = (
        names.filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.min(order).alias("_first"))
        .select("name", "_first.*")
        .join(tags.select("name"), "name", "left_anti")
    )
    numbered = dense_ids(new, seq, max_id(tags), ties=ties + ["name"])
    return tags.unionByName(numbered.select("id", "name", _stamp(now).alias("created_at")))


def get_or_create_sources(
    sources: DataFrame, incoming: DataFrame, now: str, name: str = "domain", seq: str = "seq"
) -> DataFrame:
    """One source per domain name; the url is that of the page which first
    introduced it."""
    new = (
        incoming.groupBy(F.col(name).alias("name"))
        .agg(F.min(F.struct(seq, "url")).alias("_first"))
        .select("name", "_first.*")
        .join(sources.select("name"), "name", "left_anti")
    )
    numbered = dense_ids(new, seq, max_id(sources), ties=["name"])
    at = _stamp(now)
    return sources.unionByName(
        numbered.select("id", "name", "url", at.alias("created_at"), at.alias("updated_at"))
    )


def hold_rows(incoming: DataFrame) -> DataFrame:
    """The rows, stored once, with a number ``_row``: ids, sources and tags are then decided on
    narrow columns and the bodies move once."""
    return cut_lineage(incoming.withColumn("_row", F.monotonically_increasing_id()), "incoming")


def number_incidents(incidents: DataFrame, held: DataFrame, columns: list[str], seq: str = "seq") -> DataFrame:
    """(_row, seq, *columns, id) of the held rows with a title; ids follow ``seq``."""
    narrow = held.filter(F.col("title").isNotNull()).select("_row", seq, *columns)
    return dense_ids(narrow, seq, max_id(incidents), ties=["_row"])


def add_incidents(
    incidents: DataFrame, tags: DataFrame, links: DataFrame, held: DataFrame, numbered: DataFrame,
    now: str, seq: str = "seq",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incidents, tags and links with the held rows; ``numbered`` has their _row, id, source_id and tags."""
    at = _stamp(now)
    bodies = held.select("_row", "title", "description", "source_reference")
    rows = numbered.select("_row", "id", "source_id").join(bodies, "_row").select(
        "id", "title", "description", "source_id", "source_reference",
        at.alias("created_at"), at.alias("updated_at"),
    )
    named = numbered.select(
        F.col("id").alias("incident_id"), seq, F.posexplode(F.array_distinct("tags")).alias("pos", "name")
    )
    all_tags = create_tags(tags, named, now, seq)
    # most incidents may share one tag
    new_links = lookup(
        named.select("incident_id", "name"), all_tags.select(F.col("id").alias("tag_id"), "name"), "name"
    ).select("incident_id", "tag_id")
    return incidents.unionByName(rows), all_tags, links.unionByName(new_links)


def create_incidents(
    incidents: DataFrame, tags: DataFrame, links: DataFrame, incoming: DataFrame, now: str,
    seq: str = "seq",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add incidents with get-or-create tags.

    ``incoming``: seq, title, description, source_id, source_reference and
    ``tags array<string>``.  No uniqueness on the reference: the same page twice
    gives two incidents.  Returns incidents, tags and link rows.
    """
    held = hold_rows(incoming)
    numbered = number_incidents(incidents, held, ["source_id", "tags"], seq)
    return add_incidents(incidents, tags, links, held, numbered, now, seq)


def patch_incidents(
    incidents: DataFrame, tags: DataFrame, links: DataFrame, patches: DataFrame, now: str,
    seq: str = "seq",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Title changes when non-empty, other fields when not null, tags (when
    given, also an empty list) replace the whole set; ``updated_at`` is set.

    With several patches per incident the last effective value wins per field.
    """
    fields = ("title", "description", "source_id", "source_reference")
    aggs = []
    for c in fields:
        usable = F.col(c).isNotNull() & (F.col(c) != "") if c == "title" else F.col(c).isNotNull()
        aggs.append(F.max_by(c, F.when(usable, F.col(seq))).alias(f"_p_{c}"))
    aggs.append(F.max_by("tags", F.when(F.col("tags").isNotNull(), F.col(seq))).alias("_p_tags"))
    aggs.append(F.max(seq).alias(seq))
    known = patches.join(incidents.select("id"), "id", "left_semi")
    changes = known.groupBy("id").agg(*aggs)
    out = incidents.join(changes.drop("_p_tags"), "id", "left").select(
        "id",
        *[F.coalesce(f"_p_{c}", c).alias(c) for c in fields],
        "created_at",
        F.when(F.col(seq).isNotNull(), _stamp(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    # every given tag list may create tags, also one a later patch replaces
    mentioned = known.select(seq, F.posexplode("tags").alias("pos", "name"))
    all_tags = create_tags(tags, mentioned, now, seq)
    retagged = changes.filter(F.col("_p_tags").isNotNull()).select(
        F.col("id").alias("incident_id"), "_p_tags"
    )
    kept = links.join(retagged.select("incident_id"), "incident_id", "left_anti")
    fresh = (
        retagged.select("incident_id", F.explode(F.array_distinct("_p_tags")).alias("name"))
        .join(all_tags.select(F.col("id").alias("tag_id"), "name"), "name")
        .select("incident_id", "tag_id")
    )
    return out, all_tags, kept.select("incident_id", "tag_id").unionByName(fresh)


def delete_incidents(
    incidents: DataFrame, links: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove incidents and their link rows."""
    gone = ids.select("id")
    return (
        incidents.join(gone, "id", "left_anti").select(*incidents.columns),
        links.join(gone.withColumnRenamed("id", "incident_id"), "incident_id", "left_anti")
        .select(*links.columns),
    )


def tags_by_incident(tags: DataFrame, links: DataFrame) -> DataFrame:
    """Tag list per incident, sorted by tag id (bounded by the incident's tags)."""
    named = links.join(
        tags.select(F.col("id").alias("tag_id"), "name"), "tag_id"
    ).select("incident_id", F.struct(F.col("tag_id").alias("id"), "name").alias("tag"))
    return named.groupBy("incident_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))


def incident_view(
    incidents: DataFrame, sources: DataFrame, tags: DataFrame, links: DataFrame
) -> DataFrame:
    """Incident with nested source and tag list (empty when untagged)."""
    src = sources.select(
        F.col("id").alias("source_id"), F.struct("id", "name", "url").alias("source")
    )
    tagged = tags_by_incident(tags, links).withColumnRenamed("incident_id", "id")
    no_tags = F.array().cast("array<struct<id:bigint,name:string>>")
    return (
        incidents.join(src, "source_id", "left")
        .join(tagged, "id", "left")
        .select(*INCIDENT_COLUMNS, "source", F.coalesce("tags", no_tags).alias("tags"))
    )


def get_incident(
    incidents: DataFrame, sources: DataFrame, tags: DataFrame, links: DataFrame, incident_id: int
) -> DataFrame:
    """The view of one incident; no row when absent."""
    one = incidents.filter(F.col("id") == incident_id)
    return incident_view(one, sources, tags, links.filter(F.col("incident_id") == incident_id))


def filter_incidents(
    incidents: DataFrame, tags: DataFrame, links: DataFrame, source_id: int | None = None,
    tag_name: str | None = None,
) -> DataFrame:
    """Incidents of a source and/or carrying a tag (0 and '' mean no filter)."""
    out = incidents
    if source_id:
        out = out.filter(F.col("source_id") == source_id)
    if tag_name:
        wanted = tags.filter(F.col("name") == tag_name).select(F.col("id").alias("tag_id"))
        tagged = links.join(wanted, "tag_id", "left_semi").select(F.col("incident_id").alias("id"))
        out = out.join(tagged, "id", "left_semi")
    return out


def list_incidents(
    incidents: DataFrame, sources: DataFrame, tags: DataFrame, links: DataFrame,
    source_id: int | None = None, tag_name: str | None = None, page: int = 1, per_page: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """One page, newest first, and its page facts.

    The page is found on (created_at, id) alone; only its rows are then joined
    with source and tags.
    """
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page must be >= 1 and per_page between 1 and 100")
    hits = filter_incidents(incidents, tags, links, source_id, tag_name)
    # stored: source and tags are both looked up for these rows
    rows = cut_lineage(page_of(incidents, hits, "created_at", True, per_page, (page - 1) * per_page), "page")
    # at most per_page (100) ids
    ids = rows.select(F.col("id").alias("incident_id"))
    page_links = links.join(F.broadcast(ids), "incident_id", "left_semi")
    view = incident_view(rows, sources, tags, page_links)
    items = view.orderBy(F.desc("created_at"), "id").limit(per_page)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    info = total.select(
        "total",
        F.lit(page).alias("page"),
        F.lit(per_page).alias("per_page"),
        F.ceil(F.col("total") / per_page).cast("bigint").alias("pages"),
    )
    return items, info


def recent_incidents(
    incidents: DataFrame, sources: DataFrame, tags: DataFrame, links: DataFrame, limit: int = 10
) -> DataFrame:
    """I4: the newest incidents."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    return list_incidents(incidents, sources, tags, links, page=1, per_page=limit)[0]


def search_incidents(incidents: DataFrame, sources: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """Keyword in title, description or source name (ASCII case-insensitive)."""
    if len(q) < 2:
        raise ValueError("q needs at least two characters")
    rows = incidents.select("id", "title", "description", "source_id")
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    matching = names.filter(contains_text(F.col("source_name"), q)).select("source_id", F.lit(True).alias("matches"))
    own = contains_text(F.col("title"), q) | contains_text(F.col("description"), q)
    hits = rows.select("id", "source_id", own.alias("own")).join(matching, "source_id", "left")
    page = page_of(rows, hits.filter(F.col("own") | F.col("matches")), limit=limit)
    if limit is not None:
        # stored: no more than ``limit`` rows, and so many names
        page = cut_lineage(page, "page")
        names = F.broadcast(names.join(F.broadcast(page.select("source_id")), "source_id", "left_semi"))
    return page.join(names, "source_id", "left").select("id", "title", "description", "source_name")


def list_sources(sources: DataFrame) -> DataFrame:
    """I6."""
    return sources.select("id", "name", "url")


def get_source(sources: DataFrame, source_id: int) -> DataFrame:
    return list_sources(sources.filter(F.col("id") == source_id))


def list_tags(tags: DataFrame) -> DataFrame:
    """I7."""
    return tags.select("id", "name")


def get_tag(tags: DataFrame, tag_id: int) -> DataFrame:
    return list_tags(tags.filter(F.col("id") == tag_id))


def dashboard_kpis(incidents: DataFrame, sources: DataFrame, tags: DataFrame) -> DataFrame:
    """Three totals in one row."""
    def total(df):
        return df.select(F.count(F.lit(1))).scalar()

    return incidents.agg(F.count(F.lit(1)).alias("total_incidents")).select(
        "total_incidents", total(sources).alias("total_sources"), total(tags).alias("total_tags")
    )


def newest(incidents: DataFrame, limit: int | None) -> DataFrame:
    """Restrict charts to the newest incidents when a limit is given."""
    if limit is None:
        return incidents
    return incidents.orderBy(F.desc("created_at"), "id").limit(limit)


def incidents_by_source(
    incidents: DataFrame, sources: DataFrame, recent_limit: int | None = None
) -> DataFrame:
    """Incidents per source, zero-filled (counted before the join)."""
    counts = (
        newest(incidents, recent_limit)
        .filter(F.col("source_id").isNotNull())
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("incidents"))
    )
    return sources.select(F.col("id").alias("source_id"), "name").join(
        counts, "source_id", "left"
    ).select("source_id", "name", F.coalesce("incidents", F.lit(0)).alias("incidents"))


def incidents_timeline(
    incidents: DataFrame, today: str, days: int = 30, recent_limit: int | None = None
) -> DataFrame:
    """D3: incidents per UTC day, ending today, zero-filled."""
    last = dt.date.fromisoformat(today)
    first = last - dt.timedelta(days=days - 1)
    end = last + dt.timedelta(days=1)
    in_range = (F.col("created_at") >= _stamp(first.isoformat())) & (
        F.col("created_at") < _stamp(end.isoformat())
    )
    counts = (
        newest(incidents, recent_limit)
        .filter(in_range)
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("incidents"))
    )
    spark = incidents.sparkSession
    calendar = spark.range(days).select(
        F.date_add(F.lit(first.isoformat()).cast("date"), F.col("id").cast("int")).alias("day")
    )
    return calendar.join(counts, "day", "left").select(
        "day",
        F.date_format("day", "MMM d").alias("label"),
        F.coalesce("incidents", F.lit(0)).alias("incidents"),
    )


def recent_display(view: DataFrame) -> DataFrame:
    """The recent-incident list as shown, missing source as ``Unknown``."""
    return view.select(
        "id",
        "title",
        F.coalesce("source.name", F.lit("Unknown")).alias("source_name"),
        format_datetime(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("created"),
        F.array_join(F.transform("tags", lambda t: t["name"]), ", ").alias("tag_names"),
    )


def search_display(results: DataFrame) -> DataFrame:
    """Search hits as shown; empty values get their placeholder."""
    def shown(col, placeholder):
        return F.when(F.col(col).isNull() | (F.col(col) == ""), F.lit(placeholder))

    return results.select(
        "id",
        "title",
        shown("source_name", "Unknown").otherwise(F.col("source_name")).alias("source_name"),
        shown("description", "No description")
        .otherwise(truncate_words(F.col("description")))
        .alias("description"),
    )

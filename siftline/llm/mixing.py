"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import SPACE_RUN, with_text, words_of
from siftline.session import cut_lineage

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
BLOCK_TOKENS = 16
#: Words of a shard; a large source is cut into many shards of about this size.
SHARD_TOKENS = 1_000_000
SEED = "mix-1"


def seeded(*parts: Column) -> Column:
    """A number of 32 bits from the md5 of the parts; the same in Spark and in SQL."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame, total_share: float = TOTAL_SHARE, repeats: int = MAX_REPEATS, weights: tuple = WEIGHTS) -> DataFrame:
    """Add weight and ``target`` to (source, source_size), one row per source.

    Sources by code point, null last, get the weights in turn.  Targets share
    ``total_share`` of all words by weight; a source whose share passes ``repeats`` times
    its size stops there.  With sources sorted by the level (words per weight) at which
    they fill up, the common level is the first at which the rest of the total, divided
    by the rest of the weights, fills no further source: one window, no iteration.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    df = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("double"))
    df = df.withColumn("_cap", F.col("source_size") * float(repeats))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.select(
        "*", (F.sum("source_size").over(Window.partitionBy()) * float(total_share)).alias("_total"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_full"),
        F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_rest"),
    )
    level = (F.col("_total") - F.col("_full")) / F.col("_rest")
    df = df.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    df = df.withColumn("_level", F.max("_level").over(Window.partitionBy()))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return df.select(*sources.columns, F.col("_w").alias("weight"), target.alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: str, by: list[str], order: list[str]) -> DataFrame:
    """Add ``quota``: the ``seats`` of each group ``by``, given one by one to the party with
    the highest quotient ``votes / (2 * held + 1)``; ties go by ``order``.

    Seats that are certain are set at once: with ``n`` parties and ``v`` votes in all, a
    party gets at least ``votes * (seats - n / 2) / v`` rounded and at most
    ``votes * (seats + n / 2) / v`` rounded.  Only the seats between, about two per
    party, are ranked by quotient.
    """
    group = Window.partitionBy(*by)
    df = parties.select("*", F.count("*").over(group).alias("_n"), F.sum(votes).over(group).cast("double").alias("_v"))
    share = lambda shift: F.floor(F.when(F.col("_v") > 0, F.col(votes) * F.greatest(F.lit(0.0), F.col(seats) + shift * F.col("_n") / 2) / F.col("_v")).otherwise(0.0) + 0.5)
    df = df.withColumn("_low", F.least(share(-1), F.col(seats))).withColumn("_high", share(1))
    df = df.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    tried = df.where("_high > _low").select("*", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_held"))
    by_quotient = group.orderBy((F.col(votes) / (2 * F.col("_held") + 1)).desc(), *order, "_held")
    won = tried.withColumn("_r", F.row_number().over(by_quotient)).where("_r <= _open")
    keys = list(dict.fromkeys(by + order))
    won = won.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.count("*").alias("_won"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(won, same, "left").select(*parties.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", row: str | None = None, block: int = BLOCK_TOKENS, shard: int = SHARD_TOKENS) -> DataFrame:
    """One narrow row per document: size, source_size, target and the blocks taken of it.

    A source's words, in shards of about ``shard`` words and there in seeded order of the
    documents, are one run of blocks of ``block`` words each.  Sainte-Lague gives the
    sources blocks by target, then each source's shards blocks by their words.  A shard
    with quota ``q`` of ``m`` blocks takes every block ``q // m`` times and the first
    ``q % m`` of its seeded order once more, so at most one document a shard is cut, at its
    end.  ``copies`` counts a document's whole copies, ``part`` the words taken once more
    from its start, ``taken`` all words.  ``row`` names a column to carry along, as ``row``.

    Null texts have size 0; null sources are one source, the last; rows that are equal in
    all of id, source and text are interchangeable.  Reruns agree.  An empty table gives
    an empty result.
    """
    sized = docs.select(
        *([F.col(row).alias("row")] if row else []), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.size(words_of(F.col(text))).cast("long").alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5"),
    )
    sized = cut_lineage(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(totals).withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long"))
    plan = plan.withColumn("_all", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    plan = sainte_lague(plan, "target", "_all", [], ["source"]).withColumnRenamed("quota", "_blocks")
    plan = cut_lineage(plan.drop("_all"), "targets")
    rows = sized.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select(
        *(["row"] if row else []), "doc_id", "d.source", "size", "text_md5", "source_size", "target", "_blocks", "_shards",
        seeded(F.col("doc_id"), F.col("text_md5")).alias("_seed"),
    ).withColumn("shard", F.pmod(F.col("_seed"), F.col("_shards")))
    run = Window.partitionBy("source", "shard").orderBy("_seed", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0).cast("long")))
    return _with_quotas(rows.drop("_seed", "_shards"), block)


def _with_quotas(rows: DataFrame, block: int) -> DataFrame:
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("_tokens"), F.first("_blocks").alias("_blocks"))
    shards = sainte_lague(shards, "_tokens", "_blocks", ["source"], ["shard"])
    shards = shards.withColumn("_m", F.greatest(F.lit(1), F.ceil(F.col("_tokens") / block)).cast("long"))
    shards = shards.withColumn("quota", F.least(F.col("quota"), F.col("_m") * MAX_REPEATS))
    at = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_k"), "_m", "quota")
    df = rows.join(at, F.expr("source <=> _s and shard = _k")).drop("_s", "_k")
    df = df.withColumn("copies", F.floor(F.col("quota") / F.col("_m")))
    left = F.pmod(F.col("quota"), F.col("_m")) * block - F.col("start")
    df = df.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    return df.withColumn("taken", F.col("size") * F.col("copies") + F.col("part")).drop("_blocks", "_m", "quota", "text_md5")


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", n_chars: str = "n_chars", **sizes) -> DataFrame:
    """The mixed documents, columns as in ``docs``.

    A document appears once per whole copy, its text unchanged, and once more with its
    first ``part`` words, white space between them as it was, where ``part`` is above 0.
    """
    held = cut_lineage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-in")
    view = held.select("row", *(F.col("doc")[c].alias(n) for c, n in ((text, "text"), (source, "source"), (doc_id, "doc_id"))))
    mix = mix_sources(view, row="row", **sizes).where("taken > 0")
    words = F.array_repeat(F.col("size"), F.col("copies").cast("int"))
    words = F.when(F.col("part") > 0, F.array_append(words, F.col("part"))).otherwise(words)
    out = held.join(mix.select("row", "size", F.explode(words).alias("words")), "row")
    whole = F.col("doc")[text]
    pieces = F.regexp_extract_all(whole, F.lit(f"{SPACE_RUN[:-1]}*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    cut = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), ""), f"^{SPACE_RUN}", "")
    return with_text(out, docs, text, F.when(F.col("words") == F.col("size"), whole).otherwise(cut), n_chars)


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
    md5(coalesce(text, '')) AS h FROM documents
), tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) AS w, source_size * 2.0::DOUBLE AS cap FROM tot
), l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fil,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source)
), lv AS (SELECT max(CASE WHEN (total - fil) / rest * w <= cap THEN (total - fil) / rest END) AS lvl FROM l
), t AS (SELECT source, source_size, least(cap, coalesce(lvl * w, cap)) AS target, greatest(1, ceil(source_size / {SHARD_TOKENS}::DOUBLE))::BIGINT AS ns FROM w, lv
), seats AS (SELECT round(sum(target) / {BLOCK_TOKENS})::BIGINT AS n FROM t
), won AS (
  SELECT source, count(*) AS q FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source IS NULL, source, k) AS r FROM t, seats, LATERAL (SELECT unnest(range(0, n)) AS k) z
  ), seats WHERE r <= n GROUP BY source
), placed AS (
  SELECT s.*, t.source_size, t.target, t.ns, coalesce(won.q, 0) AS sq,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || h), 1, 8))::BIGINT AS seed
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON s.source IS NOT DISTINCT FROM won.source
), run AS (
  SELECT *, seed % ns AS shard, coalesce(sum(size) OVER (PARTITION BY source, seed % ns ORDER BY seed, doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM placed
), sh AS (SELECT source, shard, sum(size)::BIGINT AS tokens, min(sq) AS sq, greatest(1, ceil(sum(size) / {BLOCK_TOKENS}::DOUBLE))::BIGINT AS m FROM run GROUP BY source, shard
), shwon AS (
  SELECT source, shard, count(*) AS q FROM (
    SELECT source, shard, sq, row_number() OVER (PARTITION BY source ORDER BY tokens::DOUBLE / (2 * k + 1) DESC, shard, k) AS r FROM sh, LATERAL (SELECT unnest(range(0, sq)) AS k) z
  ) WHERE r <= sq GROUP BY source, shard
), quota AS (
  SELECT sh.*, least(coalesce(q, 0), {MAX_REPEATS} * m) AS q
  FROM sh LEFT JOIN shwon ON sh.source IS NOT DISTINCT FROM shwon.source AND sh.shard = shwon.shard
)
SELECT r.doc_id, r.source, r.size, r.source_size, r.target,
  (r.size * (q // m) + greatest(0, least(r.size, (q % m) * {BLOCK_TOKENS} - r.st)))::BIGINT AS taken
FROM run r JOIN quota q ON r.source IS NOT DISTINCT FROM q.source AND r.shard = q.shard
"""
OUTPUT = ["doc_id", "source", "size", "source_size", "target", "taken"]

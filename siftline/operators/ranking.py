"""Order-dependent steps without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut_lineage

#: Keys a lookup may send to every task.
HOT_KEYS = 1024


def tasks_of(df: DataFrame) -> int:
    """Partitions of a shuffle, the number of groups that merge candidates or counts."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense_ids(
    df: DataFrame, seq: str, start: Column | int = 0, id_col: str = "id", ties: list[str] | None = None
) -> DataFrame:
    """Add ``start + 1, start + 2, ...`` in order of the integer column ``seq``.

    Equal to one global ``row_number()``.  The rows are dealt out by ranges of ``seq``,
    which are even however sparse the numbers are, and stored with their place in their
    range; only one count per range is summed up globally.  Stored, because a range that is
    computed again could be cut elsewhere.
    """
    order = [F.col(seq)] + [F.col(c) for c in ties or []]
    ranged = df.repartitionByRange(tasks_of(df), *order).sortWithinPartitions(*order)
    placed = ranged.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    held = cut_lineage(placed, "ranges")
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # one row per range
    offsets = F.broadcast(sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before")))
    base = start if isinstance(start, Column) else F.lit(start)
    return (
        held.join(offsets, "_range")
        .withColumn(id_col, (base + F.col("_before") + F.col("_place") + 1).cast("bigint"))
        .drop("_range", "_place", "_before")
    )


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join with a table of unique keys, of which some may hold most of the rows.

    The rows are counted per key, combined map-side, and only keys in use are looked up.
    Keys of more than one in HOT_KEYS rows, so fewer than HOT_KEYS keys, are sent to every
    task; the other rows are joined by key.  Null keys find nothing.  ``df`` is read three
    times and should be a stored, narrow table.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = cut_lineage(counts.join(table, key), "lookup")
    hot = F.col("_n") * HOT_KEYS > found.select(F.sum("_n")).scalar()
    sent = found.filter(hot).drop("_n")
    rest = df.join(F.broadcast(sent.select(key)), key, "left_anti")
    by_key = rest.join(found.filter(~hot).drop("_n"), key)
    return df.join(F.broadcast(sent), key).unionByName(by_key)


def page_of(
    base: DataFrame, hits: DataFrame, by: str = "id", descending: bool = False, limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    """``limit`` rows of ``base`` after ``offset``, ordered by ``by`` and then id.

    ``hits`` are the rows of ``base`` that qualify.  The page is found first, on
    the order column and the id alone: every task keeps its best candidates, keyed
    groups merge them, one task orders what is left.  The whole rows are then read
    by id.  The plan is lazy and the same at every size.  Without a limit all
    qualifying rows come back, in no order.
    """
    order = [F.desc(by) if descending else F.asc(by)] + ([F.asc("id")] if by != "id" else [])
    narrow = hits.select(F.col("id"), F.col(by).alias(by)) if by != "id" else hits.select("id")
    if limit is None:
        return base.join(narrow.select("id"), "id", "left_semi").select(*base.columns)
    group = F.pmod(F.xxhash64("id"), F.lit(tasks_of(base)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    best = narrow.withColumn("_rank", rank).filter(F.col("_rank") <= limit + offset).drop("_rank")
    ordered = best.orderBy(*order)
    page = (ordered.offset(offset) if offset else ordered).limit(limit).select("id")
    picked = base.join(page, "id", "left_semi").select(*base.columns)
    # no more rows than this are left; with a limit they are ordered without sampling first
    return picked.orderBy(*order).limit(limit)


def max_id(df: DataFrame, col: str = "id") -> Column:
    """Largest id of a table as a scalar subquery, 0 when empty."""
    return df.select(F.coalesce(F.max(col), F.lit(0)).cast("bigint")).scalar()


def hash_cuts(df: DataFrame, group: str, hash_col: str, take: dict[int, int]) -> dict[int, str | None]:
    """The ``take[g]``-th smallest hex hash of every group ``g``, exactly.

    Counts per 4-digit hash prefix (65,536 at most per group) find the prefix
    that holds the cut; only the rows sharing that prefix are then ordered.  The
    returned literals turn "the first n rows by hash" into a row-local filter,
    so the wide rows are neither shuffled nor ranked.
    """
    narrow = df.select(F.col(group).alias("g"), F.col(hash_col).alias("h"))
    counts = narrow.groupBy("g", F.substring("h", 1, 4).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )
    wanted = {key: int(n) for key, n in take.items() if n > 0}
    cuts: dict[int, str | None] = dict.fromkeys(take)
    if not wanted:
        return cuts
    want = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    # one row per group: the prefix holding its cut and the rows left to take there
    holders = (
        counts.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("prefix")))
        .withColumn("want", want[F.col("g")])
        .filter(F.col("upto") >= F.col("want"))
        .groupBy("g")
        .agg(F.min_by(F.struct("prefix", (F.col("want") - F.col("upto") + F.col("n")).alias("left")), "prefix").alias("cut"))
        .select("g", "cut.*")
        .collect()
    )
    in_prefix = F.lit(False)
    left = F.lit(None).cast("bigint")
    for h in holders:
        here = (F.col("g") == h["g"]) & F.col("h").startswith(h["prefix"])
        in_prefix = in_prefix | here
        left = F.when(here, F.lit(h["left"])).otherwise(left)
    rank = F.row_number().over(Window.partitionBy("g").orderBy("h"))
    for row in (
        narrow.filter(in_prefix)
        .withColumn("left", left)
        .withColumn("rank", rank)
        .filter(F.col("rank") == F.col("left"))
        .collect()
    ):
        cuts[row["g"]] = row["h"]
    return cuts

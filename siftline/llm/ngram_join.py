"""N-gram Jaccard self-join by vertical partitioning.

One global order of shingles, rare ones first, is cut into fragments.  Two sets are
candidates if they share a shingle within the prefixes that their two sizes ask for, and if
their signatures do not tell them apart; their texts meet in shards of
pairs, where both sets are cut by fragment and the overlap of a pair is counted fragment by
fragment until it is known or out of reach.  Texts travel, not sets: a set's 64-bit shingles
take about twice its text, and cannot be compressed.

A signature has a bit per hash value of shingles, set if an odd number of the set's shingles
has it.  Two signatures differ in no more bits than the sets differ in shingles, so a pair
whose signatures differ in more than the similarity allows is no link.  A few hundred bits
tell large sets nothing; these have a tally beside them, the number of their shingles of each
hash value, whose differences add up to no more than the sets differ either.

Only what joins components is looked for.  First every set is compared with the first set of
each prefix shingle's list, so a list of m near copies gives m pairs and one component.
Then sets of one list are paired that are still in different components; lists that have
become one component drop out.  Sets of one component need no more links, so none is lost.

The order comes from the counts of all shingles in a fixed number of hash buckets, so its
size has a bound; a shingle's place is the rank of its bucket's count, then its hash.  Any
total order gives the same links; this one puts common passages last, out of the prefixes.
Equal sets are one node, so copies add no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import components, in_few
from siftline.llm.shingles import blocks, set_hash, shingle_sets
from siftline.session import cut_lineage

WIDTH = 3
PERCENT = 90
BUCKET_BITS = 17
FRAGMENTS = 8
#: Words of 64 bits in a set's signature.
SIGNATURE = tuple(f"s{k}" for k in range(4))
#: Hash values in a set's tally, and the shingles from which a set has one.
TALLY = 256
TALLY_LEAST = 512
#: Bits of the filter that picks the candidates' texts; false hits are dropped by the join.
FILTER_BITS = 23
#: Sets in a block of a group of candidates, and full tiles in a shard, about.
TILE_NODES = 256
SHARD_TILES = 2


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _signature(grams: np.ndarray) -> np.ndarray:
    """Per hash value of shingles whether an odd number of the set has it, as 64-bit words."""
    bits = 64 * len(SIGNATURE)
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _tally(grams: np.ndarray) -> bytes:
    """The number of shingles of each hash value, 255 at most."""
    counts = np.bincount(((grams >> np.uint64(16)) & np.uint64(TALLY - 1)).astype(np.int64), minlength=TALLY)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def shingle_summary(docs: DataFrame, width: int = WIDTH, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document its keys, ``n``, ``node``, signature and tally; and per task one row per counted bucket.

    ``node`` is a hash of the shingle set, null for an empty set.  Rows with a ``bucket``
    hold the task's counts and have no document.
    """
    rows = docs.select(*keys, text)
    schema = rows.drop(text).schema.add("n", "long").add("node", "long").add("bucket", "integer").add("cnt", "long")
    for name in SIGNATURE:
        schema = schema.add(name, "long")
    schema = schema.add("tally", "binary")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        names, types = [*keys, "n", "node", "bucket", "cnt", *SIGNATURE, "tally"], None
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            n, node, signs, tally = [], [], [], []
            for _, texts in blocks(batch.column(text)):
                for grams in shingle_sets(texts, width):
                    n.append(len(grams))
                    node.append(set_hash(grams) if len(grams) else None)
                    signs.append(_signature(grams))
                    tally.append(_tally(grams) if len(grams) >= TALLY_LEAST else None)
                    np.add.at(counts, _bucket(grams), 1)
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())]
            sign = [pa.array(w) for w in np.array(signs, np.int64).reshape(-1, len(SIGNATURE)).T]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *none, *sign, pa.array(tally, pa.binary())], names=names)
        if types is not None:
            used = np.flatnonzero(counts)
            none = [pa.nulls(len(used), t) for t in (*types, pa.int64(), pa.int64())]
            sign = [pa.nulls(len(used), pa.int64()) for _ in SIGNATURE]
            yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), *sign, pa.nulls(len(used), pa.binary())], names=names)

    return rows.mapInArrow(summarise, schema)


def global_order(summary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each bucket by count, and its fragment; the fragments hold about equal counts.

    What reaches the driver is one count per bucket, 2 ** BUCKET_BITS at most.
    """
    counted = summary.where("bucket is not null").groupBy("bucket").agg(F.sum("cnt").alias("cnt")).toPandas()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[counted["bucket"].to_numpy(np.int64)] = counted["cnt"].to_numpy(np.int64)
    by_count = np.argsort(counts, kind="stable")
    rank = np.empty(len(counts), np.int32)
    rank[by_count] = np.arange(len(counts), dtype=np.int32)
    mass = np.cumsum(counts[by_count])
    cut = np.minimum(mass * FRAGMENTS // max(1, int(mass[-1])), FRAGMENTS - 1).astype(np.int8)
    return rank, cut[rank]


def prefix_rows(docs: DataFrame, rank, width: int, percent: int, text: str) -> DataFrame:
    """(gram, node, n, pos): the first shingles of each set in the global order, with their places."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = rank.value, set()
        for batch in batches:
            for _, texts in blocks(batch.column(text)):
                gram, node, size, taken = [], [], [], []
                for grams in shingle_sets(texts, width):
                    n = len(grams)
                    if not n or (mark := set_hash(grams)) in seen:
                        continue
                    seen.add(mark)
                    p = n - -(-percent * n // 100) + 1
                    gram.append(grams[np.lexsort((grams, order[_bucket(grams)]))[:p]])
                    node.append(mark)
                    size.append(n)
                    taken.append(p)
                if gram:
                    each = [np.repeat(np.array(x, np.int64), taken) for x in (node, size)]
                    columns = [np.concatenate(gram).view(np.int64), *each, np.concatenate([np.arange(p, dtype=np.int32) for p in taken])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "node", "n", "pos"])

    return docs.select(text).mapInArrow(emit, "gram bigint, node bigint, n bigint, pos int")


def shared_lists(prefixes: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, pos, first): the lists of at least two sets, with the smallest node of each.

    A set stays in a list if the next larger or the next smaller one there has a size that
    it may be linked with; with none of these, it has no candidate in the list.
    ``first`` has the smallest node with its ``n`` and ``pos``.  The prefixes are made and
    dealt out once; a list's ends are found where it lies.
    """
    rows = prefixes.repartition("gram").dropDuplicates(["gram", "node"])
    by_size, whole = Window.partitionBy("gram").orderBy("n"), Window.partitionBy("gram")
    # the overlap that sizes n and m need is n - pos at most
    smaller = F.lag("n").over(by_size) * 100 >= F.col("n") * percent
    larger = F.lead("n").over(by_size) * percent <= F.least((F.col("n") - F.col("pos")) * (100 + percent) - F.col("n") * percent, F.col("n") * 100)
    rows = rows.withColumn("near", F.coalesce(smaller, F.lit(False)) | F.coalesce(larger, F.lit(False))).where("near").drop("near")
    ends = rows.withColumns({"first": F.min(F.struct("node", "n", "pos")).over(whole), "last": F.max("node").over(whole)}).where("first.node < last")
    return ends.drop("last")


def signatures(summary: DataFrame) -> DataFrame:
    """(node, signature): one row per different set."""
    return summary.where("node is not null").groupBy("node").agg(*(F.first(s).alias(s) for s in SIGNATURE))


def _least(percent: int) -> Column:
    """The least overlap at which sets of ``na`` and ``nb`` shingles reach the similarity."""
    return F.expr(f"((na + nb) * {percent} + {99 + percent}) div {100 + percent}")


def _may_meet(percent: int) -> Column:
    """Whether the sizes allow a link, and the shared shingle stands in the prefixes of both.

    If ``m`` shingles of a set may be missing in the other, its first ``m + 1`` hold one
    that both have.  With the other's size known ``m`` is about half of what it is without.
    """
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sizes & (F.col("posa") <= F.col("na") - _least(percent)) & (F.col("posb") <= F.col("nb") - _least(percent))


def _signs_allow(percent: int) -> Column:
    """Whether the signatures ``s0a``.. and ``s0b``.. differ in no more bits than linked sets may."""
    apart = sum((F.bit_count(F.col(f"{s}a").bitwiseXOR(F.col(f"{s}b"))) for s in SIGNATURE), F.lit(0))
    return apart <= F.col("na") + F.col("nb") - 2 * _least(percent)


def star_pairs(lists: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): every set of a list with the list's first, where a link is possible."""
    ends = lists.where("node <> first.node").select(
        F.col("node").alias("a"), F.col("first.node").alias("b"), F.col("n").alias("na"), F.col("first.n").alias("nb"), F.col("pos").alias("posa"), F.col("first.pos").alias("posb")
    )
    pairs = ends.where(_may_meet(percent)).select("a", "b", "na", "nb").distinct()
    of = lambda side: signs.select(F.col("node").alias(side), *(F.col(s).alias(f"{s}{side}") for s in SIGNATURE))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_signs_allow(percent)).select("a", "b", "na", "nb")


def candidate_pairs(lists: DataFrame, roots: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of sets in different components that share a list, where a link is possible.

    Near copies share many lists.  Where two sets have the same shingle before the shared
    one, among those of lists still in question, they meet there too, and are not paired again.
    """
    rows = lists.drop("first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("gram")
    rows = cut_lineage(rows.join(mixed, "gram", "left_semi"), "mixed")
    rows = rows.withColumn("before", F.lag("gram").over(Window.partitionBy("node").orderBy("pos"))).join(signs, "node")
    held = ("node", "n", "pos", "root", "before", *SIGNATURE)
    a = rows.select("gram", *(F.col(c).alias(f"{c}a") for c in held))
    b = rows.select("gram", *(F.col(c).alias(f"{c}b") for c in held))
    other = (F.col("nodea") < F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & F.coalesce(F.col("beforea") != F.col("beforeb"), F.lit(True))
    pairs = a.join(b, "gram").where(other & _may_meet(percent) & _signs_allow(percent))
    return pairs.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"), "na", "nb").distinct()


def tallies_allow(pairs: DataFrame, tallies: DataFrame, percent: int) -> DataFrame:
    """The pairs whose tallies differ by no more than those of linked sets may; pairs without stay."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")))
            near = [ta is None or tb is None or _apart(ta, tb) <= na + nb - 2 * -(-(na + nb) * percent // (100 + percent)) for na, nb, ta, tb in rows]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(near, pa.bool_()))

    of = lambda side: tallies.select(F.col("node").alias(side), F.col("tally").alias(f"t{side}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").mapInArrow(emit, "a bigint, b bigint, na bigint, nb bigint")


def _apart(a: bytes, b: bytes) -> int:
    return int(np.abs(np.frombuffer(a, np.uint8).astype(np.int64) - np.frombuffer(b, np.uint8)).sum())


def _node_filter(pairs: DataFrame) -> np.ndarray:
    """A bit per hash value of the nodes in ``pairs``, as 2 ** FILTER_BITS bits at most."""
    nodes = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v")))
    bit = F.expr(f"cast(v & {(1 << FILTER_BITS) - 1} as int)")
    words = nodes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, bit & 31))").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def wanted_texts(docs: DataFrame, wanted, width: int, text: str) -> DataFrame:
    """(node, text): one text of each wanted node."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, seen = wanted.value, set()
        for batch in batches:
            for start, texts in blocks(batch.column(text)):
                node, at = [], []
                for i, grams in enumerate(shingle_sets(texts, width), start):
                    if not len(grams):
                        continue
                    mark = set_hash(grams)
                    if mark in seen or not hit[mark & ((1 << FILTER_BITS) - 1)]:
                        continue
                    seen.add(mark)
                    node.append(mark)
                    at.append(i)
                if node:
                    held = batch.column(text).take(pa.array(at)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), held], names=["node", "text"])

    return docs.select(text).mapInArrow(emit, "node bigint, text string").groupBy("node").agg(F.first("text").alias("text"))


def _tiles(pairs: DataFrame) -> DataFrame:
    """Add to each pair its ``shard``: pairs of one group of candidates meet in few shards.

    Candidates that pairs connect are a group; its nodes are dealt into blocks of about
    TILE_NODES, and a tile holds the pairs between two blocks.  So a set travels once per
    block of its group, not once per pair.  A shard is about SHARD_TILES whole tiles,
    however large the groups are.
    """
    groups = components(pairs)
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    placed = groups.join(sizes, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / TILE_NODES)).alias("block"))
    at = lambda side: placed.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"), F.col("block").alias(f"{side}_block"))
    tile = F.xxhash64("a_root", F.least("a_block", "b_block"), F.greatest("a_block", "b_block"))
    tiled = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "na", "nb", tile.alias("tile"))
    tiled = cut_lineage(in_few(tiled, pairs.count()), "tiles")
    # a tile of few pairs holds few sets, however many blocks its group has
    filled = tiled.groupBy("tile").agg(F.least(F.count("*"), F.lit(TILE_NODES)).alias("fill")).agg(F.sum("fill")).first()[0] or 0
    shards = max(1, filled // (SHARD_TILES * TILE_NODES))
    return tiled.select("a", "b", "na", "nb", F.pmod("tile", F.lit(shards)).alias("shard"))


def _star_shards(pairs: DataFrame) -> DataFrame:
    """Add to each pair of a set and a list's first its ``shard``, by the least first of the set.

    Near copies share their least first mostly, so a set travels once, with its few firsts
    beside it.  The sets of one least first are dealt into blocks of about TILE_NODES pairs,
    however many they are.  No group need be known.
    """
    shards = max(1, pairs.count() // (SHARD_TILES * TILE_NODES))
    sets = pairs.groupBy("a").agg(F.min("b").alias("head"), F.count("*").alias("k"))
    sizes = sets.groupBy("head").agg(F.sum("k").alias("size"))
    block = F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / TILE_NODES))
    placed = sets.join(sizes, "head").select("a", F.pmod(F.xxhash64("head", block), F.lit(shards)).alias("shard"))
    return cut_lineage(pairs.join(placed, "a").select("a", "b", "na", "nb", "shard"), "tiles")


def _overlap(a: list[np.ndarray], b: list[np.ndarray], least: int) -> int:
    """The overlap of two sets cut by fragment; -1 as soon as it cannot reach ``least``."""
    found, left = 0, sum(min(len(x), len(y)) for x, y in zip(a, b))
    for x, y in zip(a, b):
        if found + left < least:
            return -1
        left -= min(len(x), len(y))
        if len(x) and len(y):
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            found += int(np.count_nonzero(y[at] == x))
    return found


def _link_shard(pairs: pa.Table, sets: pa.Table, cut: np.ndarray, width: int, percent: int) -> pa.Table:
    """The pairs of a shard that reach the similarity."""
    nodes = sets.column("node").to_pylist()
    parts: dict[int, list[np.ndarray]] = {}
    at = 0
    for _, texts in blocks(sets.column("text")):
        for grams in shingle_sets(texts, width):
            place = cut[_bucket(grams)]
            parts[nodes[at]] = [grams[place == f] for f in range(FRAGMENTS)]
            at += 1
    out: list[tuple[int, int]] = []
    for a, b, na, nb in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "na", "nb"))):
        # overlap * 100 >= (na + nb - overlap) * percent
        least = -(-(na + nb) * percent // (100 + percent))
        if a in parts and b in parts and _overlap(parts[a], parts[b], least) >= least:
            out.append((a, b))
    return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], names=["a", "b"])


def linked_pairs(
    docs: DataFrame, pairs: DataFrame, fragment, width: int, percent: int, text: str, deal: Callable[[DataFrame], DataFrame] = _tiles
) -> DataFrame:
    """(a, b) of the pairs that reach the similarity.

    ``deal`` adds to the stored pairs the ``shard`` in which each is counted.
    """
    pairs = cut_lineage(pairs, "pairs")
    wanted = docs.sparkSession.sparkContext.broadcast(_node_filter(pairs))
    tiled = deal(pairs)
    needed = tiled.select(F.col("shard").alias("at"), F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = needed.join(wanted_texts(docs, wanted, width, text), "node").select("at", "node", "text")
    return tiled.groupBy("shard").cogroup(sent.groupBy("at")).applyInArrow(
        lambda near, sets: _link_shard(near, sets, fragment.value, width, percent), "a bigint, b bigint"
    )


def linked_sets(docs: DataFrame, summary: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """(a, b): links that connect all shingle sets of the similarity."""
    send = docs.sparkSession.sparkContext.broadcast
    rank, fragment = map(send, global_order(summary))
    prefixes = prefix_rows(docs, rank, width, percent, text)
    lists = cut_lineage(shared_lists(prefixes, percent), "lists")
    signs, tallies = signatures(summary), summary.where("tally is not null").groupBy("node").agg(F.first("tally").alias("tally"))
    firsts = tallies_allow(star_pairs(lists, signs, percent), tallies, percent)
    stars = cut_lineage(linked_pairs(docs, firsts, fragment, width, percent, text, _star_shards), "links")
    rest = tallies_allow(candidate_pairs(lists, cut_lineage(components(stars), "roots"), signs, percent), tallies, percent)
    return stars.union(linked_pairs(docs, rest, fragment, width, percent, text))


def jaccard_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", row: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and ``root``.

    ``component_id`` is the smallest doc_id that links reach; ``root`` names its component
    (null for an empty set).  Texts that are null or without words have empty sets, are linked with
    nothing and keep their own id.  Null ids count for nothing in the smallest id.
    Repeated rows are documents of one set.  ``row`` names a column to carry along.
    """
    held = docs.select(F.col(doc_id).alias("doc_id"), *([F.col(row).alias("row")] if row else []), F.col(text).alias("text"))
    keys = ("doc_id", "row") if row else ("doc_id",)
    summary = cut_lineage(shingle_summary(held, width, "text", keys), "shingles")
    links = cut_lineage(linked_sets(held, summary, width, percent, "text"), "set-links")
    rows = summary.where("bucket is null")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("node", "root", "component_id")
    return rows.join(named, "node", "left").select(
        *keys, F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "root",
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits) -> DataFrame:
    """The documents, one of each component: the one of smallest id, nulls last.

    Documents with empty sets all stay.
    """
    held = cut_lineage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "join-in", "zstd")
    view = held.select("row", F.col("doc")[doc_id].alias("doc_id"), F.col("doc")[text].alias("text"))
    found = jaccard_components(view, row="row", **limits)
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    kept = first.union(found.where("root is null").select("row"))
    return held.join(kept, "row", "left_semi").select("doc.*")

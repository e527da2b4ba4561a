"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import cut_lineage

#: Words are parted by space and U+0009 to U+000D.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Narrow rows of a task about, where their number is known before they are stored.
PARTITION_ROWS = 100_000


def words_of(text: Column) -> Column:
    """The words of a text; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def in_few(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, some ``n``, in no more partitions than PARTITION_ROWS asks for.

    The number of shuffle partitions follows the whole input.  A result that is known to be small
    against it is stored by few tasks in few files instead of a few rows in each.
    """
    return rows.coalesce(max(1, -(-n // PARTITION_ROWS)))


def with_text(held: DataFrame, docs: DataFrame, text: str, value: Column, n_chars: str) -> DataFrame:
    """The columns of ``docs``, packed in ``doc`` of ``held``, with a new text.

    ``n_chars``, where there is such a column, follows the text.  Packing keeps helper
    columns apart from any names in ``docs``.
    """
    out = held.select("doc", value.alias("value"))
    fields = [
        F.col("value") if c == text else F.char_length("value").cast(docs.schema[c].dataType) if c == n_chars else F.col("doc")[c]
        for c in docs.columns
    ]
    return out.select(*(f.alias(c) for f, c in zip(fields, docs.columns)))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of the connected components of undirected ``links``.

    Alternates large-star and small-star steps until the edge set is a forest of stars
    whose centres are the smallest nodes.  Every step is a grouped minimum and a join on
    the node; its result is written to the shared folder, so lineage stays short and a
    lost executor costs one step.  A step leaves no more edges than it was given, so its tasks are
    as many as those ask for.  Nodes without links do not appear.  Nulls are ignored.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut_lineage(edges.mapInArrow(_local_forest, "u bigint, v bigint"), "links")
    state = _state(edges)
    while state[0]:
        edges = cut_lineage(in_few(_small_star(_large_star(edges)), state[0]), "star")
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(in_few(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), state[0]))


class Forest:
    """Sets of numbers that can be joined."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.above.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            self.above[y] = x
        return x

    def join(self, x: int, y: int) -> bool:
        """Join the sets of both; false if they were one."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.above[max(x, y)] = min(x, y)
        return True


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task that join something new: a dense group leaves no more than its nodes."""
    forest = Forest()
    for batch in batches:
        edges = [(u, v) for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()) if forest.join(u, v)]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["u", "v"])


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum that tells one edge set from another."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(mixed, 20)), F.bit_xor(mixed)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

"""Substring search that reads only blocks of rows that can match (Q1, I5 at scale).

Rows are stored in numbered blocks; a second table lists the character trigrams of every
block.  A keyword's trigrams name the blocks to read, and the exact test runs on their rows
alone.  Keywords without a run of three plain characters read every block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import contains_text
from siftline.session import work_path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More candidate blocks than these are met by a join instead of a pushed-down filter.
MAX_PUSHED_BLOCKS = 2048
#: Ranges of block numbers in the filter that the scan gets.
MAX_RANGES = 64


#: Bits of a code point.
_POINT = 21
#: Characters whose trigrams are held before repeats are dropped.
_HELD_CHARS = 1 << 22


def _text_grams(text: str) -> np.ndarray:
    """The trigrams of a text as numbers, A-Z folded."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    return (points[:-2] << 2 * _POINT) | (points[1:-1] << _POINT) | points[2:]


def _gram_texts(grams: np.ndarray) -> list[str]:
    mask = (1 << _POINT) - 1
    points = np.stack([grams >> 2 * _POINT, (grams >> _POINT) & mask, grams & mask], axis=1)
    joined = points.astype(np.uint32).tobytes().decode("utf-32-le")
    return [joined[i:i + 3] for i in range(0, len(joined), 3)]


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (block, text columns) -> (block, gram), few of them more than once."""
    for batch in batches:
        held, chars, last = [], 0, None

        def flush():
            texts = _gram_texts(np.unique(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array([last] * len(texts), pa.int64()), pa.array(texts, pa.string())], ["block", "gram"])

        for i in range(batch.num_rows):
            block = batch.column(0)[i].as_py()
            if held and (block != last or chars > _HELD_CHARS):
                yield flush()
                held, chars = [], 0
            last = block
            for column in batch.columns[1:]:
                text = column[i].as_py()
                if text and len(text) >= 3:
                    held.append(_text_grams(text))
                    chars += len(text)
        if held:
            yield flush()


def keyword_grams(keyword: str) -> list[str]:
    """The trigrams every match holds: those of the runs between wildcards, A-Z folded."""
    plain = keyword.translate(str.maketrans(_UPPER, _LOWER))
    return sorted({run[i:i + 3] for run in re.split("[%_]", plain) for i in range(len(run) - 2)})


def block_ranges(blocks: list[int], most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Sorted block numbers as at most ``most`` ranges, joined over the smallest gaps."""
    gaps = sorted(range(1, len(blocks)), key=lambda i: blocks[i - 1] - blocks[i])
    cuts = sorted(i for i in gaps[:most - 1] if blocks[i] - blocks[i - 1] > 1)
    edges = [0, *cuts, len(blocks)]
    return [(blocks[a], blocks[b - 1]) for a, b in zip(edges, edges[1:]) if a < b]


@dataclass(frozen=True)
class TextIndex:
    """Stored rows in blocks and the trigrams of each block's searched columns."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    block_rows: int

    @staticmethod
    def create(
        df: DataFrame, columns: list[str], order: str, path: str | None = None, block_rows: int = 1024,
        files: int | None = None,
    ) -> "TextIndex":
        """Store ``df``, ranged by ``order``, and index the text ``columns``.

        ``files`` is the number of ranges; without it Spark chooses by size.
        """
        index = TextIndex(df.sparkSession, path or work_path(df.sparkSession, "text-index"), tuple(columns), block_rows)
        index._add(df, order, files, 0)
        return index

    def append(self, df: DataFrame, order: str, files: int | None = None) -> None:
        """Add rows as new blocks; stored blocks stay as they are."""
        last = self._batches("rows").agg(F.max("block")).first()[0]
        self._add(df, order, files, 0 if last is None else last + 1)

    def _add(self, df: DataFrame, order: str, files: int | None, first: int) -> None:
        batch = f"batch={uuid.uuid4().hex}"
        ranged = df.repartitionByRange(*([files] if files else []), order).sortWithinPartitions(order)
        # the place of a row in its task, cut into blocks; numbers of different tasks never meet
        place = F.monotonically_increasing_id()
        block = F.floor(place / F.lit(self.block_rows)) + F.lit(first)
        ranged.withColumn("block", block.cast("bigint")).write.parquet(f"{self.path}/rows/{batch}")
        # blocks are numbered once, in the stored rows; the grams are made from those
        stored = self.spark.read.parquet(f"{self.path}/rows/{batch}")
        texts = (F.col(c).cast("string").alias(f"text{i}") for i, c in enumerate(self.columns))
        grams = stored.select("block", *texts).mapInArrow(_block_grams, "block bigint, gram string").distinct()
        # by gram, so that a keyword's grams are found by the files' statistics
        ordered = grams.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")
        ordered.write.parquet(f"{self.path}/grams/{batch}")

    def _batches(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def rows(self) -> DataFrame:
        return self._batches("rows").drop("batch")

    def candidate_blocks(self, keyword: str) -> DataFrame | None:
        """(block) of the blocks that hold all trigrams of the keyword; None where it has none."""
        wanted = keyword_grams(keyword)
        if not wanted:
            return None
        found = self._batches("grams").filter(F.col("gram").isin(wanted)).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        return found.filter(F.col("n") == len(wanted)).select("block")

    def candidates(self, keyword: str) -> DataFrame:
        """All rows of the blocks that can match.

        Few blocks become ranges in the scan's own filter; many are joined, where
        little could be skipped anyway.
        """
        blocks = self.candidate_blocks(keyword)
        if blocks is None:
            return self.rows().drop("block")
        some = sorted(r["block"] for r in blocks.limit(MAX_PUSHED_BLOCKS + 1).collect())
        if len(some) > MAX_PUSHED_BLOCKS:
            return self.rows().join(blocks, "block", "left_semi").drop("block")
        inside = F.lit(False)
        for a, b in block_ranges(some):
            inside = inside | F.col("block").between(a, b)
        return self.rows().filter(inside).drop("block")

    def search(self, keyword: str) -> DataFrame:
        """Rows with the keyword in one of the columns; ``%`` and ``_`` are wildcards, A-Z folded."""
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | F.coalesce(contains_text(F.col(c), keyword), F.lit(False))
        return self.candidates(keyword).filter(hit)

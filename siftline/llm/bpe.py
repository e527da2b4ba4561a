"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding.

Two forms share the rank file.  ``encode_words`` is the form in Spark's own higher-order
functions: it encodes a table of distinct words with the ranks as a literal.  The
documents are encoded in Arrow batches (``encode_documents``), where each task merges a
word once and keeps it in a bounded cache; README gives the figures for this choice.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words kept by a task; beyond it the cache starts afresh.
CACHE_WORDS = 200_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines "base64 rank"; read where the task runs, so the path must exist there."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def load_pieces(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank, leftmost first, merges until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 200:
        return _merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    none = len(ranks) + 1
    pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list, for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    return [ranks[word[i:e]] for i, e in enumerate(end) if e]


class WordCoder:
    """Encodes distinct words once each, within a bounded cache."""

    def __init__(self, path: str, pattern: str, most: int = CACHE_WORDS):
        self.ranks, self.pieces, self.most = load_ranks(path), load_pieces(path), most
        compiled = regex.compile(pattern)
        self.split, self.split_iter = compiled.findall, compiled.finditer
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def word(self, word: str) -> tuple[str, int, bytes]:
        """Decimal ids joined by a space, their number, and the bytes they decode to."""
        found = self.known.get(word)
        if found is None:
            ids = merge_word(word.encode(), self.ranks)
            found = " ".join(map(str, ids)), len(ids), b"".join([self.pieces[i] for i in ids])
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = found
        return found

    def text(self, text: str | None) -> list[tuple[str, int, bytes]]:
        known, word = self.known, self.word
        return [known.get(w) or word(w) for w in self.split(text or "")]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False, with_text: bool = False,
) -> DataFrame:
    """Encode every whole text and decode its ids again; one row per document.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ``ids``
    (array of int), ``with_text`` adds ``decoded``.  Every match of ``pattern`` is
    encoded by itself, without special tokens.  Null texts count as empty; other columns
    are not read.  No rows move between tasks.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(path, pattern)
        for batch in batches:
            counts, id_hashes, byte_hashes, all_ids, texts = [], [], [], [], []
            for value in batch.column("text"):
                words = coder.text(value.as_py())
                ids = " ".join([w[0] for w in words])
                back = b"".join([w[2] for w in words])
                counts.append(sum([w[1] for w in words]))
                id_hashes.append(sha256(ids.encode()).hexdigest())
                byte_hashes.append(sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(np.fromstring(ids, np.int32, sep=" "))
                if with_text:
                    texts.append(back.decode())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(byte_hashes, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, schema)


#: Buckets of the literal rank map: an array index finds the bucket, a short map the rank.
BUCKETS = 65_536
NONE = 2_147_483_647


def rank_literal(df: DataFrame, path: str, buckets: int = BUCKETS) -> Column:
    """The ranks as one literal: an array of small maps from the hex form of a piece to its rank."""
    spark = df.sparkSession
    hexed = {piece.hex().upper(): rank for piece, rank in load_ranks(path).items()}
    keys = list(hexed)
    placed = spark.createDataFrame([(k,) for k in keys], "k string").select(F.pmod(F.hash("k"), F.lit(buckets)).alias("b")).collect()
    maps: list[dict] = [{} for _ in range(buckets)]
    for key, row in zip(keys, placed):
        maps[row["b"]][key] = hexed[key]
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(words: DataFrame, path: str, word: str = "word") -> DataFrame:
    """Add ``ids`` to a table of distinct words, by built-in expressions only.

    A word is the array of its bytes in hex; each step of the fold looks up the rank of
    every adjacent pair in the literal, and merges the leftmost pair of lowest rank.  The
    fold has as many steps as the word has bytes; steps after the last merge do nothing.
    """
    ranks = rank_literal(words, path)
    rank = lambda piece: F.coalesce(F.try_element_at(F.get(ranks, F.pmod(F.hash(piece), F.lit(BUCKETS))), piece), F.lit(NONE))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, rank(F.concat(p, F.get(parts, i + 1)))).otherwise(F.lit(NONE)))

        def merge(found: Column) -> Column:
            at = F.array_position(found, F.array_min(found)).cast("int")
            joined = F.concat(
                F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))),
                F.slice(parts, at + 2, F.greatest(F.lit(0), F.size(parts) - at - 1)),
            )
            return F.when(F.array_min(found) < NONE, joined).otherwise(parts)

        return let(pairs, merge)

    hexed = F.hex(F.encode(F.col(word), "UTF-8"))
    parts = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.substring(hexed, i, F.lit(2)))
    return words.withColumn("_parts", parts).withColumn("ids", F.when(
        rank(hexed) < NONE, F.array(rank(hexed))
    ).otherwise(F.transform(F.aggregate("_parts", F.col("_parts"), step), rank))).drop("_parts")


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the pieces of the ids, concatenated, from a literal array of pieces."""
    pieces = F.from_json(F.lit("[" + ",".join(f'"{p.hex()}"' for p in load_pieces(path)) + "]"), "array<string>")
    return df.withColumn("decoded", F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")))

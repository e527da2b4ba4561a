"""Spelling variants by pivotal bigrams.

Words are near if one inserted, deleted or replaced code point parts them.  The positional
bigrams of a word are ordered by how many words hold them, rare ones first.  Its prefix is
its first three, with all others of the third one's bigram; its pivots are two disjoint ones
of the prefix of least total count, chosen by dynamic programming.  One edit leaves at least
one of two disjoint pivots whole, so of two near words the pivots of the one whose prefix
ends first meet the prefix of the other.  The pivots are the index, the prefixes look them up.

Position limits: a pivot that survives has the edit on one side, so the text on its other
side is equal.  With equal text to the left it has not moved and the lengths differ by one at
most; with equal text to the right it moved as much as the lengths differ.  That makes
six keys (side, its text, gram, place, length) of a pivot and two of a prefix gram, and the
join is an equality on their hash; the distance is verified on the words themselves.

Edge cases: null and empty texts have no words; a null id counts as an empty one; runs of any
length are words; repeated rows count again.  Empty tables give no words.  Ties of the count
go to the smaller word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import cut_lineage

#: Fixed values of the word rules: letters, shortest word, fewest occurrences.
LETTERS = "[A-Za-zÀ-ÿ]"
RUN = re.compile(f"{LETTERS}+")
MIN_LENGTH = 5
MIN_COUNT = 3
ALTERED = 97
#: Characters of a text that are split at a time, and words a task counts before it passes them on.
PIECE = 1_000_000
MOST_COUNTED = 500_000
#: Edits between near words and code points of a gram.
EDITS = 1
GRAM = 2

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """Cut a text into pieces of about ``most`` characters, never inside a run."""
    start = 0
    while len(text) - start > most:
        run = RUN.match(text, start + most)
        end = run.end() if run else start + most
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def altered(run: str, seed: int, every: int = ALTERED) -> str:
    """The run, without one of its code points if its hash says so.

    ``seed`` is the crc32 of the document's id and a colon.
    """
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = ALTERED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of the least length and count.  Tasks count before the shuffle.

    An altered run is never longer, so shorter runs are not looked at.
    """
    long_run = re.compile(f"{LETTERS}{{{min_length},}}")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where("text is not null")

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch["id"], batch["text"]):
                seed = zlib.crc32(f"{key.as_py()}:".encode())
                for piece in pieces(value.as_py()):
                    for run, n in Counter(long_run.findall(piece.translate(_FOLD))).items():
                        word = altered(run, seed, every)
                        if len(word) >= min_length:
                            counts[word] += n
                if len(counts) >= MOST_COUNTED:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    partial = rows.mapInArrow(count, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def disjoint_pivots(prefix: list[tuple[int, int]], k: int = EDITS + 1, gram: int = GRAM) -> list[int]:
    """Places of ``k`` disjoint grams of least total weight.

    ``prefix`` holds (place, weight) by rising place.  ``best[j]`` is the least (weight,
    places) of ``j`` disjoint grams seen so far that end before the next one starts.
    """
    table: list[list[tuple[int, tuple[int, ...]] | None]] = []
    for i, (place, weight) in enumerate(prefix):
        before = max((m for m in range(i) if prefix[m][0] + gram <= place), default=None)
        row: list[tuple[int, tuple[int, ...]] | None] = [(0, ())]
        for j in range(1, k + 1):
            options = []
            if i and table[i - 1][j] is not None:
                options.append(table[i - 1][j])
            rest = (0, ()) if j == 1 else table[before][j - 1] if before is not None else None
            if rest is not None:
                options.append((rest[0] + weight, (*rest[1], place)))
            row.append(min(options, default=None))
        table.append(row)
    found = table[-1][k] if table else None
    return list(found[1]) if found else []


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Number of words that hold each bigram.  Its size is bounded by the square of the alphabet."""
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = F.array_distinct(F.transform(places, lambda p: F.substring("word", p, F.lit(GRAM))))
    counted = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}


def word_grams(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(word, n, len, last, gram, place, left, right, pivot): the prefix grams of every word.

    ``last`` is the rank of the prefix's last bigram in the global order; ``left`` and
    ``right`` are hashes of the text on either side of the gram.
    """
    order = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in counts.items()))}
    shared = words.sparkSession.sparkContext.broadcast((order, counts))
    need = GRAM * EDITS + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weight = shared.value
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
                ranks = [rank[word[p:p + GRAM]] for p in range(len(word) - GRAM + 1)]
                last = sorted(ranks)[need - 1]
                prefix = [p for p, r in enumerate(ranks) if r <= last]
                pivots = set(disjoint_pivots([(p, weight[word[p:p + GRAM]]) for p in prefix]))
                for p in prefix:
                    sides = zlib.crc32(word[:p].encode()), zlib.crc32(word[p + GRAM:].encode())
                    rows.append((word, n, len(word), last, ranks[p], p, *sides, p in pivots))
            columns = list(zip(*rows)) if rows else [[]] * 9
            types = [pa.string(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["word", "n", "len", "last", "gram", "place", "left", "right", "pivot"],
            )

    schema = "word string, n bigint, len int, last int, gram int, place int, left bigint, right bigint, pivot boolean"
    return words.mapInArrow(emit, schema)


def near_words(grams: DataFrame) -> DataFrame:
    """(word, other, n, n_other): near words, every pair in both directions."""
    left = lambda d: F.xxhash64(F.lit(0), "left", "gram", "place", F.col("len") + d)
    right = lambda d: F.xxhash64(F.lit(1), "right", "gram", F.col("place") + d, F.col("len") + d)
    index = grams.where("pivot").select(
        F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("last_a"),
        F.explode(F.array(*[side(d) for side in (left, right) for d in (-1, 0, 1)])).alias("key"),
    )
    look = grams.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("last_b"), F.explode(F.array(left(0), right(0))).alias("key"))
    verified = (F.col("last_a") <= F.col("last_b")) & (F.levenshtein("a", "b", 1) == 1)
    pairs = index.join(look, "key").where(verified)
    pairs = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("na").alias("n"), F.col("nb").alias("n_other")),
                                           F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("nb").alias("n"), F.col("na").alias("n_other")))).alias("r"))
    return pairs.select("r.*").distinct()


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links without cycles, each round doubling the links' reach."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.join(onward, "root", "left")
        moved = cut_lineage(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def spelling_forms(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of (word, n) rows.

    ``form`` is the near word of largest ``n``, if that is at least ``factor`` times the
    word's; so chains of forms end, at the ``root``.
    """
    held = cut_lineage(words, "words")
    near = near_words(cut_lineage(word_grams(held, gram_counts(held)), "grams"))
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("form"))).alias("best"),
    )
    found = held.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    has = F.col("form_n") >= factor * F.col("n")
    found = cut_lineage(found.select("word", "n", "n_near", F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "near")
    roots = follow_forms(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = ALTERED) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_forms(word_counts(docs, text, doc_id, every))

"""Removal of long byte strings that occur more than once, over a whole corpus.

Windows of one width in bytes can only be equal if their anchors are at equal offsets and the
bytes that all windows of a stretch share (its core) are equal.  Stretches are grouped by
core; within a group, a stretch is its bytes around the core with the core as one symbol,
equal stretches are one, and a suffix array over the different stretches of many groups
finds the windows that occur twice.  Groups of one core that are too many for a task are
compared by the hash of each window instead, which any number of tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.anchors import GRAM, scan_texts, span_hashes
from siftline.llm.common import with_text
from siftline.llm.shingles import mix
from siftline.llm.suffix_groups import suffix_array
from siftline.session import cut_lineage

WINDOW = 400
#: Symbols of a shard about, and different stretches of one core that go to one shard at most.
SHARD_SYMBOLS = 500_000
MOST_STRETCHES = 5_000
#: Bits of the filter of repeated cores: about 16 a core within these bounds.  More cores
#: only let more rows through to the exact comparison.
LEAST_BITS, MOST_BITS = 16, 26


def stretch_of(window: int) -> int:
    """Windows of a stretch at most; its core is the other bytes."""
    return max(1, window * 8 // 25)


def _number(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _stretches(texts: list[bytes], window: int) -> Iterator[tuple]:
    """Per block (numbers, bases, data, owner, key, low, high, core) of all stretches.

    Stretch ``j`` of an anchor holds its windows that start ``j * stretch`` to
    ``(j + 1) * stretch - 1`` bytes before it; ``low`` and ``high`` are its first and last
    window, ``key`` is a hash of the core's bytes and of ``j``.  Places are in ``data``.
    """
    stretch = stretch_of(window)
    for numbers, bases, data, owner, first, last, anchor, sums in scan_texts(texts, window):
        near, far = (anchor - last) // stretch, (anchor - first) // stretch
        count = far - near + 1
        run = np.repeat(np.arange(len(first)), count)
        j = near[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        core = anchor[run] - j * stretch
        low, high = np.maximum(first[run], core - stretch + 1), np.minimum(last[run], core)
        key = mix(span_hashes(sums, core, window - stretch + 1) + j.astype(np.uint64)).view(np.int64) if len(core) else core
        yield numbers, bases, data, owner[run], key, low, high, core


def _texts(docs: DataFrame, text: str, window: int) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(whole).alias("text_hash"), F.octet_length(whole).alias("n_bytes"), whole.alias("text")).where(F.col("n_bytes") >= window)


def core_counts(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The core hashes that occur twice or more in the corpus."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _blocks(batch.column("text")):
                found = [s[4] for s in _stretches(texts, window)]
                core, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(n, pa.int64())], names=["core", "n"])

    rows = _texts(docs, text, window).select("text").mapInArrow(emit, "core bigint, n bigint")
    return rows.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core")


def _blocks(values, most: int = 4_000_000) -> Iterator[list[bytes]]:
    run, size = [], 0
    for value in values:
        run.append(value.as_py().encode())
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def core_filter(cores: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, table): a bit per hash value of the cores; 2 ** MOST_BITS bits at most."""
    n = cores.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    bit = F.expr(f"cast(core & {(1 << bits) - 1} as int)")
    words = cores.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, bit & 31))").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits, out


STRETCH_ROWS = "text_hash bigint, n_bytes int, core bigint, snip bigint, first int, windows int, head int, body binary"


def stretch_rows(docs: DataFrame, wanted, text: str = "text", window: int = WINDOW) -> DataFrame:
    """All stretches whose core the filter lets through, in the text they stand in.

    ``snip`` is a hash of the stretch's bytes; ``body`` holds the ``head`` bytes before
    the core and the bytes after it, given once per task and stretch.
    """

    width = window - stretch_of(window) + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, table), seen = wanted.value, set()
        mask = (1 << bits) - 1
        for batch in batches:
            keys = list(zip(batch.column("text_hash").to_pylist(), batch.column("n_bytes").to_pylist()))
            at = 0
            for texts in _blocks(batch.column("text")):
                out = []
                for numbers, bases, data, owner, key, low, high, core in _stretches(texts, window):
                    bit = key & mask
                    hit = np.flatnonzero((table[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1)
                    for o, k, f, l, c in zip(*(x[hit].tolist() for x in (owner, key, low, high, core))):
                        snip = _number(data[f:l + window])
                        body = None
                        if (k, snip) not in seen:
                            seen.add((k, snip))
                            body = data[f:c] + data[c + width:l + window]
                        out.append((*keys[at + numbers[o]], k, snip, f + int(bases[o]), l - f + 1, c - f, body))
                at += len(texts)
                if out:
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                    names = [c.split()[0] for c in STRETCH_ROWS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return _texts(docs, text, window).select("text_hash", "n_bytes", "text").mapInArrow(emit, STRETCH_ROWS)


RUNS = "core bigint, snip bigint, runs array<struct<a:int,b:int>>"
RUN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _runs_of(marks: list[int]) -> list[dict]:
    out: list[dict] = []
    for i in marks:
        if out and out[-1]["b"] == i - 1:
            out[-1]["b"] = i
        else:
            out.append({"a": i, "b": i})
    return out


def repeated_windows(stretches: list[tuple[int, bytes, int, int]], stretch: int) -> list[list[int]]:
    """Per stretch (core number, body, head, windows) its windows that occur in another one.

    One suffix array over all of them: bytes are symbols 1 to 256, each core is a symbol
    of its own, and a 0 ends each stretch.  Two neighbours that share ``stretch`` symbols
    from a window's start on are equal windows.
    """
    symbols: list[int] = []
    owner: list[int] = []
    at: list[int] = []  # the window that starts at each symbol, -1 for none
    for i, (core, body, head, windows) in enumerate(stretches):
        symbols += [b + 1 for b in body[:head]]
        symbols.append(core + 257)
        symbols += [b + 1 for b in body[head:]]
        symbols.append(0)
        owner += [i] * (len(body) + 2)
        at += range(windows)
        at += [-1] * (len(body) + 2 - windows)
    found: list[set[int]] = [set() for _ in stretches]
    order = [p for p in suffix_array(symbols) if at[p] >= 0]
    for p, q in zip(order, islice(order, 1, None)):
        if symbols[p:p + stretch] == symbols[q:q + stretch]:
            found[owner[p]].add(at[p])
            found[owner[q]].add(at[q])
    return [sorted(x) for x in found]


def _shard(table: pa.Table, stretch: int) -> pa.Table:
    cores, snips = table.column("core").to_pylist(), table.column("snip").to_pylist()
    number = {c: i for i, c in enumerate(dict.fromkeys(cores))}
    rows = list(zip((number[c] for c in cores), table.column("body").to_pylist(), table.column("head").to_pylist(), table.column("windows").to_pylist()))
    marks = repeated_windows(rows, stretch)
    return pa.table([pa.array(cores, pa.int64()), pa.array(snips, pa.int64()), pa.array([_runs_of(m) for m in marks], RUN_TYPE)], names=["core", "snip", "runs"])


def _window_hashes(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("core", "snip", "body", "head", "windows")))
        for core, snip, body, head, windows in rows:
            for w in range(windows):
                # the window's bytes before the core tell how many follow it
                data = blake2b(body[w:w + stretch - 1] + (head - w).to_bytes(2, "little"), digest_size=16).digest()
                out.append((core, snip, w, data))
        if out:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["core", "snip", "w", "h"])


def repeated_runs(rows: DataFrame, window: int = WINDOW, most: int = MOST_STRETCHES, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(core, snip, runs): the repeated windows of each different stretch, as runs a..b."""
    stretch = stretch_of(window)
    distinct = rows.groupBy("core", "snip").agg(F.count("*").alias("n"), F.max("body").alias("body"), F.max("head").alias("head"), F.max("windows").alias("windows"))
    per_core = distinct.groupBy("core").agg(F.count("*").alias("m"))
    distinct = cut_lineage(distinct.join(per_core, "core"), "stretches")
    whole = distinct.where("n > 1").select("core", "snip", F.expr("array(struct(0 as a, windows - 1 as b))").alias("runs"))
    mixed = distinct.where((F.col("m") > 1) & (F.col("m") <= most))
    symbols = mixed.agg(F.sum(F.octet_length("body") + 2)).first()[0] or 0
    shards = -(-symbols // shard_symbols) or 1
    placed = mixed.withColumn("shard", F.pmod(F.xxhash64("core"), F.lit(shards)))
    small = placed.groupBy("shard").applyInArrow(lambda table: _shard(table, stretch), RUNS)
    many = distinct.where(F.col("m") > most).select("core", "snip", "body", "head", "windows").mapInArrow(lambda batches: _window_hashes(batches, stretch), "core bigint, snip bigint, w int, h binary")
    twice = many.groupBy("core", "h").agg(F.count("*").alias("k")).where("k > 1").select("core", "h")
    large = many.join(twice, ["core", "h"]).select("core", "snip", F.expr("array(struct(w as a, w as b))").alias("runs"))
    return whole.union(small.where("size(runs) > 0")).union(large)


def removed_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, **sizes) -> DataFrame:
    """(text_hash, n_bytes, spans): per different text with repeats, starts and ends of windows
    that occur elsewhere, joined where they touch within one stretch."""
    cores = cut_lineage(core_counts(docs, text, window), "cores")
    wanted = docs.sparkSession.sparkContext.broadcast(core_filter(cores))
    rows = cut_lineage(stretch_rows(docs, wanted, text, window), "stretch-rows")
    runs = cut_lineage(repeated_runs(rows, window, **sizes), "runs")
    # a text that stands twice gives equal rows; one of each is enough from here on
    places = rows.select("text_hash", "n_bytes", "core", "snip", "first").distinct()
    hits = places.join(runs, ["core", "snip"]).select("text_hash", "n_bytes", "first", F.explode("runs").alias("r"))
    spans = hits.select("text_hash", "n_bytes", F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b") + window).alias("b")).alias("s"))
    return spans.groupBy("text_hash", "n_bytes").agg(F.collect_list("s").alias("spans"))


def merge_spans(spans) -> list[tuple[int, int]]:
    """Spans as maximal runs in order; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_kept: bool = False, window: int = WINDOW, **sizes) -> DataFrame:
    """Columns ``keep`` with n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Every byte covered by a string of ``window`` bytes that also starts anywhere else, in the
    input, is removed.  ``with_kept`` adds ``kept``, the remaining bytes as
    text (a character that lost some of its bytes shows as U+FFFD).  Null
    texts count as empty; texts below ``window`` bytes lose nothing; repeated rows lose
    all from ``window`` bytes on.  The anchors need windows of GRAM bytes at least.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM}")
    spans = cut_lineage(removed_spans(docs, text, window, **sizes), "spans")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, whole.alias("_text"), F.xxhash64(whole).alias("text_hash"), F.octet_length(whole).alias("n_bytes")).join(spans, ["text_hash", "n_bytes"], "left")
    rows = rows.select(*keep, "_text", F.transform("spans", lambda s: s["a"]).alias("_a"), F.transform("spans", lambda s: s["b"]).alias("_b"))
    schema = rows.select(*keep).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_kept:
        schema = schema.add("kept", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, a, b in zip(batch.column("_text"), batch.column("_a"), batch.column("_b")):
                data = value.as_py().encode()
                runs = merge_spans(zip(a.as_py(), b.as_py())) if a.is_valid else []
                edges = [0, *(e for run in runs for e in run), len(data)]
                left = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(left), len(runs), sha256(left).hexdigest(), *[left.decode("utf-8", "replace")] * with_kept))
            types = [pa.int64()] * 3 + [pa.string()] + [pa.string()] * with_kept
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], names=[f.name for f in schema])

    return rows.mapInArrow(cut, schema)


def apply_dedup(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **sizes) -> DataFrame:
    """The documents with repeated strings taken out of their texts; columns as in ``docs``.

    Documents of which nothing is left go; those that lose nothing stay as they are.
    """
    held = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    done = dedup_substrings(held, keep=("doc",), with_kept=True, **sizes).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return with_text(done, docs, text, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc")[text]), n_chars)

"""Anchors of byte windows: which windows of many texts can be equal at all.

The anchor of a window is its gram of smallest hash, the leftmost of equals.  It follows
from the window's bytes alone, so equal windows have equal grams at equal offsets.
Neighbouring windows share an anchor; their bytes together are one snippet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from siftline.llm.shingles import BASE, BYTE_VALUE, mix

GRAM = 32
#: Texts are scanned in blocks of about this many bytes; longer texts in several blocks.
BLOCK = 1 << 21
_PLACES = np.uint64(BLOCK * 2 - 1)
_VALUE = mix(BYTE_VALUE + np.arange(256, dtype=np.uint64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base))])


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS, _INVERSES = _powers(BLOCK, BASE), _powers(BLOCK, _INVERSE)


def _window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    span, low = 1, keys
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:len(keys) - width + 1], low[width - span:])


def scan(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in a block of texts at ``starts``..``ends``.

    Returns the first and last window start of each run, its anchor, and sums from which
    ``span_hashes`` takes the hash of any span.
    """
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none.astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _POWERS[:len(data)])])
    grams = span_hashes(sums, np.arange(len(data) - GRAM + 1), GRAM)
    keys = (grams & ~_PLACES) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_window_minimum(keys, window - GRAM + 1) & _PLACES).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    inside = text[:len(anchor)] == text[window - 1:]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, sums
    new = np.flatnonzero(np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])]
    return first, last, anchor[first], sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the spans of ``length`` bytes at ``starts`` of a scanned block."""
    return mix((sums[starts + length] - sums[starts]) * _INVERSES[starts])


def scan_texts(texts: list[bytes], window: int) -> Iterator[tuple]:
    """Scan texts in blocks.

    Yields tuples (numbers, bases, data, owner, first, last, anchor, sums) where ``owner``
    is the index of each run's text in ``numbers`` and ``bases`` holds what to add to a
    place in ``data`` to get the place in that text.
    """
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def done():
        lengths = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        data = b"".join(p for _, _, p in group)
        first, last, anchor, sums = scan(np.frombuffer(data, np.uint8), starts, ends, window)
        owner = np.searchsorted(ends, first, "right")
        return [n for n, _, _ in group], np.array([b for _, b, _ in group]) - starts, data, owner, first, last, anchor, sums

    for number, text in enumerate(texts):
        for base in range(0, max(1, len(text) - window + 1), BLOCK - window):
            piece = text[base:base + BLOCK - 1]
            if len(piece) < window:
                continue
            if size + len(piece) > BLOCK:
                yield done()
                group, size = [], 0
            group.append((number, base, piece))
            size += len(piece)
    if group:
        yield done()

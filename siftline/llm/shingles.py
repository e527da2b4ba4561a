"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20_240_601))
#: One odd 64-bit number per byte value, A-Z as a-z.
BYTE_VALUE = _RANDOM.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per text the number of its first word (and the total)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~IS_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(sizes.max()), BASE))])
    letters = data[inside]
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(letters)) - np.repeat(heads, sizes)
    return mix(np.add.reduceat(BYTE_VALUE[letters] * powers[place], heads) + sizes.astype(np.uint64)), first


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words, first = word_hashes(texts)
    with np.errstate(over="ignore"):
        mixed = words.copy()
        if len(words) >= width:
            grams = sum((words[k:len(words) - width + 1 + k] * PLACE[k] for k in range(1, width)), words[:len(words) - width + 1] * PLACE[0])
            mixed = mix(grams)
        out = []
        for lo, hi in zip(first[:-1], first[1:]):
            n = hi - lo
            if n >= width:
                out.append(np.unique(mixed[lo:hi - width + 1]))
            elif n:
                whole = sum((words[lo + k] * PLACE[k] for k in range(n)), np.uint64(n))
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_hash(grams: np.ndarray) -> int:
    """A signed 64-bit number that tells one set from another."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(grams ^ PLACE[4])) + np.uint64(len(grams)) * PLACE[3]
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def blocks(values, most: int = 2_000_000):
    """Cut a column of texts into runs of about ``most`` bytes; null counts as empty."""
    run, size, start = [], 0, 0
    for i, value in enumerate(values):
        text = (value.as_py() or "").encode()
        run.append(text)
        size += len(text)
        if size >= most:
            yield start, run
            run, size, start = [], 0, i + 1
    if run:
        yield start, run

"""Suffix array of a sequence of symbols by grouping suffixes by their Lyndon prefix."""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order; a proper prefix sorts first.

    Grouping: suffixes start in groups by first symbol.  Groups are taken in descending
    order; every member points to the nearest suffix on its left that is in a smaller
    group.  Suffixes pointed to by the same number of members move, per group, into a new
    group just above their own, so that a suffix's group stands for its longest Lyndon
    prefix.  Ordering: from the smallest suffix on, the suffix before it and those its
    pointers lead to take the next places of their groups.  No rank is computed twice and
    nothing is renamed.
    """
    text = [*symbols, -1]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start, last = 0, None
    for at, suffix in enumerate(order):
        if text[suffix] != last:
            start, last = at, text[suffix]
        place[suffix], group[suffix] = at, start
        size[start] += 1
    before = [-1] * n
    high = n - 1
    while high > 0:
        low = group[order[high]]
        pointed: dict[int, int] = {}
        members = order[low:high + 1]
        members.sort()
        for suffix in members:
            p = suffix - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[suffix] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            _raise_groups(pointed, order, place, group, size)
        high = low - 1
    first = order[0]
    del order, place, size, text  # the places to fill take as much
    return _emit(first, before, group)[1:]


def _raise_groups(pointed: dict[int, int], order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Move the suffixes pointed to into new groups, most pointers first."""
    most = max(pointed.values())
    by_count: list[list[int]] = [[] for _ in range(most + 1)]
    for suffix, count in pointed.items():
        by_count[count].append(suffix)
    for suffixes in reversed(by_count):
        for suffix in suffixes:
            g = group[suffix]
            size[g] -= 1
            end, at = g + size[g], place[suffix]
            other = order[end]
            order[at], order[end] = other, suffix
            place[other], place[suffix] = at, end
        for suffix in suffixes:
            g = group[suffix]
            new = g + size[g]
            group[suffix] = new
        for suffix in suffixes:
            size[group[suffix]] += 1


def _emit(first: int, before: list[int], group: list[int]) -> list[int]:
    """Fill the groups from the smallest suffix on."""
    n = len(group)
    out = [-1] * n
    free = list(range(n))
    placed = [False] * (n + 1)
    out[0], placed[first] = first, True
    for at in range(n):
        p = out[at] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = before[p]
    return out

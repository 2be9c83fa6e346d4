"""Suffix-array dedup with a linear grouping construction.

Windows are spread by their minimizer, the least hash of their ``GRAM``-word grams: equal
windows share it, so they meet in one task. There the distinct strings that hold them are
sorted by suffix, and windows of suffixes next to each other in that order are compared;
see :mod:`repeats` for the frame and for nulls, empty texts, ties and repeated rows.

The suffix array is built in two phases. The first groups suffixes by their longest Lyndon
prefix. It takes the groups in descending order; each member points to the nearest earlier
suffix of a smaller group, and the suffixes pointed to are moved, by how many members point
to them, into a new group right above their own. The second phase reads the order from the
left: a suffix puts the one before it, and in turn those that this one points to, to the
front of what is left of their groups, until it meets one that has its place. Every pointer
is followed once in each phase, and nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lodestrata.llm import textkit as K
from lodestrata.llm.repeats import repeated_spans, same, windows
from lodestrata.llm.substring_dedup import LENGTH, slide

GRAM = 25


def keys(w: K.Words, length: int, gram: int = GRAM) -> np.ndarray:
    gram = min(gram, length)
    return slide(K.grams(w.h, gram), length - gram + 1, np.minimum)


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of ``text`` in order; the last symbol has to be the only least one."""
    n = len(text)
    if n < 2:
        return list(range(n))
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    order = sorted(first)
    members = [first[c] for c in order]  # in text order; some are moved on later
    up, down = list(range(1, len(order) + 1)), list(range(-1, len(order) - 1))
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    up[-1] = -1
    prev, done = [-1] * n, bytearray(n)
    final: list[list[int]] = []
    g = len(order) - 1
    while g >= 0:
        own = members[g]
        if g < len(order) or len(own) > 1:
            own = [i for i in own if group[i] == g]
        elif group[own[0]] != g:
            own = []
        if own:
            final.append(own)
            by_count: dict[int, list[int]] = {}
            last, count = -1, 0
            for i in own:
                done[i] = 1
                p = i - 1
                while p >= 0 and done[p]:
                    p = prev[p]
                prev[i] = p
                if p == last:
                    count += 1
                else:
                    if last >= 0:
                        by_count.setdefault(count, []).append(last)
                    last, count = p, 1
            if last >= 0:
                by_count.setdefault(count, []).append(last)
            for k in sorted(by_count, reverse=True):
                fresh: dict[int, int] = {}
                for p in by_count[k]:
                    old = group[p]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        upper = up[old]
                        up.append(upper)
                        down.append(old)
                        up[old] = new
                        if upper >= 0:
                            down[upper] = new
                    members[new].append(p)
                    group[p] = new
        g = down[g]
    at, place = 0, [0] * len(members)
    for own in reversed(final):
        place[group[own[0]]] = at
        at += len(own)
    out, put = [0] * n, bytearray(n)
    out[0] = n - 1
    put[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not put[j]:
            q = group[j]
            out[place[q]] = j
            place[q] += 1
            put[j] = 1
            j = prev[j]
    return out


def verified(h: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the strings occur twice, by the suffix array of all strings with a mark of its own after each."""
    at = windows(n, length)
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    names = np.unique(h, return_inverse=True)[1] + len(n)
    ends = np.cumsum(n)
    text = np.insert(names, ends, np.arange(len(n) - 1, -1, -1))
    sa = np.array(suffix_array(text.tolist()))
    string = np.repeat(np.arange(len(n)), n)  # of each word of h
    where = np.full(len(text), -1)
    where[at + string[at]] = np.arange(len(at))  # a window's number, by its place in text
    order = where[sa]
    order = order[order >= 0]  # suffixes that are shorter than a window never stand between two equal ones
    pair = np.flatnonzero(same(h, at[order[:-1]], at[order[1:]], length))
    out[order[pair]] = out[order[pair + 1]] = True
    return out


def repeated_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start_word, end_word) of all passages of ``length`` words or more that occur again somewhere."""
    return repeated_spans(docs, keys, verified, length)

"""Substring dedup by recompression.

A document's words are renamed in rounds. A round first names runs of one symbol by the
symbol and their length, then pairs: each symbol is a left or a right one by a bit of its
hash that changes from round to round, and a left symbol before a right one becomes one
symbol. Names are hashes of what they stand for, so they agree over all documents without
a dictionary, and a symbol's extent depends on a few words around it only. The rounds note
how far: so it is known which symbols every occurrence of a window has inside, whatever
stands around it.

A window's key is the longest such symbol inside (the greatest hash among equals). A
window too regular for one takes its word of greatest hash. The Spark rounds exchange these
symbols over all documents and verify those that are shared; see :mod:`repeats` for what
equality rests on, and for nulls, empty and very long texts, ties and repeated rows.

A dictionary of names that a Spark round would build for each level isn't used: see the
README for its size as measured.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lodestrata.llm import textkit as K
from lodestrata.llm.repeats import repeated_spans, same, windows

U = np.uint64
LENGTH, ROUNDS = 50, 4


def rounds(w: K.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after ``k`` rounds: name, words it stands for, and the range of words that settles it."""
    sym, doc, n = w.h, K.doc_of(w.off), np.ones(len(w.h), np.int64)
    lo = np.arange(len(sym))
    hi = lo + 1
    far = np.int64(1 << 40)
    for r in range(k):
        cut = np.ones(len(sym) + 1, bool)  # a document begins here
        cut[1:-1] = doc[1:] != doc[:-1]
        first = cut[:-1].copy()
        first[1:] |= sym[1:] != sym[:-1]
        at = np.flatnonzero(first)
        end = np.append(at[1:], len(sym))
        size = end - at
        total = np.add.reduceat(n, at) if len(at) else n
        name = np.where(size > 1, K.mix(sym[at] * U(0x2545F4914F6CDD1D) + size.astype(np.uint64)), sym[at])
        lo = np.where(cut[at], -far, lo[at - 1])
        hi = np.where(cut[end], far, hi[np.minimum(end, len(hi) - 1)])
        sym, doc, n = name, doc[at], total
        cut = np.ones(len(sym) + 1, bool)
        cut[1:-1] = doc[1:] != doc[:-1]
        right = (K.mix(sym ^ U((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & U(1)).astype(bool)
        pair = np.zeros(len(sym), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~cut[1:-1]
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        prev, succ = np.maximum(np.arange(len(sym)) - 1, 0), np.minimum(np.arange(len(sym)) + 1, len(sym) - 1)
        lo = np.where(right & ~second, np.where(cut[:-1], -far, lo[prev]), lo)
        hi = np.where(pair, hi[succ], np.where(right, hi, np.where(cut[1:], far, hi[succ])))
        name = np.where(pair, K.mix(sym * U(0xA24BAED4963EE407) + sym[succ]), sym)
        n = np.where(pair, n + n[succ], n)
        keep = ~second
        sym, doc, n, lo, hi = name[keep], doc[keep], n[keep], lo[keep], hi[keep]
    return sym, n, lo, hi


def keys(w: K.Words, length: int, k: int = ROUNDS) -> np.ndarray:
    """A key for each window; those over a document's end don't count."""
    n = len(w.h) - length + 1
    sym, size, lo, hi = rounds(w, k)
    best = [np.zeros(n, np.uint64) for _ in range(length.bit_length())]
    value = (np.minimum(size, 63).astype(np.uint64) << U(58)) | (sym >> U(6))
    a, b = np.maximum(hi - length, 0), np.minimum(lo, n - 1)
    some = (b >= a) & (hi - lo <= length)
    a, b, value = a[some], b[some], value[some]
    level = np.frexp((b - a + 1).astype(float))[1] - 1
    for j in range(len(best)):
        i = level == j
        np.maximum.at(best[j], a[i], value[i])
        np.maximum.at(best[j], b[i] - (1 << j) + 1, value[i])
    for j in range(len(best) - 1, 0, -1):
        half = 1 << (j - 1)
        np.maximum(best[j - 1], best[j], out=best[j - 1])
        np.maximum(best[j - 1][half:], best[j][: max(0, n - half)], out=best[j - 1][half:])
    v = best[0]
    if (v == 0).any():
        v = np.where(v == 0, slide(w.h >> U(6), length, np.maximum)[:n] | U(1), v)
    return v


def slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """``f`` over each ``width`` neighbours."""
    n, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[:n], x[width - k : width - k + n])


def verified(h: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the strings occur twice; windows of equal hashes are compared by the hashes of their words, one by one."""
    at = windows(n, length)
    g = K.grams(h, length)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(g, kind="stable")
    out = np.zeros(len(at), bool)
    pair = np.flatnonzero(g[order][1:] == g[order][:-1])
    pair = pair[same(h, at[order[pair]], at[order[pair + 1]], length)]
    out[order[pair]] = out[order[pair + 1]] = True
    return out


def repeated_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start_word, end_word) of all passages of ``length`` words or more that occur again somewhere."""
    return repeated_spans(docs, keys, verified, length)

"""Exact repeated passages: every window of ``length`` words that occurs twice or more.

This is the frame that :mod:`substring_dedup` and :mod:`suffix_dedup` share. An operator
gives each window a key that depends on the window's words alone, so equal windows have
equal keys wherever they stand; consecutive windows with one key form a segment.

1. Each task names its segments: key, two fingerprints of the segment's words, place. Only
   these go through a shuffle, packed into arrays. Where all segments of a key are one
   string, its windows repeat if it occurs twice, and nothing else has to be read. Windows
   that repeat within one segment are added as segments of their own.
2. For keys with several different strings, one segment of each string sends its words.
   The operator decides which of their windows repeat.
3. The repeated windows go back to their documents and are merged into spans.

What equality rests on: words are compared by their 64-bit hashes. In step 2 windows are
compared word by word. In step 1 two segments are one string if their lengths and both
fingerprints agree, 128 bits; one is a polynomial of the words' hashes, the other of the
mixed hashes of all windows, so what makes one of them collide by its structure (regular
sequences of two symbols do) doesn't the other.

No step has a cap; a key's segments meet in one task as places (48 bytes each), its
distinct strings as words. Very long texts are taken whole, in memory proportional to their
words.

A null or short text has no window. Rows that repeat a doc_id and text are copies of each
other, so all their windows repeat; they have one set of spans. Equal texts of different
doc_ids have spans each, so ties need no order. Null doc_ids are kept as null. An empty
table has no span. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkit as K
from lodestrata.runtime import cut, partitions, ship

U = np.uint64
SEG = np.dtype([("key", "<u8"), ("fp", "<u8"), ("fq", "<u8"), ("uid", "<i8"), ("start", "<i4"), ("nwin", "<i4")])
RUN = np.dtype([("key", "<u8"), ("uid", "<i8"), ("start", "<i4"), ("nwin", "<i4"), ("kind", "<i4")])
FOUND, ASKED, SHOWN = 0, 1, 2  # windows that repeat; words needed, verdict needed; words needed only

Keys = Callable[[K.Words, int], np.ndarray]
Verdict = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def segments(w: K.Words, uid: np.ndarray, keys: Keys, length: int) -> np.ndarray:
    """The segments of a slice of documents."""
    n = len(w.h) - length + 1
    if n <= 0:
        return np.zeros(0, SEG)
    doc = K.doc_of(w.off)
    ok = doc[:n] == doc[length - 1 :]
    v = keys(w, length)
    first = ok.copy()
    first[1:] &= ~((v[1:] == v[:-1]) & ok[:-1] & (doc[1:n] == doc[: n - 1]))
    s = np.flatnonzero(first)
    valid = np.flatnonzero(ok)
    count = np.diff(np.append(np.searchsorted(valid, s), len(valid)))
    acc = K.prefix(w.h)
    out = np.zeros(len(s), SEG)
    out["key"], out["fp"] = v[s], K.spans(acc, s, s + count + length - 1)
    every = K.mix(K.grams(w.h, length) ^ U(0x6A09E667F3BCC909))
    acc2 = K.prefix(every)
    out["fq"] = K.spans(acc2, s, s + count)
    out["uid"], out["start"], out["nwin"] = uid[doc[s]], s - w.off[doc[s]], count
    seg = np.repeat(np.arange(len(s), dtype=np.uint64), count)
    wh = K.spans(acc, valid, valid + length)
    tagged = K.mix(wh + seg * U(0x9E3779B97F4A7C15))
    again = tagged.copy()
    again.sort()
    again = np.unique(again[1:][again[1:] == again[:-1]])
    if len(again):
        at = np.searchsorted(again, tagged)
        at = np.flatnonzero(again[np.minimum(at, len(again) - 1)] == tagged)
        own = np.zeros(len(at), SEG)
        own["key"], own["fp"], own["fq"] = K.mix(wh[at]), wh[at], every[valid[at]]
        p = valid[at]
        own["uid"], own["start"], own["nwin"] = uid[doc[p]], p - w.off[doc[p]], 1
        out = np.concatenate([out, own])
    return out


def parcels(rows: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows packed by bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    return [int(b[i]) for i in np.concatenate([[0], cuts])] if len(b) else [], [x.tobytes() for x in np.split(rows[order], cuts)] if len(b) else []


def unpack(col: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype)


def decide(t: np.ndarray) -> np.ndarray:
    """Which segments repeat, and which have to send their words, from all segments of some keys."""
    t = t[np.lexsort((t["start"], t["uid"], t["nwin"], t["fq"], t["fp"], t["key"]))]
    new_key = np.ones(len(t), bool)
    new_key[1:] = t["key"][1:] != t["key"][:-1]
    new = new_key.copy()
    new[1:] |= (t["fp"][1:] != t["fp"][:-1]) | (t["fq"][1:] != t["fq"][:-1]) | (t["nwin"][1:] != t["nwin"][:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(t))) > 1
    key = np.cumsum(new_key[at]) - 1
    mixed = np.bincount(key)[key] > 1  # strings of this key
    found = t[np.repeat(many, np.diff(np.append(at, len(t))))]
    sent = t[at[mixed]]
    out = np.zeros(len(found) + len(sent), RUN)
    for c in ("key", "uid", "start", "nwin"):
        out[c] = np.concatenate([found[c], sent[c]])
    out["kind"] = np.concatenate([np.full(len(found), FOUND), np.where(many[mixed], SHOWN, ASKED)])
    return out


def merged(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end of the union of the windows."""
    t = t[np.lexsort((t["start"], t["uid"]))]
    ids, doc = np.unique(t["uid"], return_inverse=True)
    s = t["start"].astype(np.int64)
    e = s + t["nwin"] + length - 1
    base = doc.astype(np.int64) << 33
    far = np.maximum.accumulate(base + e)
    first = np.ones(len(t), bool)
    first[1:] = base[1:] + s[1:] > far[:-1]
    at = np.flatnonzero(first)
    ends = far[np.append(at[1:] - 1, len(t) - 1)] if len(t) else far
    return ids[doc[at]], s[at], ends - base[at]


def repeated_spans(docs: DataFrame, keys: Keys, verdict: Verdict, length: int) -> DataFrame:
    """(doc_id, start_word, end_word) of the passages that the repeated windows cover, the end exclusive."""
    ship(docs.sparkSession)
    nb = partitions(docs.sparkSession)
    nu = 8 * nb
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("uid"), "text")

    def name(batches):
        for b in batches:
            for part in K.slices(b):
                t = segments(K.words(part.column("text")), part.column("uid").to_numpy(), keys, length)
                k, x = parcels(t, (K.mix(t["key"]) % U(nb)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["b", "rows"])

    def places(t: np.ndarray) -> pa.Table:
        ask = t["kind"] != FOUND
        out = [parcels(x, x["uid"] % nu) for x in (t[~ask], t[ask])]
        return pa.table({"ub": pa.array(out[0][0] + out[1][0], pa.int32()), "ask": pa.array([False] * len(out[0][0]) + [True] * len(out[1][0])), "rows": pa.array(out[0][1] + out[1][1], pa.binary())})

    named = rows.select("uid", "text").mapInArrow(name, "b int, rows binary")
    decided = cut(named.groupBy("b").applyInArrow(lambda t: places(decide(unpack(t["rows"], SEG))), "ub int, ask boolean, rows binary"))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        b, recs, words = [], [], []
        if left.num_rows and right.num_rows:
            ask = np.sort(unpack(right["rows"], RUN), order=["uid", "start"])
            uid, first = np.unique(left["uid"].to_numpy(), return_index=True)
            left = left.take(pa.array(first[np.isin(uid, ask["uid"])])).combine_chunks()
            for part in K.slices(left):
                u = part["uid"].to_numpy()
                w = K.words(part["text"])
                own = ask[np.isin(ask["uid"], u)]
                row = np.argsort(u)[np.searchsorted(np.sort(u), own["uid"])]
                at = w.off[row] + own["start"]
                bucket = (K.mix(own["key"].copy()) % U(nb)).astype(np.int64)
                for k in np.unique(bucket):
                    i = np.flatnonzero(bucket == k)
                    n = own["nwin"][i] + length - 1
                    src = np.repeat(at[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    b.append(int(k))
                    recs.append(own[i].tobytes())
                    words.append(w.h[src].tobytes())
        return pa.table({"b": pa.array(b, pa.int32()), "rows": pa.array(recs, pa.binary()), "words": pa.array(words, pa.binary())})

    def judge(t: pa.Table) -> pa.Table:
        own, h = unpack(t["rows"], RUN), unpack(t["words"], np.dtype("<u8"))
        hit = verdict(h, own["nwin"] + length - 1, length)
        n = own["nwin"].astype(np.int64)
        seg = np.repeat(np.arange(len(own)), n)
        pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit &= (own["kind"] == ASKED)[seg]
        seg, pos = seg[hit], pos[hit]
        first = np.ones(len(seg), bool)
        first[1:] = (seg[1:] != seg[:-1]) | (pos[1:] != pos[:-1] + 1)
        at = np.flatnonzero(first)
        out = np.zeros(len(at), RUN)
        out["uid"], out["start"], out["nwin"] = own["uid"][seg[at]], own["start"][seg[at]] + pos[at], np.diff(np.append(at, len(seg)))
        return places(out).select(["ub", "rows"])

    ub = F.pmod("uid", F.lit(nu)).cast("int").alias("ub")
    asked, found = decided.where("ask").select("ub", "rows"), decided.where("not ask").select("ub", "rows")
    sent = rows.select(ub, "uid", "text").groupBy("ub").cogroup(asked.groupBy("ub")).applyInArrow(send, "b int, rows binary, words binary")
    judged = sent.groupBy("b").applyInArrow(judge, "ub int, rows binary")

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"doc_id": pa.array([], pa.int64()), "start_word": pa.array([], pa.int32()), "end_word": pa.array([], pa.int32())})
        uid, s, e = merged(unpack(right["rows"], RUN), length)
        have, first = np.unique(left["uid"].to_numpy(), return_index=True)
        at = pa.array(first[np.searchsorted(have, uid)])
        return pa.table({"doc_id": left["doc_id"].take(at), "start_word": pa.array(s.astype(np.int32)), "end_word": pa.array(e.astype(np.int32))})

    known = rows.select(ub, "uid", "doc_id").groupBy("ub")
    return known.cogroup(found.union(judged).groupBy("ub")).applyInArrow(spell, "doc_id long, start_word int, end_word int")


def windows(n: np.ndarray, length: int) -> np.ndarray:
    """Place of every window of strings of ``n`` words that stand one behind the other."""
    k = n - length + 1
    return np.repeat(np.cumsum(n) - n - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))


def same(h: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at ``a`` and ``b`` have the same words."""
    out = np.ones(len(a), bool)
    for k in range(length):
        out &= h[a + k] == h[b + k]
    return out

"""Benchmark decontamination: a hash set of normalised test n-grams, scanned for in every document.

The n-grams (words as in textkit) of the test items form a sorted hash set that goes to
the executors while it holds at most ``broadcast_limit`` entries, which is checked. Beyond
that only a bit set of at most ``FILTER_BITS`` bits goes to them: windows that pass it are
joined with the test n-grams by a shuffle, on hash and words. Either way each hit is
verified word by word, nothing that grows with either table is collected, and results are
the same. Overlapping or touching windows form one span. An item with fewer than ``n``
words, but ``shortest`` at least, is looked for as a whole; shorter items are never looked for.

Null or empty texts have no windows. Very long texts are scanned whole, in memory
proportional to their words. Repeated documents have equal spans each, repeated items
count once; no result depends on an order. An empty test table gives no span, an empty
table of documents an empty result. Extra columns are ignored by :func:`contaminated_spans`
and kept by :func:`remove_documents` and :func:`remove_spans`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import textkit as K
from lodestrata.runtime import cut, fresh, ship

N, SHORTEST = 8, 5
BROADCAST_LIMIT, FILTER_BITS = 200_000, 1 << 29
PATTERN = "[0-9a-z\\x{80}-\\x{10FFFF}]+"


def test_grams(benchmark: DataFrame, n: int, shortest: int) -> DataFrame:
    """(hash, len, gram) of the test items; a gram is its words with blanks between."""

    def run(batches):
        for b in batches:
            for part in K.slices(b):
                w = K.words(part.column("text"))
                hs, ls, gs = [], [], []
                for i in range(part.num_rows):
                    s, e = int(w.off[i]), int(w.off[i + 1])
                    k = min(n, e - s)
                    if k < shortest:
                        continue
                    said = [w.data[x:y].tobytes().decode() for x, y in zip(w.start[s:e], w.end[s:e])]
                    hs += K.grams(w.h[s:e], k).view(np.int64).tolist()
                    ls += [k] * (e - s - k + 1)
                    gs += [" ".join(said[j : j + k]) for j in range(e - s - k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ls, pa.int32()), pa.array(gs, pa.string())], ["hash", "len", "gram"])

    return benchmark.select("text").mapInArrow(run, "hash long, len int, gram string").distinct()


def _finder(grams: list[tuple[int, int, str]]):
    """A function from a text column to verified hits: document, first word, words."""
    by = {}
    for h, k, g in grams:
        by.setdefault(k, {}).setdefault(h, set()).add(g)
    sets = {k: np.array(sorted(x), np.int64) for k, x in by.items()}

    def run(col: pa.Array):
        w = K.words(col)
        doc, out = K.doc_of(w.off), []
        for k, known in sets.items():
            h = K.grams(w.h, k).view(np.int64)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            at = at[doc[at] == doc[at + k - 1]]
            for i in at.tolist():
                if " ".join(w.data[x:y].tobytes().decode() for x, y in zip(w.start[i : i + k], w.end[i : i + k])) in by[k][int(h[i])]:
                    out.append((int(doc[i]), i - int(w.off[doc[i]]), k))
        return w, sorted(out)

    return run


def merge(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(document, first word, end, windows) of each run of hits that overlap or touch."""
    out: list[tuple[int, int, int, int]] = []
    for d, s, k in hits:
        if out and out[-1][0] == d and s <= out[-1][2]:
            out[-1] = (d, out[-1][1], max(out[-1][2], s + k), out[-1][3] + 1)
        else:
            out.append((d, s, s + k, 1))
    return out


def _known(benchmark: DataFrame, n: int, shortest: int, limit: int) -> tuple[list | None, DataFrame]:
    """The test grams, and as a list if there are at most ``limit`` of them."""
    ship(benchmark.sparkSession)
    grams = cut(test_grams(benchmark, n, shortest))
    got = grams.limit(limit + 1).collect()
    return ([tuple(r) for r in got] if len(got) <= limit else None), grams


SPAN = "doc_id long, start_word int, end_word int, n_windows int"


def _bit_set(grams: DataFrame, top: int) -> np.ndarray:
    """Bits of the hashes, 16 for each of them up to ``top`` in all; two bits tell of a hash."""
    size = min(1 << (top.bit_length() - 1), max(1 << 10, 1 << (16 * grams.count()).bit_length()))  # a power of 2
    part = max(8, size >> 8)  # bits of a segment; there are 256 at most

    def segment(t: pa.Table) -> pa.Table:
        s = t["segment"][0].as_py()
        bits = np.zeros(part, bool)
        bits[t["bit"].to_numpy() - s * part] = True
        return pa.table({"segment": [s], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    def places(batches):
        for b in batches:
            at = np.unique(np.concatenate(_bits(b.column("hash").to_numpy().view(np.uint64), size)))
            yield pa.RecordBatch.from_arrays([pa.array(at // part), pa.array(at)], ["segment", "bit"])

    got = grams.select("hash").mapInArrow(places, "segment long, bit long").distinct().groupBy("segment").applyInArrow(segment, "segment long, bits binary").toArrow()
    out = np.zeros(size // 8, np.uint8)
    for s, x in zip(got["segment"].to_pylist(), got["bits"].to_pylist()):
        out[s * part // 8 : (s + 1) * part // 8] = np.frombuffer(x, np.uint8)
    return out


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(size - 1)
    return (h & m).astype(np.int64), (K.mix(h + np.uint64(0x5851F42D4C957F2D)) & m).astype(np.int64)


def lit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _shuffled_hits(docs: DataFrame, grams: DataFrame, top: int) -> DataFrame:
    """(doc_id, th, s, k): verified windows of each distinct document, by a join with the test grams; th is a hash of the text."""
    lens = [r[0] for r in grams.select("len").distinct().collect()]  # n at most
    known = _bit_set(grams, top)
    held = docs.sparkSession.sparkContext.broadcast(known)  # FILTER_BITS at most
    size = len(known) * 8

    def run(batches):
        bits = held.value
        for b in batches:
            for part in K.slices(b):
                w = K.words(part.column("text"))
                doc, rows = K.doc_of(w.off), [[], [], [], [], []]
                for k in lens:
                    if len(w.h) < k:
                        continue
                    h = K.grams(w.h, k)
                    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
                    x, y = _bits(h[at], size)
                    at = at[lit(bits, x) & lit(bits, y)]
                    rows[0].append(doc[at])
                    rows[1].append(h[at].view(np.int64))
                    rows[2] += [k] * len(at)
                    rows[3].append(at - w.off[doc[at]])
                    rows[4] += [" ".join(w.data[x:y].tobytes().decode() for x, y in zip(w.start[i : i + k], w.end[i : i + k])) for i in at.tolist()]
                d, h, s = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (rows[0], rows[1], rows[3]))
                d = pa.array(d)
                yield pa.RecordBatch.from_arrays([K.column(part, "doc_id").cast(pa.int64()).take(d), K.column(part, "th").take(d), pa.array(h, pa.int64()), pa.array(rows[2], pa.int32()), pa.array(s.astype(np.int32)), pa.array(rows[4], pa.string())], ["doc_id", "th", "hash", "len", "s", "gram"])

    near = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, hash long, len int, s int, gram string")
    return near.join(grams, ["hash", "len", "gram"], "left_semi").select("doc_id", "th", "s", F.col("len").alias("k")).distinct()


def _shuffled_spans(docs: DataFrame, grams: DataFrame, top: int) -> DataFrame:
    """(doc_id, th, start_word, end_word, n_windows) of each distinct document."""
    w = Window.partitionBy("doc_id", "th").orderBy("s", "k")
    hits = _shuffled_hits(docs, grams, top).withColumn("far", F.max(F.col("s") + F.col("k")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    hits = hits.withColumn("run", F.sum(F.when(F.col("s") <= F.col("far"), 0).otherwise(1)).over(w))
    spans = hits.groupBy("doc_id", "th", "run").agg(F.min("s").alias("start_word"), F.max(F.col("s") + F.col("k")).alias("end_word"), F.count("*").cast("int").alias("n_windows"))
    return spans.drop("run")


def _beside(docs: DataFrame, found: DataFrame, how: str) -> tuple[DataFrame, list[str]]:
    """``docs`` joined with rows of the same (doc_id, th); the other columns of ``found`` under names that ``docs`` doesn't have."""
    names = fresh(docs, "th", *(f"f_{c}" for c in found.columns))
    th, own = names[0], names[1:]
    r = found.toDF(*own)
    d, t = own[found.columns.index("doc_id")], own[found.columns.index("th")]
    out = docs.withColumn(th, F.xxhash64("text")).join(r, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t)), how)
    return out, own


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, shortest: int = SHORTEST, broadcast_limit: int = BROADCAST_LIMIT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, start_word, end_word, n_windows) of every span of test n-grams, the end exclusive."""
    known, grams = _known(benchmark, n, shortest, broadcast_limit)
    if known is None:
        out, own = _beside(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _shuffled_spans(docs, grams, filter_bits), "inner")
        return out.select("doc_id", *(F.col(c).alias(c.removeprefix("f_").rstrip("_")) for c in own[2:]))
    find = _finder(known)

    def run(batches):
        for b in batches:
            for part in K.slices(b):
                got = merge(find(part.column("text"))[1])
                ids = K.column(part, "doc_id").cast(pa.int64())
                d, s, e, c = zip(*got) if got else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d, pa.int64())), *(pa.array(x, pa.int32()) for x in (s, e, c))], ["doc_id", "start_word", "end_word", "n_windows"])

    return docs.select("doc_id", "text").mapInArrow(run, SPAN)


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, shortest: int = SHORTEST, broadcast_limit: int = BROADCAST_LIMIT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` without any test n-gram, all columns as they were."""
    known, grams = _known(benchmark, n, shortest, broadcast_limit)
    if known is None:
        return _beside(docs, _shuffled_hits(docs, grams, filter_bits).select("doc_id", "th").distinct(), "left_anti")[0].select(*docs.columns)
    find = _finder(known)

    def run(batches):
        for b in batches:
            for part in K.slices(b):
                keep = np.ones(part.num_rows, bool)
                keep[[h[0] for h in find(part.column("text"))[1]]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, shortest: int = SHORTEST, broadcast_limit: int = BROADCAST_LIMIT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with every span of test n-grams cut out of ``text``, from its first word's start to its last word's end."""
    known, grams = _known(benchmark, n, shortest, broadcast_limit)
    find, given, held = _finder(known or []), docs, None
    if known is None:
        holes = _shuffled_spans(docs, grams, filter_bits).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.array("start_word", "end_word"))).alias("holes"))
        given, own = _beside(docs, holes, "left")
        held = own[2]
        given = given.select(*docs.columns, held)

    def run(batches):
        for b in batches:
            for part in K.slices(b):
                if held is None:
                    spans = [(d, x, y) for d, x, y, _ in merge(find(part.column("text"))[1])]
                else:
                    spans = [(d, x, y) for d, own in enumerate(part.column(held).to_pylist()) for x, y in own or ()]
                    part = part.drop_columns([held])
                if spans:
                    raw, off = K.flat(part.column("text"), lower=False)
                    s, e = K.bounds(raw, off)
                    first = np.searchsorted(s, off)
                    texts = part.column("text").to_pylist()
                    cuts: dict[int, list[tuple[int, int]]] = {}
                    for d, x, y in spans:
                        at = int(first[d])
                        cuts.setdefault(d, []).append((int(s[at + x] - off[d]), int(e[at + y - 1] - off[d])))
                    for d, gaps in cuts.items():
                        own, at, left = texts[d].encode(), 0, []
                        for x, y in gaps:
                            left.append(own[at:x])
                            at = y
                        texts[d] = b"".join([*left, own[at:]]).decode()
                    i = part.schema.get_field_index("text")
                    part = part.set_column(i, part.schema.field(i), pa.array(texts, part.schema.field(i).type))
                yield part

    return given.mapInArrow(run, docs.schema)

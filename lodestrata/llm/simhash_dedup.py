"""SimHash near-dedup with an LSH forest.

A document's signature has 256 bits: the signs of the summed hashes of its word pairs (of
its words, if it has one only). Two documents are near duplicates if their signatures
differ in ``radius`` bits at most; groups are the connected components of that relation.

Equal signatures are collapsed first. The rest goes into ``trees`` prefix trees, each over
the bits in a random order of its own; their number is a parameter and doesn't grow with
the table. A tree is its signatures in sorted order, cut into parts at quantiles of a
bounded sample, so a part holds about equally many wherever the signatures are dense.

Every tree descends until a node holds ``node`` signatures at most: prefixes are long where
signatures are dense and short where they are sparse. All pairs of such a node are compared
on the whole signature. The pairs found tell how many there are: a pair at distance r is in
one node of depth d with a known chance, so each stands for the inverse of it (a document
with many partners counts once). While the share found by all trees together is below
``recall``, all trees climb to shorter prefixes at once, to nodes four times as large, and
compare again; at last one node holds everything and the comparison is exact.

Documents without words (null or empty text) belong to no group. Very long texts are read
whole, in memory proportional to their words. Rows that repeat a doc_id and text are one
document with copies. A null doc_id is kept as it is: such rows have signatures and groups,
but a group's name is its least doc_id that isn't null, if any; of several texts of that
doc_id the one of least hash stays. Pairs at exactly ``radius`` count. An empty table gives
no group. Extra columns are ignored by :func:`groups` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import textkit as K
from lodestrata.operators.graph import connected_components
from lodestrata.runtime import cut, fresh, ship

U = np.uint64
BITS, RADIUS, RECALL, NODE, TREES = 256, 58, 0.95, 1024, 24
SAMPLE, NODES = 65536, 16  # signatures that the trees' parts are cut by, at most; nodes a part holds, at least
KEY = np.dtype("S32")


def signatures(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as four 64-bit words a document, and whether it has words."""
    n, doc = len(w.off) - 1, K.doc_of(w.off)
    count = np.diff(w.off)
    if len(w.h) > 1:
        g = K.grams(w.h, 2)
        same = doc[1:] == doc[:-1]
        g, d = g[same], doc[1:][same]
    else:
        g, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    alone = count == 1
    g, d = np.concatenate([g, K.mix(w.h[w.off[:-1][alone]])]), np.concatenate([d, np.flatnonzero(alone)])
    signs = ((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2.0 - 1
    out = np.zeros((n, 4, 8), np.uint8)
    base = d << 8
    for k in range(4):
        x = K.mix(g + U((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        for j, byte in enumerate(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)):
            hist = np.bincount(base + byte, minlength=n << 8).reshape(n, 256)
            out[:, k, j] = np.packbits(hist @ signs > 0, axis=1, bitorder="little")[:, 0]
    return out.reshape(n, 32).view(np.uint64), count > 0


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, th, sig) of the rows with words; th is a hash of the text as written."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for part in K.slices(b):
                s, some = signatures(K.words(part.column("text")))
                t = pa.RecordBatch.from_arrays([K.column(part, "doc_id").cast(pa.int64()), K.column(part, "th"), pa.array([x.tobytes() for x in s], pa.binary())], ["doc_id", "th", "sig"])
                yield t.filter(pa.array(some))

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, sig binary")


def permuted(s: np.ndarray, tree: int) -> np.ndarray:
    """The signatures' bits in the tree's own order, as strings that sort by them."""
    order = np.random.default_rng([97, tree]).permutation(BITS)
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(KEY).ravel()


def chance(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """That ``d`` random bits of two signatures agree that differ in ``r``."""
    table = np.ones((BITS + 1, BITS + 1))
    for i in range(BITS):
        table[:, i + 1] = table[:, i] * np.maximum(BITS - i - np.arange(BITS + 1), 0) / (BITS - i)
    return table[r, d]


def recall_of(r: np.ndarray, d: np.ndarray, weight: np.ndarray, trees: int) -> float:
    """Share of all pairs that ``trees`` trees find, from those that they found: at distance r in nodes of depth d."""
    each = chance(r, d)
    there = weight / np.maximum(each, 1e-9)
    return float((there * (1 - (1 - each) ** trees)).sum() / there.sum()) if len(r) else 1.0


def close(s: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows that differ in ``radius`` bits at most."""
    a, b = [], []
    t = np.ascontiguousarray(s.T)
    for i in range(0, len(s), block):
        to = min(len(s), i + block)
        part = np.bitwise_count(t[0, i:to, None] ^ t[0, i:]) + np.bitwise_count(t[1, i:to, None] ^ t[1, i:])
        x, y = np.nonzero(part <= radius)
        x, y = x[y > x] + i, y[y > x] + i
        rest = np.bitwise_count(s[x] ^ s[y]).sum(axis=1, dtype=np.int64)
        a.append(x[rest <= radius])
        b.append(y[rest <= radius])
    return np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])


def least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each row's component."""
    lab = np.arange(n)
    while len(a):
        new = lab.copy()
        m = np.minimum(lab[a], lab[b])
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, lab[a], m)
        np.minimum.at(new, lab[b], m)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def nodes(bits: np.ndarray, node: int) -> list[tuple[int, int, int]]:
    """(begin, end, depth) of the nodes of a sorted part, from rows of bits: the shallowest with ``node`` signatures at most."""
    out, todo = [], [(0, len(bits), 0)]
    while todo:
        s, e, d = todo.pop()
        if e - s <= node or d == BITS:
            out.append((s, e, d))
            continue
        m = s + int(np.searchsorted(bits[s:e, d], 1))
        todo += [x for x in ((s, m, d + 1), (m, e, d + 1)) if x[1] - x[0] > 1]
    return out


def _search(sigs: DataFrame, n: int, cuts: list[np.ndarray], trees: int, radius: int, node: int, spanning: bool) -> DataFrame:
    """(a, b) of pairs, and rows (r, d, w) of how many were found at which distance and depth."""
    base = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])

    def plant(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(-1, 4)
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            for t in range(trees):
                part = np.searchsorted(cuts[t], permuted(s, t), "right")
                order = np.argsort(part, kind="stable")
                pieces = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
                rows = [(int(base[t] + part[o[0]]), s[o].tobytes(), ids[o].tobytes()) for o in pieces]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["part", "sigs", "ids"])

    def search(t: pa.Table) -> pa.Table:
        tree = int(np.searchsorted(base, t.column("part")[0].as_py(), "right")) - 1
        s = np.frombuffer(b"".join(t.column("sigs").to_pylist()), np.uint64).reshape(-1, 4)
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), np.int64)
        key = permuted(s, tree)
        order = np.argsort(key)
        s, ids = s[order], ids[order]
        bits = np.unpackbits(key[order].view(np.uint8).reshape(-1, BITS // 8), axis=1)
        a, b, seen = [], [], np.zeros((radius + 1, BITS + 1))
        for x, y, d in nodes(bits, node):
            i, j = close(s[x:y], radius)
            if not len(i):
                continue
            k = np.bincount(np.concatenate([i, j]), minlength=y - x)
            r = np.bitwise_count(s[x:y][i] ^ s[x:y][j]).sum(axis=1, dtype=np.int64)
            seen[:, d] += np.bincount(r, 0.5 / k[i] + 0.5 / k[j], minlength=radius + 1)
            if spanning:
                lab = least(y - x, i, j)
                i = np.flatnonzero(lab != np.arange(y - x))
                j = lab[i]
            a.append(ids[x:y][i])
            b.append(ids[x:y][j])
        a, b = np.concatenate(a or [ids[:0]]), np.concatenate(b or [ids[:0]])
        r, d = np.nonzero(seen)
        none = lambda k, kind: pa.nulls(k, kind)
        return pa.table({
            "a": pa.concat_arrays([pa.array(a, pa.int64()), none(len(r), pa.int64())]), "b": pa.concat_arrays([pa.array(b, pa.int64()), none(len(r), pa.int64())]), "r": pa.concat_arrays([none(len(a), pa.int32()), pa.array(r, pa.int32())]),
            "d": pa.concat_arrays([none(len(a), pa.int32()), pa.array(d, pa.int32())]), "w": pa.concat_arrays([none(len(a), pa.float64()), pa.array(seen[r, d])]),
        })

    return sigs.select("id", "sig").mapInArrow(plant, "part long, sigs binary, ids binary").groupBy("part").applyInArrow(search, "a long, b long, r int, d int, w double")


def near_edges(sigs: DataFrame, radius: int = RADIUS, recall: float = RECALL, node: int = NODE, spanning: bool = True, trees: int = TREES) -> DataFrame:
    """(a, b): pairs of ids within the radius, from (id, sig); with ``spanning`` only as many as join their components."""
    spark = sigs.sparkSession
    ship(spark)
    n = sigs.count()
    first = sigs.orderBy(F.xxhash64(F.lit(5), "sig")).limit(SAMPLE).select("sig").toArrow()["sig"].to_pylist() if n > NODES * node else []
    sample = np.frombuffer(b"".join(first), np.uint64).reshape(-1, 4)
    while True:
        used = trees if n > node else 1  # one node holds them all
        parts = max(1, min(n // (NODES * node), len(sample) // 8))
        cuts = []
        for t in range(used):
            key = np.sort(permuted(sample, t)) if parts > 1 else np.zeros(0, KEY)
            cuts.append(key[np.arange(1, parts) * len(key) // parts] if parts > 1 else key)
        found = cut(_search(sigs, n, cuts, used, radius, node, spanning))
        if used == 1:
            break
        seen = found.where("r is not null").groupBy("r", "d").agg(F.sum("w").alias("w")).toArrow()  # a row for each distance and depth
        if recall_of(seen["r"].to_numpy(), seen["d"].to_numpy(), seen["w"].to_numpy(), used) >= recall:
            break
        node *= 4
    return found.where("r is null").select("a", "b")


def _grouped(docs: DataFrame, radius: int, recall: float, node: int) -> tuple[DataFrame, DataFrame]:
    """Distinct documents (doc_id, th, n) and their groups (doc_id, th, group_id, keeper_th, n_docs)."""
    rows = cut(sign(docs).groupBy("doc_id", "th", "sig").agg(F.count("*").alias("n")))
    sigs = cut(rows.groupBy("sig").agg(F.count("*").alias("members")).withColumn("id", F.monotonically_increasing_id()))
    comp = connected_components(near_edges(sigs, radius, recall, node))
    named = sigs.join(comp, sigs.id == comp.node, "left").where("members > 1 or component is not null")
    named = named.select("sig", F.coalesce("component", "id").alias("component"))
    found = rows.join(named, "sig")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"), F.count("*").alias("n_docs"))
    return rows, found.join(first, "component").select("doc_id", "th", F.col("k.doc_id").alias("group_id"), F.col("k.th").alias("keeper_th"), "n_docs")


def groups(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, node: int = NODE) -> DataFrame:
    """(doc_id, group_id) of every document that has a near duplicate; group_id is the group's least doc_id, the one to keep."""
    rows, found = _grouped(docs, radius, recall, node)
    again = rows.where("n > 1").select("doc_id", F.col("doc_id").alias("group_id"))
    return found.select("doc_id", "group_id").union(again.join(found, "doc_id", "left_anti"))


def keep_one(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, node: int = NODE) -> DataFrame:
    """``docs`` with one row of each group (the least doc_id; of repeated rows, one), all columns as they were."""
    rows, found = _grouped(docs, radius, recall, node)
    th, d, t, r = fresh(docs, "th", "d", "t", "r")
    lose = found.where("not (doc_id <=> group_id and th = keeper_th)").select(F.col("doc_id").alias(d), F.col("th").alias(t))
    again = rows.where("n > 1").select(F.col("doc_id").alias(d), F.col("th").alias(t))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t))
    kept = docs.withColumn(th, F.xxhash64("text")).join(lose, same, "left_anti")
    more = kept.join(again, same, "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", th).orderBy(*[c for c, k in docs.dtypes if k in ("string", "bigint", "int", "double")]))
    more = more.withColumn(r, first).where(F.col(r) == 1).drop(r)
    return kept.join(again, same, "left_anti").union(more).drop(th)

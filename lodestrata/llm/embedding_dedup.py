"""Embedding near-dedup by product quantisation.

Vectors are scaled to length 1; two are near duplicates if their cosine is ``cosine`` at
least, which is a distance of D = sqrt(2 - 2 cosine) at most. Groups are the connected
components of that relation.

Coarse centroids (about the square root of the number of vectors) and the codebooks of the
residuals' subspaces are fitted by passes over all vectors. Each vector is stored in the
inverted list of its nearest centroid with its codes and the length of the error they
make. Every vector is a query and probes the lists of its nearest centroids. How many is
measured: each vector is moved by D in a random direction; it and its moved copy may find
each other from either side, and the probes have to suffice for the share ``recall`` of
these pairs. Closer pairs are found more often. Lists whose radius plus D doesn't reach the
query are left out. Queries and members go to the lists as half-precision vectors, members
with their codes. Table look-ups give the distance to a member's decoded vector; a member
stays a candidate if that is D plus the member's error and the rounding at most, so none
within D is lost here. Candidates are then ranked by the cosine of the halves, which is
right to within ``BAND``; those that are nearer than that to the threshold are decided by the
exact cosine of their whole vectors, fetched for them alone. Lists are split into blocks of
members and of queries, so no task holds more than a block of each.

At a recall of 1 there are no lists, as each vector would go to nearly all of them: the vectors are dealt
into blocks of ``WIDE`` at most, and every two blocks are multiplied in a task of their own.

Null vectors, vectors of another dimension than most, with nulls or NaNs, and zero vectors
are in no group, nor is a null vec_id. Equal vectors are collapsed first. Repeated rows of
a vec_id count once if their vectors are equal; otherwise the vec_id takes part with each.
Pairs at exactly ``cosine`` count, and of equal distances to two centroids the first. Vectors of
any length are taken whole. An empty table gives no group. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.simhash_dedup import least
from lodestrata.operators.graph import connected_components
from lodestrata.runtime import cut, ship

COSINE, SUBSPACES, CODES, ROUNDS, BLOCK, RECALL = 0.95, 8, 256, 3, 4096, 0.999
SLACK = 1e-5  # for rounding
WIDE, COPIES, PAIRS = 1 << 15, 1 << 18, 1 << 22  # vectors of a block at a recall of 1; copies of vectors that are dealt out at once; pairs that a task holds before it keeps those that join components
HALF, BAND = 5e-4, 1.2e-3  # of a half-precision unit vector: its error's length at most; error of a cosine of two


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def _blocks(n: int, width: int) -> list[slice]:
    """Row ranges whose distances to ``width`` points take some 16 MB."""
    step = max(1, (4 << 20) // max(1, width))
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def _nearest(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.concatenate([_square(v[b], points).argmin(axis=1) for b in _blocks(len(v), len(points))] or [np.zeros(0, np.int64)])


def unit_vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """(id, v): the usable vectors, scaled, as bytes; and their dimension, the most frequent one."""
    ship(table.sparkSession)
    known = table.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    most = known.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = most["n"] if most else 1
    known = known.where(F.size("embedding") == dim).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))

    def run(batches):
        for b in batches:
            flat = np.array(b.column("embedding").flatten(), dtype=np.float64).reshape(-1, dim)
            size = np.sqrt((flat * flat).sum(axis=1))
            ok = np.isfinite(size) & (size > 0)
            v = (flat[ok] / size[ok, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "v"])

    rows = known.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "id long, v binary"), dim


def _means(vectors: DataFrame, part, slots: int, width: int) -> np.ndarray:
    """Mean of what ``part`` assigns to each slot: batch -> (slots, rows); NaN where there is nothing."""

    def add(batches):
        for b in batches:
            slot, x = part(b)
            total = np.zeros((slots, width + 1))
            for j in range(width):
                total[:, j] = np.bincount(slot, x[:, j], minlength=slots)
            total[:, width] = np.bincount(slot, minlength=slots)
            at = np.flatnonzero(total[:, width])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([r.tobytes() for r in total[at]], pa.binary())], ["slot", "total"])

    def join(t: pa.Table) -> pa.Table:
        total = np.frombuffer(b"".join(t["total"].to_pylist())).reshape(-1, width + 1).sum(axis=0)
        return pa.table({"slot": t["slot"][:1], "total": pa.array([total.tobytes()], pa.binary())})

    got = vectors.mapInArrow(add, "slot long, total binary").groupBy("slot").applyInArrow(join, "slot long, total binary").toArrow()
    out = np.full((slots, width), np.nan)
    for s, t in zip(got["slot"].to_pylist(), got["total"].to_pylist()):
        x = np.frombuffer(t)
        out[s] = x[:-1] / x[-1]
    return out


def _joining(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as join the components of the edges (a, b)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = least(len(ids), at[: len(a)], at[len(a) :])
    at = np.flatnonzero(lab != np.arange(len(ids)))
    return ids[at], ids[lab[at]]


def exact_edges(vectors: DataFrame, n: int, dim: int, cosine: float = COSINE, spanning: bool = True) -> DataFrame:
    """As :func:`near_edges`, of all pairs of the ``n`` vectors: those of two blocks are compared in one task, which holds these blocks and a strip of their products."""
    ship(vectors.sparkSession)
    blocks = max(-(-n // WIDE), min(16, -(-n // 512)))

    def pack(batches):
        for b in batches:
            ids, v = b.column("id").to_numpy(), _matrix(b.column("v"), dim)
            block = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            parts = [x for x in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([int(block[x[0]]) for x in parts], pa.int32()), *(pa.array([y[x].tobytes() for x in parts], pa.binary()) for y in (ids, v))], ["block", "ids", "v"])

    def compare(key, t):
        low, high = (x.as_py() for x in key)
        block, (ids, v) = np.array(t["block"].to_pylist()), (t[c].to_pylist() for c in ("ids", "v"))
        take = lambda x, j, kind: np.frombuffer(b"".join(x[i] for i in np.flatnonzero(block == j)), kind)
        p, x, q, y = take(ids, low, np.int64), take(v, low, np.float32).reshape(-1, dim), take(ids, high, np.int64), take(v, high, np.float32).reshape(-1, dim)
        a, b, held = [], [], 0
        for i in range(0, len(p), 128):
            near = np.flatnonzero(x[i : i + 128] @ y.T >= np.float32(cosine - SLACK))
            for s in range(0, len(near), 1 << 16):
                r, c = np.divmod(near[s : s + (1 << 16)], len(q))
                r, c = r[p[i + r] != q[c]] + i, c[p[i + r] != q[c]]
                ok = (x[r].astype(np.float64) * y[c]).sum(axis=1) >= cosine
                a.append(p[r[ok]])
                b.append(q[c[ok]])
                held += len(a[-1])
                if spanning and held > PAIRS:
                    a, b = ([z] for z in _joining(np.concatenate(a), np.concatenate(b)))
                    held = 0
        a, b = (np.concatenate(z or [np.zeros(0, np.int64)]) for z in (a, b))
        return pa.table(dict(zip("ab", _joining(a, b) if spanning else (a, b))))

    j = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j")
    pairs = vectors.mapInArrow(pack, "block int, ids binary, v binary").select("block", "ids", "v", j)
    return pairs.groupBy(F.least("block", "j").alias("low"), F.greatest("block", "j").alias("high")).applyInArrow(compare, "a long, b long")


def near_edges(vectors: DataFrame, dim: int, cosine: float = COSINE, subspaces: int = SUBSPACES, codes: int = CODES, block: int = BLOCK, spanning: bool = True, recall: float = RECALL) -> DataFrame | None:
    """(a, b): pairs of ids whose cosine is ``cosine`` at least, from distinct (id, v); with ``spanning`` only as many as join their components."""
    ship(vectors.sparkSession)
    n = vectors.count()
    if n < 2:
        return None
    if recall >= 1:
        return exact_edges(vectors, n, dim, cosine, spanning)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    k = math.ceil(math.sqrt(n))
    m = max(x for x in range(1, min(subspaces, dim) + 1) if dim % x == 0)
    sub = dim // m
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(max(k, min(codes, n))).toArrow()
    start = _matrix(first["v"], dim).astype(np.float32)
    cent = start[:k].copy()
    for _ in range(ROUNDS):

        def coarse(b, cent=cent):
            v = _matrix(b.column("v"), dim)
            return _nearest(v, cent), v

        new = _means(vectors, coarse, k, dim)
        cent = np.where(np.isnan(new), cent, new).astype(np.float32)

    def residual(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(v, cent)
        return cell, v - cent[cell]

    book = residual(start[:codes])[1].reshape(-1, m, sub).transpose(1, 0, 2).copy()
    c = book.shape[1]

    def code(r: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.stack([_square(r[:, j * sub : (j + 1) * sub], book[j]).argmin(axis=1) for j in range(m)], axis=1)

    for _ in range(ROUNDS):

        def fine(b, book=book):
            r = residual(_matrix(b.column("v"), dim))[1]
            return (code(r, book) + np.arange(m) * c).ravel(), r.reshape(-1, sub)

        new = _means(vectors, fine, m * c, sub).reshape(m, c, sub)
        book = np.where(np.isnan(new), book, new).astype(np.float32)

    def encode(batches):
        for b in batches:
            v = _matrix(b.column("v"), dim)
            cell, r = residual(v)
            q = code(r, book)
            error = np.sqrt(((r - np.concatenate([book[j][q[:, j]] for j in range(m)], axis=1)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(cell, pa.int64()), pa.array([x.tobytes() for x in q.astype(np.uint8)], pa.binary()), pa.array(error.astype(float)), pa.array(np.sqrt((r * r).sum(axis=1)).astype(float))],
                ["id", "v", "cell", "code", "error", "far"],
            )

    lists = cut(vectors.mapInArrow(encode, "id long, v binary, cell long, code binary, error double, far double"))
    sizes = lists.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).toArrow()
    radius, held = np.full(k, -np.inf), np.zeros(k, np.int64)
    radius[sizes["cell"].to_numpy()], held[sizes["cell"].to_numpy()] = sizes["far"].to_numpy(), sizes["n"].to_numpy()

    turn = math.sqrt(max(0.0, 1 - cosine * cosine))

    def rank(batches):
        def closer(x: np.ndarray, own: np.ndarray) -> np.ndarray:
            d = _square(x, cent)
            return (d < d[np.arange(len(d)), own][:, None]).sum(axis=1)

        for b in batches:
            v, seen = _matrix(b.column("v"), dim), np.zeros(k, np.int64)
            side = np.random.default_rng(b.column("id").to_numpy()[:1].astype(np.uint64)).normal(size=v.shape).astype(np.float32)
            side -= (side * v).sum(axis=1, keepdims=True) * v
            side /= np.maximum(np.sqrt((side * side).sum(axis=1, keepdims=True)), 1e-9)
            moved = cosine * v + np.float32(turn) * side
            cell, here = _nearest(moved, cent), b.column("cell").to_numpy()
            for s in _blocks(len(v), k):
                seen += np.bincount(np.minimum(closer(v[s], cell[s]), closer(moved[s], here[s])), minlength=k)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["rank", "n"])

    ranks = lists.select("id", "v", "cell").mapInArrow(rank, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).toArrow()
    share = np.zeros(k)
    share[ranks["rank"].to_numpy()] = ranks["n"].to_numpy()
    near = min(k, 1 + int(np.searchsorted(np.cumsum(share), recall * share.sum())))

    def probes(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lists that each vector probes."""
        v = _matrix(b.column("v"), dim)
        q, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in _blocks(len(v), k):
            d = _square(v[s], cent)
            y = np.argpartition(d, near - 1, axis=1)[:, :near]
            x = np.arange(len(d))[:, None]
            x, i = np.nonzero(np.sqrt(d[x, y]) <= radius[y] + reach + SLACK)
            q.append(x + s.start)
            cell.append(y[x, i])
        return v, np.concatenate(q), np.concatenate(cell)

    def count(batches):
        for b in batches:
            seen = np.bincount(probes(b)[2], minlength=k)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["cell", "n"])

    load = lists.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    asked = np.zeros(k, np.int64)
    asked[load["cell"].to_numpy()] = load["n"].to_numpy()
    mb, qb = np.maximum(1, -(-held // block)), np.maximum(1, -(-asked // block))
    base = np.concatenate([[0], np.cumsum(mb * qb)])
    step = max(1, COPIES // (near * int(mb.max()) + int(qb.max())))

    def spread(batches):
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            v, q, cell = probes(b)
            ids, own = b.column("id").to_numpy(), b.column("cell").to_numpy()
            salt = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            unit, kind, row = [], [], []
            for x in range(int(mb.max())):  # a query meets every block of members
                i = np.flatnonzero(x < mb[cell])
                unit.append(base[cell[i]] + x * qb[cell[i]] + (salt[q[i]] % qb[cell[i]].astype(np.uint64)).astype(np.int64))
                kind.append(np.zeros(len(i), np.int64))
                row.append(q[i])
            for x in range(int(qb[own].max()) if len(own) else 0):  # a member meets every block of queries
                i = np.flatnonzero(x < qb[own])
                unit.append(base[own[i]] + (salt[i] % mb[own[i]].astype(np.uint64)).astype(np.int64) * qb[own[i]] + x)
                kind.append(np.ones(len(i), np.int64))
                row.append(i)
            unit, kind, row = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (unit, kind, row))
            order = np.lexsort((kind, unit))
            unit, kind, row = unit[order], kind[order], row[order]
            cuts = np.flatnonzero((np.diff(unit) != 0) | (np.diff(kind) != 0)) + 1
            q = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, m)
            error = b.column("error").to_numpy().astype(np.float32)
            parts = [x for x in np.split(np.arange(len(unit)), cuts) if len(x)]
            rows = [row[x] for x in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(unit[x[0]]) for x in parts], pa.int64()), pa.array([int(kind[x[0]]) for x in parts], pa.int32()), *(pa.array([y[r].tobytes() for r in rows], pa.binary()) for y in (ids, v.astype(np.float16))), *(pa.array([y[r].tobytes() if kind[x[0]] else b"" for x, r in zip(parts, rows)], pa.binary()) for y in (q, error))],
                ["unit", "kind", "ids", "v", "code", "error"],
            )

    def fewer(a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As few sure edges as join their components, and the open ones between these."""
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        lab = least(len(ids), x[sure], y[sure])
        open_ = ~sure & (lab[x] != lab[y])
        at = np.flatnonzero(lab != np.arange(len(ids)))
        return np.concatenate([ids[at], a[open_]]), np.concatenate([ids[lab[at]], b[open_]]), np.arange(len(at) + int(open_.sum())) < len(at)

    def search(t: pa.Table) -> pa.Table:
        u = t["unit"][0].as_py()
        cell = int(np.searchsorted(base, u, "right")) - 1
        side = np.array(t["kind"].to_pylist())

        def take(name: str, kind: int, dtype) -> np.ndarray:
            x = t[name].to_pylist()
            return np.frombuffer(b"".join(x[i] for i in np.flatnonzero(side == kind)), dtype)

        qid, mid = take("ids", 0, np.int64), take("ids", 1, np.int64)
        qv, mv = take("v", 0, np.float16).astype(np.float32).reshape(-1, dim), take("v", 1, np.float16).astype(np.float32).reshape(-1, dim)
        q, limit = take("code", 1, np.uint8).reshape(-1, m), (reach + take("error", 1, np.float32) + HALF + SLACK) ** 2
        a, b, c, held = [], [], [], 0
        for i in range(0, len(qid), 256):
            r = qv[i : i + 256] - cent[cell]
            d = np.zeros((len(r), len(mid)), np.float32)
            for j in range(m):
                d += _square(r[:, j * sub : (j + 1) * sub], book[j])[:, q[:, j]]
            x, y = np.nonzero(d <= limit)
            x, y = x[qid[i + x] != mid[y]], y[qid[i + x] != mid[y]]
            for s in range(0, len(x), 1 << 16):
                x1, y1 = x[s : s + (1 << 16)] + i, y[s : s + (1 << 16)]
                cos = (qv[x1].astype(np.float64) * mv[y1]).sum(axis=1)
                ok = cos >= cosine - BAND
                a.append(qid[x1[ok]])
                b.append(mid[y1[ok]])
                c.append(cos[ok] >= cosine + BAND)
                held += len(c[-1])
                if spanning and held > PAIRS:
                    a, b, c = ([z] for z in fewer(*(np.concatenate(z) for z in (a, b, c))))
                    held = 0
        a, b, sure = (np.concatenate(x or [np.zeros(0, kind)]) for x, kind in ((a, np.int64), (b, np.int64), (c, bool)))
        if spanning and len(a):
            a, b, sure = fewer(a, b, sure)
        return pa.table({"a": a, "b": b, "sure": sure})

    work = lists.mapInArrow(spread, "unit long, kind int, ids binary, v binary, code binary, error binary")
    found = cut(work.groupBy("unit").applyInArrow(search, "a long, b long, sure boolean"))

    def exact(batches):
        for t in batches:
            x, y = _matrix(t.column("va"), dim).astype(np.float64), _matrix(t.column("vb"), dim)
            yield t.select(["a", "b"]).filter(pa.array((x * y).sum(axis=1) >= cosine))

    v = lists.select("id", "v")
    close = found.where("not sure").select("a", "b").distinct().join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    return found.where("sure").select("a", "b").union(close.mapInArrow(exact, "a long, b long"))


def groups(table: DataFrame, cosine: float = COSINE, subspaces: int = SUBSPACES, codes: int = CODES, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """(vec_id, group_id) of every vector that has a near duplicate; group_id is the group's least vec_id, the one to keep."""
    rows, dim = unit_vectors(table)
    rows = cut(rows.distinct().withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}))
    once = cut(rows.groupBy("v", "h", "g").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    edges = near_edges(once.select("id", "v"), dim, cosine, subspaces, codes, block, recall=recall)
    named = once.withColumn("component", F.col("id")).where("n > 1").select("h", "g", "component")
    if edges is not None:
        comp = connected_components(edges)
        named = once.select("id", "h", "g", "n").join(comp, F.col("id") == comp.node, "left").where("n > 1 or component is not null").select("h", "g", F.coalesce("component", "id").alias("component"))
    found = rows.select("id", "h", "g").join(named, ["h", "g"]).select("id", "component")
    first = found.groupBy("component").agg(F.min("id").alias("group_id"))
    return found.join(first, "component").select(F.col("id").alias("vec_id"), "group_id").distinct()

"""Mixing sources to target weights by pivotal dependent rounding.

Source s with weight w_s shall give ``total * w_s`` of the output's documents, so each of
its n_s documents is expected ``total * w_s / n_s`` times. The whole part of that is
certain. The fractional parts are rounded in pairs: a pair passes mass from one to the
other at random, keeping both expectations, until one of the two is 0 or 1; the other goes
on to the next pair. Each bucket of a source leaves one undecided document, and these
meet in a reduction tree of ``fan_in``: a source's buckets first, then the sources. So
every source has its expected number of copies within one, and the total is within one
of ``total``.

Random numbers are hashes of (seed, doc_id, source), so a run can be repeated. The unit is the
distinct (doc_id, source): rows that repeat it get equal copies and count once. A null source is a
source like others, named by None in ``weights``; null doc_ids of a source are one unit.
Null, empty and very long texts don't matter, as no text is read. Equal random numbers are
ordered by doc_id. Sources without a weight get no copy. Weights of sources without documents are dropped
and the rest scaled to 1. An empty table gives an empty result. Extra columns are kept by
:func:`mixed` and ignored by :func:`copies`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.textkit import mix
from lodestrata.runtime import cut, fresh, ship

SEED, FAN_IN, BUCKET = 20240611, 64, 65536
SOURCES = 100_000  # that are broadcast at most, a row each
ALPHA = 0.7


def tempered(counts: dict, alpha: float = ALPHA) -> dict:
    """Weights in proportion to the sources' sizes to the power ``alpha``."""
    return {k: n**alpha for k, n in counts.items()}


def pivot(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities in order; whole numbers, and the position that is left undecided, or -1.

    ``u``: a random number below 1 for each position. An undecided one keeps its mass in the output.
    """
    p, u = p.astype(float).tolist(), u.tolist()
    held = -1
    for i in range(len(p)):
        b = p[i]
        if b <= 1e-9 or b >= 1 - 1e-9:
            p[i] = round(b)
            continue
        if held < 0:
            held = i
            continue
        a = p[held]
        t = a + b
        if t < 1:
            win, lose = (held, i) if u[i] * t < a else (i, held)
            p[win], p[lose] = t, 0.0
        else:
            win, lose = (held, i) if u[i] * (2 - t) < 1 - b else (i, held)
            p[win], p[lose] = 1.0, t - 1
            win = lose
        held = win
        if p[held] <= 1e-9 or p[held] >= 1 - 1e-9:
            p[held] = round(p[held])
            held = -1
    return np.array(p, dtype=float), held


def _shares(units: DataFrame, weights: dict | None, total: int | None, bucket: int, limit: int):
    """(__s, s, e, buckets) of each source: its number, expected copies of a document and buckets; how many sources, the most buckets, and how to join them.

    Up to ``limit`` sources are a list that is broadcast; more stay a table that is joined by a shuffle.
    """
    spark = units.sparkSession
    counts = cut(units.groupBy("source").agg(F.count("*").alias("n")))
    names = counts.count()
    if names <= limit:
        n = {r[0]: r[1] for r in counts.collect()}  # a row per source, limit at most
        given = tempered(n) if weights is None else weights
        w = {k: max(0.0, float(given.get(k, 0.0))) for k in n}
        whole, total = sum(w.values()), sum(n.values()) if total is None else total
        rows = [(k, i, total * w[k] / whole / n[k] if whole else 0.0, max(1, -(-n[k] // bucket))) for i, k in enumerate(sorted(n, key=lambda k: (k is None, k or "")))]
        return spark.createDataFrame(rows, "__s string, s int, e double, buckets int"), names, max([0, *(r[3] for r in rows)]), F.broadcast
    if weights is None:
        w = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(ALPHA)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__k string, w double")
        w = counts.join(given, counts.source.eqNullSafe(F.col("__k")), "left").select("source", "n", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    w = cut(w.orderBy(F.col("source").isNull(), "source").withColumns({"pid": F.spark_partition_id(), "mid": F.monotonically_increasing_id()}))
    sums = w.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    before, begin = 0, {}
    for pid, n in sorted(map(tuple, w.groupBy("pid").count().collect())):  # a row per partition
        begin[pid], before = before, before + n
    at = F.create_map(*[F.lit(x) for kv in begin.items() for x in kv])
    number = (F.col("mid") - F.shiftleft(F.col("pid").cast("long"), 33) + F.element_at(at, F.col("pid"))).cast("int")
    goal = float(sums["n"] if total is None else total)
    each = F.lit(goal) * F.col("w") / F.lit(float(sums["w"] or 0)) / F.col("n") if sums["w"] else F.lit(0.0)
    shares = w.select(F.col("source").alias("__s"), number.alias("s"), each.alias("e"), F.greatest(F.lit(1), F.ceil(F.col("n") / bucket)).cast("int").alias("buckets"))
    return cut(shares), names, -(-sums["most"] // bucket), lambda df: df


def copies(docs: DataFrame, weights: dict | None = None, total: int | None = None, seed: int = SEED, fan_in: int = FAN_IN, bucket: int = BUCKET, sources: int = SOURCES) -> DataFrame:
    """(doc_id, source, copies) of every distinct (doc_id, source).

    ``weights``: of each source, by default :func:`tempered`; ``total``: documents of the output, by default as many as there are.
    """
    ship(docs.sparkSession)
    units = cut(docs.select(F.col("doc_id").cast("long"), "source").distinct())
    shares, names, most, hint = _shares(units, weights, total, bucket, sources)
    joined = units.join(hint(shares), units.source.eqNullSafe(F.col("__s")))
    rows = joined.select(
        F.col("doc_id").alias("id"), "s", F.floor("e").cast("long").alias("sure"), (F.col("e") - F.floor("e")).alias("p"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "s"), "buckets").alias("b"),
        F.xxhash64(F.lit(seed), "doc_id", "s").alias("r"),
    )

    def settler(level: int):
        def settle(t: pa.Table) -> pa.Table:
            order = np.lexsort((t["id"].fill_null(-(2**63)).to_numpy(), t["r"].to_numpy()))
            t = t.take(pa.array(order)).combine_chunks()
            u = (mix(t["r"].to_numpy().view(np.uint64) + np.uint64(level)) >> np.uint64(11)) / 2.0**53
            p, held = pivot(t["p"].to_numpy(), u)
            i = t.schema.get_field_index("p")
            return t.set_column(i, "p", pa.array(p)).append_column("open", pa.array(np.arange(len(p)) == held))

        return settle

    form = "id long, s int, sure long, p double, b long, r long, open boolean"
    done = cut(rows.groupBy("s", "b").applyInArrow(settler(0), form))
    settled, left = done.where("not open"), done.where("open").drop("open")
    width, level = max(1, most), 1
    keys = ["s", "b"]  # the buckets of a source, fan_in at a time; then the sources
    while width > 1 or keys == ["s", "b"]:
        if width <= 1:
            keys, width = ["b"], max(2, names)
            left = left.withColumn("b", F.col("s").cast("long"))
        up = left.withColumn("b", F.floor(F.col("b") / fan_in).cast("long"))
        done = cut(up.groupBy(*keys).applyInArrow(settler(level), form))
        settled, left = settled.union(done.where("not open")), done.where("open").drop("open")
        width, level = -(-width // fan_in), level + 1
    last = left.withColumn("p", (F.pmod("r", F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("p")).cast("double")).withColumn("open", F.lit(False))
    out = settled.union(last).select("id", "s", (F.col("sure") + F.round("p").cast("long")).alias("copies"))
    return out.join(hint(shares.select(F.col("__s").alias("source"), "s")), "s").select(F.col("id").alias("doc_id"), "source", "copies")


def mixed(docs: DataFrame, weights: dict | None = None, total: int | None = None, seed: int = SEED, fan_in: int = FAN_IN, bucket: int = BUCKET) -> DataFrame:
    """Every row of ``docs`` as often as its copies say, all columns as they were."""
    d, s, n, i = fresh(docs, "d", "s", "n", "i")
    c = copies(docs, weights, total, seed, fan_in, bucket).where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("copies").alias(n))
    out = docs.join(c, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)))
    return out.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(d, s, n, i)

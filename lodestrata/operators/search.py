"""Vector search: top-k by similarity, incremental embedding, comment bundles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalar import dot
from lodestrata.runtime import cut, ship


def top_k(vectors: DataFrame, query: list[float], k: int = 10, key: str = "id", vector: str = "vector") -> DataFrame:
    """(key, score) of the ``k`` vectors of greatest dot product with the query; equal scores by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(key), dot(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


CELLS = 1 << 19  # scores that a worker holds at once


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", vector: str = "vector", block: int = 1024) -> DataFrame:
    """(query, key, score) of the ``k`` vectors of greatest dot product for each row of ``queries``; equal scores by key.

    Queries are taken in blocks of at most ``block``, each with one scan of all vectors: a batch is
    multiplied with the block's matrix and keeps its own best ``k``, of which the best go on.
    Vectors without numbers, and those of another length than a block's first query, match nothing.
    """
    ship(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v"))
    asked = cut(asked)
    asked = asked.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-asked.count() // block)))))
    asked = cut(asked.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("q"))))
    out = None
    for b, part in [(r["b"], i) for r in asked.groupBy("b").agg(F.max("n").alias("n")).collect() for i in range(-(-r["n"] // block))]:
        rows = asked.where((F.col("b") == b) & (F.col("n") > part * block) & (F.col("n") <= (part + 1) * block)).select("q", "v").collect()  # a block
        dim = len(rows[0]["v"])
        rows = [r for r in rows if len(r["v"]) == dim]
        names, m = [r["q"] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64)

        def run(batches, names=names, m=m, dim=dim):
            for t in batches:
                t = t.filter(pc.and_(pc.is_valid(t.column("v")), pc.fill_null(pc.equal(pc.list_value_length(t.column("v")), dim), False)))
                if not t.num_rows:
                    continue
                x = np.array(t.column("v").flatten(), dtype=np.float64).reshape(-1, dim)
                ok = np.isfinite(x).all(axis=1)
                x, ids = x[ok], t.column("id").filter(pa.array(ok))
                order = np.array(pc.sort_indices(ids))
                x, ids = x[order], ids.take(pa.array(order))
                for q in range(0, len(m), max(1, CELLS // len(x))):  # so many queries that their scores are a few MB
                    some = m[q : q + max(1, CELLS // len(x))]
                    best = np.argsort(-(some @ x.T), axis=1, kind="stable")[:, :k]
                    at, i = np.repeat(np.arange(len(some)), best.shape[1]), best.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(names[q : q + len(some)], ids.type).take(pa.array(at)), ids.take(pa.array(i)), pa.array((some[at] * x[i]).sum(axis=1))], ["query", "id", "score"])

        got = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInArrow(run, f"query {kind}, id {kind}, score double")
        out = got if out is None else out.union(got)
    if out is None:
        return vectors.select(F.col(key).alias("query"), F.col(key), F.lit(0.0).alias("score")).limit(0)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return out.withColumn("__k", place).where(F.col("__k") <= k).select("query", F.col("id").alias(key), "score")


def content_key() -> list[str]:
    return ["file", "symbol", "kind", "text"]


def incremental(docs: DataFrame, cache: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, model_id, vector) for ``docs``: cached vectors of this model are kept, misses embedded, the rest dropped."""
    want = docs.withColumn("key", F.xxhash64(*content_key()))
    held = cache.where(F.col("model_id") == model)
    kept = held.join(want.select("key").distinct(), "key", "left_semi")
    new = embed(want.join(held.select("key"), "key", "left_anti").dropDuplicates(["key"]))
    return kept.select("key", "model_id", "vector").unionByName(new.select("key", F.lit(model).alias("model_id"), "vector"))


def hashed_embedding(docs: DataFrame, dim: int = 64) -> DataFrame:
    """``docs`` with ``vector``: signed hashed words, scaled to length 1. No learned model: only equal words make texts similar."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(dim))
    sign = lambda w: F.when(F.pmod(F.xxhash64(F.lit(1), w), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter("__w", lambda w: slot(w) == i), F.lit(0.0), lambda acc, w: acc + sign(w)))
    d = docs.withColumn("__w", words).withColumn("__r", raw)
    n = F.sqrt(dot(F.col("__r"), F.col("__r")))
    return d.withColumn("vector", F.when(n > 0, F.transform("__r", lambda x: (x / n).cast("float"))).otherwise(F.transform("__r", lambda x: x.cast("float")))).drop("__w", "__r")


def bundles(docs: DataFrame, top: int = 40) -> DataFrame:
    """(file, bundle): a file's module docs in its first ``top`` lines and its symbols' docs, in order, with a blank line between."""
    used = docs.where((F.col("kind") != "module") | (F.col("line") <= top)).where("text <> ''")
    return used.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "symbol_path", "text"))), lambda x: x["text"]), "\n\n").alias("bundle"))

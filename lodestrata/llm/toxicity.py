"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a document are the distinct hashed words, pairs of neighbouring words and
pairs with one word between. Training takes the ``max_rows`` labelled documents with the
least hashed id (a documented bound, the only one); each coordinate has its own rate, and
the L1 term leaves some hundred non-zero weights, which go to the executors.
Scoring reads every document whole, in one pass without a shuffle.

A document is flagged if its score exceeds the threshold and at least one weight spoke for
it: the bias alone flags nothing. So null and empty texts, and texts of unknown words only,
are never flagged, whatever the labels are. Null labels and labels of unknown documents
aren't used; a document labelled more than once counts as toxic if any label says so.
Without labelled documents of both kinds there is no model: it has no weights, every score
is 0.5 and nothing is flagged. Very long texts are read whole; one takes memory in
proportion to its words. Repeated rows and equal texts are scored alike; equal scores need
no order. An empty table gives an empty result. Extra columns are ignored by :func:`score`
and kept by :func:`keep_clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkit as K
from lodestrata.runtime import ship

U = np.uint64
MAX_ROWS = 16384
BITS, THRESHOLD = 20, 0.4


def features(w: K.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and the document of each, not yet distinct."""
    doc, h = K.doc_of(w.off), w.h
    out, docs = [K.mix(h * U(3))], [doc]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            out.append(K.mix((h[:-gap] * U(0xA24BAED4963EE407) + h[gap:] + U(salt))[same]))
            docs.append(doc[gap:][same])
    return (np.concatenate(out) >> U(64 - bits)).astype(np.int64), np.concatenate(docs)


def distinct(idx: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.unique((doc << bits) | idx)
    return k & ((1 << bits) - 1), k >> bits


def ftrl(rows: list[np.ndarray], y: np.ndarray, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, and the numbers and values of the non-zero weights."""
    size = (1 << bits) + 1  # the last is the bias, without L1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7)
    cost = np.full(size, l1)
    cost[-1] = 0

    def weight(i: np.ndarray) -> np.ndarray:
        zi, c = z[i], cost[i]
        return np.where(np.abs(zi) <= c, 0.0, (np.sign(zi) * c - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i = np.append(rows[r], size - 1)
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[r]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weight(np.arange(size))
    at = np.flatnonzero(w[:-1])
    return float(w[-1]), at, w[at]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1, epochs: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias and sparse weights; fitted in one task on at most ``max_rows`` labelled documents."""
    ship(docs.sparkSession)
    used = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    used = used.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(used), "doc_id")  # max_rows ids at most
    rows = rows.select("text", "__toxic", F.xxhash64("doc_id", "text").alias("__o")).repartition(1).sortWithinPartitions("__o")

    def fit(batches):
        feats, y = [], []
        for b in batches:
            for part in K.slices(b):
                w = K.words(part.column("text"))
                idx, doc = distinct(*features(w, bits), bits)
                feats += np.split(idx.astype(np.int32), np.searchsorted(doc, np.arange(1, part.num_rows)))
                y += part.column("__toxic").to_pylist()
        known = np.array(y, dtype=float).clip(0, 1)
        learns = len(np.unique(known)) == 2
        bias, at, value = ftrl(feats, known, bits, alpha, beta, l1, l2, epochs) if learns else (0.0, np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_pydict({"at": np.append(at, -1), "w": np.append(value, bias)})

    got = rows.mapInArrow(fit, "at long, w double").toArrow()
    at, value = got["at"].to_numpy(), got["w"].to_numpy()
    return float(value[at < 0].sum()), at[at >= 0], value[at >= 0]


def scorer(model: tuple[float, np.ndarray, np.ndarray], bits: int = BITS):
    """A function from a text column to scores, and whether any weight spoke for them."""
    bias, at, value = model

    def run(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = K.words(col)
        total, heard = np.full(len(w.off) - 1, bias), np.zeros(len(w.off) - 1, bool)
        if len(at):
            dense = np.zeros(1 << bits, np.float32)
            dense[at] = value
            idx, doc = features(w, bits)
            hit = dense[idx] != 0
            idx, doc = distinct(idx[hit], doc[hit], bits)
            total += np.bincount(doc, dense[idx].astype(float), minlength=len(total))
            heard[doc] = True
        return 1 / (1 + np.exp(-np.clip(total, -35, 35))), heard

    return run


def score(docs: DataFrame, model, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic) for every row of ``docs``."""
    ship(docs.sparkSession)
    f = scorer(model, bits)

    def run(batches):
        for b in batches:
            for part in K.slices(b):
                s, heard = f(part.column("text"))
                yield pa.RecordBatch.from_arrays([K.column(part, "doc_id").cast(pa.int64()), pa.array(s), pa.array((s > threshold) & heard)], ["doc_id", "score", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, toxic boolean")


def keep_clean(docs: DataFrame, model, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, all columns as they were."""
    ship(docs.sparkSession)
    f = scorer(model, bits)

    def run(batches):
        for b in batches:
            for part in K.slices(b):
                s, heard = f(part.column("text"))
                yield part.filter(pa.array((s <= threshold) | ~heard))

    return docs.mapInArrow(run, docs.schema)

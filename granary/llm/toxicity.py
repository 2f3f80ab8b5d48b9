"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z.  Features are
present or not: single words, their stems of 4 to 7 bytes, pairs of neighbours, pairs with one
word between.  The model is learned in one task from the features of about SAMPLE labelled rows
(chosen by a hash of doc_id; all documents are searched for them in parallel), with a rate for each coordinate and L1 sparsity; what leaves that task is the
list of non-zero weights, 2**BITS at most, which every scoring task gets.

Defined cases: a null or empty text scores by the bias alone; a null doc_id is never held out
and never labelled; no labels at all give a score of one half; repeated label rows count each;
other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS = 20
STEMS = (4, 5, 6, 7)
SAMPLE = 12_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 3.0, 0.01
REJECT = 0.7
BIAS = 1 << BITS


def _gaps() -> np.ndarray:
    gap = np.ones(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        gap[lo:hi] = False
    return gap


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and coordinate of each n-gram, with repetitions."""
    w = C.Words(raw, off, _gaps())
    h = w.hashes(fold=True)
    docs, found = [w.doc], [h]
    size = w.end - w.start
    for n in STEMS:
        long = np.flatnonzero(size > n)
        docs.append(w.doc[long])
        found.append(w.hashes(fold=True, cut=n)[long] ^ np.uint64(n))
    for step, salt in ((1, 11), (2, 23)):
        if len(h) > step:
            same = w.doc[:-step] == w.doc[step:]
            docs.append(w.doc[:-step][same])
            found.append(C.mix((h[:-step] * C.M1 + h[step:] * np.uint64(2 * salt + 1)) ^ np.uint64(salt))[same])
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(docs: list[np.ndarray], labels: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """docs: the distinct coordinates of each document.  Weights; the bias is the last and has
    no L1."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    penal = np.full(BIAS + 1, l1)
    penal[BIAS] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= penal[i], 0.0, (np.sign(zi) * penal[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for d in order.permutation(len(docs)):
            i = docs[d]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[d]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(BIAS + 1))


def distinct(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The coordinates of each document, each once, and the bias."""
    doc, at = features(raw, off)
    both = np.unique(doc << BITS | at)
    cut = np.searchsorted(both >> BITS, np.arange(len(off)))
    return [np.append(both[p:q] & (BIAS - 1), BIAS).astype(np.int32) for p, q in zip(cut[:-1], cut[1:], strict=True)]


def fit(rows: DataFrame, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """rows: g_text, g_label and g_order (the order of learning), SAMPLE rows or so.  The non-zero
    coordinates and weights.  Coordinates are made where the texts are; only they go to the task
    that learns."""

    def seen(batches):
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            found = [x for i, j in C.runs(off) for x in distinct(raw[off[i] : off[j]], off[i : j + 1] - off[i])]
            upto = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([lists, b.column("g_label"), b.column("g_order")], names=["g_at", "g_label", "g_order"])

    def learn(batches):
        docs, labels, orders = [], [], []
        for b in batches:
            lists = b.column("g_at")
            upto, flat = lists.offsets.to_numpy(), C.ints(lists.values)
            docs += [flat[p:q] for p, q in zip(upto[:-1], upto[1:], strict=True)]
            labels.append(C.ints(b.column("g_label")))
            orders.append(C.ints(b.column("g_order")))
        if docs:
            orders, labels = np.concatenate(orders), np.concatenate(labels)
            o = np.lexsort(([zlib.crc32(d.tobytes()) for d in docs], labels, orders))
            w = ftrl([docs[i] for i in o], labels[o], epochs, alpha, beta, l1, l2)
            i = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w[i])], names=["i", "w"])

    made = C.bounded(rows).select("g_text", "g_label", "g_order").mapInArrow(seen, "g_at array<int>, g_label double, g_order long")
    got = made.repartition(1).mapInArrow(learn, "i long, w double").toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """g_row (a struct of the columns to keep) and score of each row."""
    at, w = model
    base = C.bounded(docs).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("g_row"), F.col(text).alias("g_text"))
    out = T.StructType([base.schema["g_row"], T.StructField("score", T.DoubleType())])

    def work(batches):
        dense = np.zeros(BIAS + 1)
        dense[at] = w
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            total = np.full(len(off) - 1, dense[BIAS])
            for i, j in C.runs(off):
                doc, x = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                hit = dense[x] != 0
                both = np.unique(doc[hit] << BITS | x[hit])
                total[i:j] += np.bincount(both >> BITS, dense[both & (BIAS - 1)], j - i)
            yield pa.RecordBatch.from_arrays([b.column("g_row"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["g_row", "score"])

    return base.mapInArrow(work, out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The model of the labelled rows that are not held out, of about `sample` of them."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("double").alias("g_label"))
    some = C.about(known, sample, "doc_id", "g_label").withColumn("g_order", F.xxhash64("doc_id"))
    return fit(docs.select("doc_id", F.col("text").alias("g_text")).join(F.broadcast(some), "doc_id"))  # about `sample` small rows


def clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of docs that score under `reject`."""
    return scored(docs, learned(docs, labels), docs.columns).where(F.col("score") < reject).select("g_row.*")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learned(docs, labels)
    done = scored(docs, model, ["doc_id"]).select("g_row.doc_id", "score")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))

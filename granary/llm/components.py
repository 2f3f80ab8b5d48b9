"""Connected components of an edge table.

Edges are first contracted where they are: tasks of EDGES edges or so replace theirs by a spanning
forest, again and again while that leaves many fewer.  What is left is settled by alternating large
and small stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Edges that a task contracts at a time.
EDGES = 1_000_000


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least node of each node's component; i, j: links among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """A spanning forest of the edges that each task gets."""

    def work(batches):
        held, rows = [], 0

        def out():
            both = np.concatenate(held, 1)
            name, at = np.unique(both, return_inverse=True)
            i, j = at.reshape(both.shape)
            label = forest(i, j, len(name))
            child = np.flatnonzero(label != np.arange(len(name)))
            return pa.RecordBatch.from_arrays([pa.array(name[child]), pa.array(name[label[child]])], names=["u", "v"])

        for b in batches:
            held.append(np.stack([C.ints(b.column("u")), C.ints(b.column("v"))]))
            rows += b.num_rows
            if rows >= 2 * EDGES:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return edges.repartition(tasks).mapInArrow(work, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs).  Returns u, root for every node but the roots; a root is the least
    node of its component.  Each round is staged, so the lineage stays short."""
    now = C.stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        tasks = -(-mark[0] // EDGES)
        now = C.stage(contracted(now, tasks), "edges")
        before, mark = mark, _mark(now)
        if tasks == 1:
            return now.select("u", F.col("v").alias("root"))
        if mark[0] > 0.7 * before[0]:
            break
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = C.stage(after, "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select("u", F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

"""Exact top-k by inner product: best-first search of M-trees.

Vectors become whole numbers and get one more component, sqrt(M^2 - |x|^2) with M the greatest
norm of their block, so that all lie on a sphere, and the greatest inner product is the least
Euclidean distance.  Each block of candidates is an M-tree: pages of entries with a routing
vector, a covering radius and the distance to the parent's routing vector.  Queries go down a
tree together: first each to its nearest leaf, then nodes come from a heap by least possible
distance, each with the queries whose k-th best that does not exceed, and one product of matrices
scores them all; entries that the stored distances and the triangle inequality rule out for every
one are not computed.  Scores are exact whole numbers; the bounds allow for rounding, and ties go
to the smaller id.

Queries meet every block, in blocks of their own, as a stated query set against all rows; each
pair of blocks is a task of bounded size.  The ten best of each pair are ranked at the end.

Defined cases: a null vector, one with null or non-finite components, or with a null vec_id,
takes no part; shorter vectors count as padded with zeros; rows with the query's own vec_id are
its own; of query rows with equal vec_id the least vector asks; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

K = 10
PAGE = 64
BLOCK = 8192
#: Queries that go to a tree at a time: a tree is sent once for so many.
QUERIES = 8192


def whole(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def norms(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)


class MTree:
    """Bulk-loaded; nodes hold rows of `x` (leaves) or child nodes with their routing rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE):
        self.ids, self.x, self.page = ids, x, page
        self.top = int(norms(x).max()) if len(x) else 0  # M squared
        self.nodes: list[tuple] = []
        if len(x):
            self.root = self._build(np.arange(len(x)), None)

    def distance(self, rows: np.ndarray, to: int) -> np.ndarray:
        """Between vectors on the sphere: that of the numbers and that of the added component."""
        d = norms(self.x[rows] - self.x[to])
        a = np.sqrt(np.maximum(self.top - norms(self.x[rows]), 0)) - np.sqrt(max(self.top - int((self.x[to] ** 2).sum()), 0))
        return np.sqrt(d + a * a)

    def _build(self, rows: np.ndarray, parent: int | None) -> int:
        far = self.distance(rows, parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= self.page:
            self.nodes.append((True, rows, far, None, None))
            return len(self.nodes) - 1
        k = min(self.page, -(-len(rows) // self.page) + 1)
        order = np.argsort(far, kind="stable")
        pivots = rows[order[np.linspace(0, len(rows) - 1, k).astype(np.int64)]]
        near = np.argmin(np.stack([self.distance(rows, p) for p in pivots]), 0)
        if np.bincount(near, minlength=k).max() > 0.9 * len(rows):  # as with copies: any even split will do
            near = np.arange(len(rows)) * k // len(rows)
        routing, radius, child = [], [], []
        for c in range(k):
            part = rows[near == c]
            if len(part):
                pivot = int(pivots[c]) if pivots[c] in part else int(part[0])
                routing.append(pivot)
                radius.append(float(self.distance(part, pivot).max()))
                child.append(self._build(part, pivot))
        r = np.array(routing)
        self.nodes.append((False, r, self.distance(r, parent) if parent is not None else np.zeros(len(r)), np.array(radius), np.array(child)))
        return len(self.nodes) - 1

    def search(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows that are not `own`, best first."""
        _, scores, ids = self.search_all(np.array([own]), q[None], k)
        return list(zip(scores.tolist(), ids.tolist(), strict=True))

    def search_all(self, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For many queries: which one, score and id of its k best rows, best first."""
        none = np.zeros(0, np.int64)
        if not len(self.x) or not len(q):
            return none, none, none
        least = -np.inf if q.dtype == np.float64 else -np.iinfo(np.int64).max
        best, ids = np.full((len(q), k), least, q.dtype), np.full((len(q), k), np.iinfo(np.int64).max)
        base = norms(q) + self.top  # squared distance: base - 2 * score
        slack = 1e-6 * (1.0 + np.sqrt(base.astype(np.float64)))
        bound = np.full(len(q), np.inf)
        # way (0: each query's nearest child, from the root on), least possible distance of any
        # query, a number that keeps the order strict; node, queries, least possible distances of
        # each, distances to the parent's routing vector
        made = 0
        heap = [(0, 0.0, made, self.root, np.arange(len(q)), np.zeros(len(q)), None)]
        while heap:
            way, _, _, node, who, low, from_parent = heapq.heappop(heap)
            leaf, rows, stored, radius, child = self.nodes[node]
            some = low <= bound[who]
            if from_parent is not None and some.any():
                keep = np.abs(from_parent[some, None] - stored) - (0 if leaf else radius) <= bound[who[some], None]
                some[some], wanted = keep.any(1), keep.any(0)
                rows = rows[wanted]
                if not leaf:
                    radius, child = radius[wanted], child[wanted]
            who = who[some]
            if not len(who):
                continue
            scores = q[who] @ self.x[rows].T
            if leaf:
                near = self.ids[rows]
                at, to = np.nonzero((scores >= best[who, -1:]) & (near != own[who, None]))
                if len(at):
                    self._merge(best, ids, who[at], scores[at, to], near[to])
                    found = who[best[who, -1] > least]
                    bound[found] = np.sqrt(np.maximum(base[found] - 2 * best[found, -1], 0)) + slack[found]
                continue
            d = np.sqrt(np.maximum(base[who, None] - 2 * scores, 0))
            low = np.maximum(d - radius, 0.0)
            first = np.argmin(d, 1) if way == 0 else np.full(len(who), -1)
            for c in range(len(rows)):
                for next_way, these in ((0, first == c), (1, (first != c) & (low[:, c] <= bound[who]))):
                    if these.any():
                        made += 1
                        heapq.heappush(heap, (next_way, float(low[these, c].min()), made, child[c], who[these], low[these, c], d[these, c]))
        there = best > least
        return np.nonzero(there)[0], best[there], ids[there]

    @staticmethod
    def _merge(best: np.ndarray, ids: np.ndarray, who: np.ndarray, scores: np.ndarray, near: np.ndarray) -> None:
        """Puts scores and ids of new rows among the best of their queries; in place."""
        k, u = best.shape[1], np.unique(who)
        who, scores, near = np.concatenate([np.repeat(u, k), who]), np.concatenate([best[u].ravel(), scores]), np.concatenate([ids[u].ravel(), near])
        order = np.lexsort((near, -scores, who))
        start = np.searchsorted(who[order], u)
        order = order[start[:, None] + np.arange(k)]
        best[u], ids[u] = scores[order], near[order]


def matrix(lists: pa.Array) -> np.ndarray:
    """Whole-number vectors, padded with zeros.  Floats while all sums stay exact in them."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat[at[0] : at[-1]]
    return out


def fitting(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def trees(vectors: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """vectors: vec_id, x.  g_block, tree of each block of about `block` rows; how many."""
    blocks = max(1, -(-vectors.count() // block))
    dealt = vectors.withColumn("g_block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        x = matrix(table.column("x"))
        bound = int(np.abs(x).max(initial=0)) ** 2 * max(x.shape[1], 1)
        tree = MTree(C.ints(table.column("vec_id")), x.astype(np.float64) if bound < 1 << 50 else x)
        return pa.table({"g_block": pa.array([table.column("g_block")[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree.__dict__)], pa.binary())})

    return C.stage(dealt.groupBy("g_block").applyInArrow(build, "g_block int, tree binary"), "trees"), blocks


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """vectors, queries: vec_id, x (whole numbers).  query_id, rank, vec_id, score."""
    forest, blocks = trees(vectors, block)
    groups = max(1, -(-queries.count() // query_block))
    asked = queries.withColumn("g_group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("g_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copies = forest.withColumn("g_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if left.num_rows and right.num_rows:
            tree = MTree.__new__(MTree)
            tree.__dict__.update(pickle.loads(right.column("tree")[0].as_py()))
            q = matrix(left.column("x"))
            width = max(tree.x.shape[1], q.shape[1])
            tree.x = fitting(tree.x, width)
            q = fitting(q, width)
            small = int(np.abs(q).max(initial=0)) * int(np.abs(tree.x).max(initial=0)) * max(width, 1) < 1 << 50 and int(np.abs(q).max(initial=0)) ** 2 * max(width, 1) < 1 << 50
            q = q.astype(np.float64) if small and tree.x.dtype == np.float64 else q
            tree.x = tree.x if q.dtype == np.float64 else tree.x.astype(np.int64)
            own = C.ints(left.column("vec_id"))
            who, scores, ids = tree.search_all(own, q, k)
            out = [own[who], ids, scores.astype(np.int64)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = asked.groupBy("g_block", "g_group").cogroup(copies.groupBy("g_block", "g_group")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def prepared(table: DataFrame) -> DataFrame:
    """vec_id, x of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("x"))


def op10_topk(spark, sf_dir: str) -> DataFrame:
    vectors = prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.where(F.col("vec_id") % 100 == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    return top_k(vectors, queries)

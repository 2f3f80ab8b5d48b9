"""Sharding by best-fit-decreasing bin packing.

Equal texts form one indivisible group.  Groups sorted by size enter the bin of the tightest
remaining capacity that holds them, found in a balanced tree of the open bins; with a given
number of shards, what fits nowhere enters the emptiest.  Groups of one size are alike, and best
fit puts one after another into the same bin until it is full for them, so the packing runs on
the table of distinct sizes and their counts: at most sqrt(2 * bytes) rows, whatever the number of
groups.  Its result says which numbers of a size go to which shard; groups get gapless numbers
within their size, and rows find their group.  Every group is packed by its exact size.

The law is `bytes`: sizes near equal, as far as the largest group lets them.

Defined cases: a null text counts as the empty one, with size 1; a null doc_id stays null; equal
rows share a shard; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHARDS = 16
#: A group with more than one of so many rows is hot; there are at most so many.
HOT = 1000


class Tree:
    """An AVL tree of (remaining capacity, bin)."""

    class Node:
        __slots__ = ("high", "key", "left", "right")

        def __init__(self, key):
            self.key, self.left, self.right, self.high = key, None, None, 1

    def __init__(self, keys=()):
        self.root = None
        for k in keys:
            self.add(k)

    @staticmethod
    def _high(n) -> int:
        return n.high if n else 0

    def _turned(self, n, left: bool):
        """n with its left (or right) child above it."""
        up = n.left if left else n.right
        if left:
            n.left, up.right = up.right, n
        else:
            n.right, up.left = up.left, n
        for x in (n, up):
            x.high = 1 + max(self._high(x.left), self._high(x.right))
        return up

    def _even(self, n):
        n.high = 1 + max(self._high(n.left), self._high(n.right))
        lean = self._high(n.left) - self._high(n.right)
        if lean > 1:
            if self._high(n.left.left) < self._high(n.left.right):
                n.left = self._turned(n.left, False)
            return self._turned(n, True)
        if lean < -1:
            if self._high(n.right.right) < self._high(n.right.left):
                n.right = self._turned(n.right, True)
            return self._turned(n, False)
        return n

    def add(self, key) -> None:
        def into(n):
            if n is None:
                return Tree.Node(key)
            if key < n.key:
                n.left = into(n.left)
            else:
                n.right = into(n.right)
            return self._even(n)

        self.root = into(self.root)

    def remove(self, key) -> None:
        def out(n, key):
            if key < n.key:
                n.left = out(n.left, key)
            elif key > n.key:
                n.right = out(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                least = n.right
                while least.left:
                    least = least.left
                n.key = least.key
                n.right = out(n.right, least.key)
            return self._even(n)

        self.root = out(self.root, key)

    def at_least(self, key):
        """The least key from `key` on."""
        n, found = self.root, None
        while n:
            if n.key >= key:
                n, found = n.left, n.key
            else:
                n = n.right
        return found

    def last(self):
        n = self.root
        while n.right:
            n = n.right
        return n.key


def best_fit_decreasing(sizes: dict[int, int], capacity: int, shards: int | None = None) -> list[tuple[int, int, int, int]]:
    """sizes: how many items of each size.  (size, first number, number after the last, bin): where
    the items of a size go, in the order they are packed.  shards: so many bins and no more; None:
    as many as it takes."""
    tree, opened, out = Tree((capacity, i) for i in range(shards or 0)), shards or 0, []
    for size in sorted(sizes, reverse=True):
        at, count = 0, sizes[size]
        while at < count:
            key = tree.at_least((size, -1))
            if key is not None:
                tree.remove(key)
            elif shards is not None:
                key = tree.last()
                tree.remove(key)
            else:
                key, opened = (max(capacity, size), opened), opened + 1
            n = min(max(1, key[0] // size), count - at)
            tree.add((key[0] - n * size, key[1]))
            out.append((size, at, at + n, key[1]))
            at += n
    return out


def capacity_of(sizes: dict[int, int], shards: int) -> int:
    """The even share of what is left when items over the even share have shards of their own."""
    rest, n = sum(s * c for s, c in sizes.items()), shards
    for s in sorted((s for s, c in sizes.items() for _ in range(min(c, shards))), reverse=True)[:shards]:
        if n <= 1 or s * n <= rest:
            break
        rest, n = rest - s, n - 1
    return max(1, -(-rest // n))


def assigned(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard of each row.  shards: so many; or None and a capacity, of
    which as many shards are filled as it takes."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("g_hash"))
    rows = C.stage(rows, "sizes")
    key = ["g_hash", "text_crc32", "size"]
    groups = C.stage(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("g_rows")).withColumn("g_bytes", F.col("g_rows") * F.col("size")), "groups")
    table = groups.groupBy("g_bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row for each different size
    sizes = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
    plan = best_fit_decreasing(sizes, capacity if shards is None else capacity_of(sizes, shards), shards)
    cols = np.array(plan, np.int64).reshape(-1, 4).T
    where = spark.createDataFrame(pa.table(dict(zip(("g_bytes", "g_lo", "g_hi", "shard"), cols, strict=True))))
    ranked = C.numbered(groups, ["g_bytes"], key, "g_rank", ["g_hash"], 16)
    near = (F.col("g_rank") >= F.col("g_lo")) & (F.col("g_rank") < F.col("g_hi"))
    placed = C.stage(ranked.join(where, (ranked["g_bytes"] == where["g_bytes"]) & near).select(*key, "g_rows", F.col("shard").cast("int").alias("shard")), "placed")
    total = sum(sizes[s] for s in sizes) and rows.count()
    hot = placed.where(F.col("g_rows") > total // HOT).select(*key, F.col("shard").alias("g_hot"))  # under HOT rows
    known = rows.join(F.broadcast(hot), key, "left")
    rest = known.where("g_hot is null").drop("g_hot").join(placed.where(F.col("g_rows") <= total // HOT).drop("g_rows"), key)
    return known.where("g_hot is not null").withColumnRenamed("g_hot", "shard").select(*rest.columns).unionByName(rest)


def sharded(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """As assigned(), with a gapless slot in each shard."""
    rows = assigned(docs, shards, capacity).withColumn("g_salt", F.xxhash64("doc_id", "g_hash"))
    parts = max(16, C.partitions(docs.sparkSession))
    return C.numbered(rows, ["shard"], ["g_salt", "doc_id"], "slot", ["g_salt"], parts).select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    done = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

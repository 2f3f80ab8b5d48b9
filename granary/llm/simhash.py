"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Equal fingerprints count once.  The distinct ones are dealt into groups of some thousand by keys
that near ones share, and each group is compared exactly, tile by tile: its rows in the order of
population counts are cut into tiles of TILE; a tile pair is one exclusive-or and bit count of
numpy, and pairs whose population counts lie further apart than the radius are skipped.  A group
over BLOCK rows is cut by population count and hash, and its block pairs, save those too far apart,
are groups of their own.  Each group sends on a spanning forest of its links only.

* classes() links fingerprints of 64 bits within `radius` bits.  Two such agree in m - r of m bit
  blocks for some choice of blocks; the keys are all those choices, so no pair is lost.  m follows
  the number of fingerprints.
* one_each() takes one document of each group of texts whose sets of `shingle`-word shingles have a
  Jaccard similarity of `least` or more.  Candidates are fingerprints of 128 bits of the sets,
  within a radius that a pair of that similarity exceeds with a chance of one in ten thousand (it
  differs in 19.4 bits at 0.8, with a deviation of 4.1); a radius that wide leaves no choice of
  blocks, so the keys are TABLES choices of bits, all of which miss a pair at 0.8 with a chance of
  0.9 %, at 0.85 of 0.2 % and at 0.9 of 0.02 % (see test_tables_miss_few).  What is a
  candidate's component is then settled exactly: each set is held against that of the component's
  least node, and the ones that this leaves against all others, in tiles of bit sets.

Defined cases: a null or blank text has fingerprint zero (classes) or no shingles, like any other
such text (one_each); a text under `shingle` words is one shingle; a null doc_id sorts after every
other id; equal rows share a component, and of rows equal in id and text the one of least hash
stays; other columns play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R
from .components import components, forest

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
#: Rows of a tile; of a group, about; of a group that is not cut, at most.
TILE, GROUP, BLOCK = 128, 2048, 8192
#: Shingles hashed at a time.
SLICE = 1 << 17
#: Of the 128-bit fingerprints of sets: the radius, the keys and their bits, rows of a group and of
#: a key's value, about.
RADIUS, TABLES, BITS, SET_GROUP, TABLE_ROWS = 34, 56, 12, 512, 4096
#: Sets compared at a time, and members of theirs together, about; members in a bit set.
SET_ROWS, SET_MEMBERS, MEMBERS = 4096, 1 << 20, 1 << 14


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(raw: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges of `raw` at once."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    v8 = np.ndarray((len(raw) + 8,), np.uint64, buffer=padded.data, strides=(1,))
    v4 = np.ndarray((len(raw) + 12,), np.uint32, buffer=padded.data, strides=(1,))
    s = np.uint64(seed)
    h = np.full(len(start), s + P5)
    at = start.astype(np.int64)
    left = size.astype(np.int64)
    big = np.flatnonzero(left >= 32)
    if len(big):
        with np.errstate(over="ignore"):
            acc = [np.full(len(big), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
        who, p, n = np.arange(len(big)), at[big].copy(), left[big].copy()
        while len(who):
            for i in range(4):
                acc[i][who] = _rotl(acc[i][who] + v8[p[who] + 8 * i] * P2, 31) * P1
            p[who] += 32
            n[who] -= 32
            who = who[n[who] >= 32]
        x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for i in range(4):
            x = (x ^ (_rotl(acc[i] * P2, 31) * P1)) * P1 + P4
        h[big], at[big], left[big] = x, p, n
    h += size.astype(np.uint64)
    for _ in range(3):
        w = np.flatnonzero(left >= 8)
        if not len(w):
            break
        h[w] = _rotl(h[w] ^ (_rotl(v8[at[w]] * P2, 31) * P1), 27) * P1 + P4
        at[w] += 8
        left[w] -= 8
    w = np.flatnonzero(left >= 4)
    h[w] = _rotl(h[w] ^ (v4[at[w]].astype(np.uint64) * P1), 23) * P2 + P3
    at[w] += 4
    left[w] -= 4
    for _ in range(3):
        w = np.flatnonzero(left > 0)
        h[w] = _rotl(h[w] ^ (padded[at[w]].astype(np.uint64) * P5), 11) * P1
        at[w] += 1
        left[w] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


def counted(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each document's hashes have each bit: (documents, 64).  first: where each
    document's hashes begin; none is empty.  Bytes of words serve as counters, up to 255."""
    total = np.diff(np.append(first, len(h)))
    blocks = -(-total // 255)
    begin = np.cumsum(blocks) - blocks
    at = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(begin, blocks))
    sums = np.empty((len(at), 8, 8), np.uint8)
    for bit in range(8):
        part = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), at)
        sums[:, :, bit] = part.view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(sums.reshape(-1, 64), begin, axis=0, dtype=np.int32)


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bits that over half of each document's hashes have."""
    total = np.diff(np.append(first, len(h)))
    return np.packbits(2 * counted(h, first) > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(raw: np.ndarray, off: np.ndarray, shingle: int = 4) -> np.ndarray:
    """One for each document of a batch, of XXH64 of its shingles with repeats."""
    docs = len(off) - 1
    out = np.zeros(docs, np.uint64)
    w = C.Words(raw, off)
    if not len(w.start):
        return out
    # the words of a document joined by one space: non-gap bytes, and the gap byte before a word
    folded = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    gap = np.zeros(256, bool)
    gap[list(C.SPACES)] = True
    keep = ~gap[raw]
    inner = w.start[np.diff(w.doc, prepend=-1) == 0] - 1
    keep[inner] = True
    folded[inner] = 32
    place = np.cumsum(keep, dtype=np.int32 if len(raw) < 1 << 31 else np.int64) - 1
    text = folded[keep]
    start, end = place[w.start].astype(np.int64), place[w.end - 1].astype(np.int64) + 1
    last = w.first[w.doc + 1] - 1
    whole = (np.arange(len(start)) + shingle - 1 <= last) | (np.arange(len(start)) == w.first[w.doc])
    i = np.flatnonzero(whole)
    j = np.minimum(i + shingle - 1, last[i])
    h = np.empty(len(i), np.uint64)
    for x in range(0, len(i), SLICE):  # of a long document, too
        y = slice(x, x + SLICE)
        lo = start[i[y][0]]
        h[y] = xxh64(text[lo : end[j[y]].max()], start[i[y]] - lo, end[j[y]] - start[i[y]])
    some = np.flatnonzero(np.diff(w.first))
    out[some] = majority(h, np.searchsorted(w.doc[i], some))
    return out


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """g_k, g_d and g_fp of each row, staged."""
    base = C.bounded(docs).select(C.doc_key(F.col(doc_id), F.col(text)).alias("g_k"), C.sort_id(F.col(doc_id)).alias("g_d"), F.col(text).alias("g_text"))

    def work(batches):
        schema = C.arrow_schema("g_k long, g_d long, g_fp long")
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            fp = [fingerprints(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in C.runs(off)]
            yield pa.RecordBatch.from_arrays([b.column("g_k"), b.column("g_d"), pa.array(np.concatenate([*fp, np.zeros(0, np.uint64)]).view(np.int64))], schema=schema)

    return C.stage(base.mapInArrow(work, "g_k long, g_d long, g_fp long"), "fingerprints")


class Links:
    """Links found so far among n nodes, as a forest when they become many."""

    def __init__(self, n: int):
        self.n, self.i, self.j, self.kept = n, [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.i.append(i)
        self.j.append(j)
        self.kept += len(i)
        if self.kept > 1_000_000:
            self.i, self.j = ([x] for x in self.spanning())
            self.kept = len(self.i[0])

    def spanning(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.i:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        label = forest(np.concatenate(self.i), np.concatenate(self.j), self.n)
        child = np.flatnonzero(label != np.arange(self.n))
        return child, label[child]


def near(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A spanning forest of the links within a group, tile pairs compared, and tile pairs skipped.
    fp: (rows, words); side: -1 compares with all, 0 only with 1."""
    ones = np.bitwise_count(fp).sum(1, dtype=np.int64)
    o = np.argsort(ones, kind="stable")
    fp, side, ones = fp[o], side[o], ones[o]
    links, compared, skipped = Links(len(o)), 0, 0
    tiles = range(0, len(o), TILE)
    for a in tiles:
        x, top = fp[a : a + TILE], ones[min(a + TILE, len(o)) - 1]
        for b in range(a, len(o), TILE):
            if ones[b] - top > radius:
                skipped += (len(o) - b + TILE - 1) // TILE
                break
            compared += 1
            y = fp[b : b + TILE]
            apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for word in range(1, fp.shape[1]):
                apart = apart + np.bitwise_count(x[:, None, word] ^ y[None, :, word])
            i, j = np.nonzero(apart <= radius)
            i, j = i + a, j + b
            ok = (i < j) & ((side[i] < 0) | (side[i] != side[j]))
            if ok.any():
                links.add(i[ok], j[ok])
    i, j = links.spanning()
    return o[i], o[j], compared, skipped


def grouped(rows: DataFrame, radius: int, words: int) -> DataFrame:
    """rows: g_key (of a group), ones, node, f0.. (fingerprint).  u, v: links among the nodes of
    each group, enough to connect it."""
    fps = [f"f{w}" for w in range(words)]
    counts = rows.groupBy("g_key", "ones").agg(F.count(F.lit(1)).alias("n"))
    large = counts.groupBy("g_key").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")))).alias("blocks")).where(F.col("total") > BLOCK)
    large = C.stage(large.drop("total"), "large")
    if large.isEmpty():
        groups = rows.select(F.col("g_key").alias("g_group"), "node", *fps, F.lit(-1).alias("side"))
    else:
        joined = rows.join(large, "g_key", "left")
        own = F.struct(F.col("ones").alias("o"), F.pmod(F.xxhash64("node"), F.element_at("blocks", F.col("ones"))).cast("int").alias("s"))
        others = F.expr(f"flatten(transform(filter(map_keys(blocks), o -> abs(o - ones) <= {radius}), o -> transform(sequence(0, element_at(blocks, o) - 1), s -> struct(o, s))))")
        paired = joined.where("blocks is not null").withColumn("own", own).withColumn("other", F.explode(others))
        first, second = F.least("own", "other"), F.greatest("own", "other")
        cut = paired.select(F.xxhash64("g_key", first, second).alias("g_group"), "node", *fps, F.when(F.col("own") == F.col("other"), -1).when(F.col("own") == first, 0).otherwise(1).alias("side"))
        groups = joined.where("blocks is null").select(F.col("g_key").alias("g_group"), "node", *fps, F.lit(-1).alias("side")).unionByName(cut)

    def work(batches):
        schema = C.arrow_schema("u long, v long")
        held = None

        def out(x):
            node, side = x[1], x[2]
            fp = np.stack(x[3:], 1).view(np.uint64)
            cuts = np.append(np.flatnonzero(R.first_of(x[0])), len(node))
            found = []
            for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if q - p > 1:
                    i, j = near(fp[p:q], side[p:q], radius)[:2]
                    found.append((node[p:q][i], node[p:q][j]))
            u, v = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

        for b in batches:
            x = [C.ints(b.column(c)) for c in ("g_group", "node", "side", *fps)]
            x = x if held is None else [np.concatenate(p) for p in zip(held, x, strict=True)]
            cut = int(np.flatnonzero(R.first_of(x[0]))[-1]) if len(x[0]) else 0
            if cut:
                yield out([c[:cut] for c in x])
            held = [c[cut:] for c in x]
        if held is not None and len(held[0]):
            yield out(held)

    n = C.partitions(rows.sparkSession)
    return groups.repartition(n, "g_group").sortWithinPartitions("g_group").mapInArrow(work, "u long, v long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int, count: int) -> DataFrame:
    """distinct: g_fp.  u, v: links enough to connect what is within `radius`."""
    m = radius + 1
    while m < 2 * radius and count >> (64 * (m - radius) // m) > GROUP:
        m += 1
    edges = [64 * x // m for x in range(m + 1)]
    masks = [signed(sum(((1 << edges[x + 1]) - 1) ^ ((1 << edges[x]) - 1) for x in chosen)) for chosen in combinations(range(m), m - radius)]
    # keys of few fingerprints meet in a group, so that it has about GROUP rows
    buckets = max(1, count // GROUP)
    keys = F.array(*[F.xxhash64(F.lit(t), F.pmod(F.xxhash64(F.col("g_fp").bitwiseAND(F.lit(x))), F.lit(buckets))) for t, x in enumerate(masks)])
    rows = distinct.select(F.col("g_fp").alias("node"), F.col("g_fp").alias("f0"), F.bit_count("g_fp").cast("int").alias("ones"), F.explode(keys).alias("g_key"))
    return grouped(rows, radius, 1)


def near_duplicates(docs: DataFrame, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """g_k, g_d, g_fp, g_root (the least fingerprint of the component) and g_least (its least g_d)."""
    prints = fingerprinted(docs, doc_id, text)
    each = C.stage(prints.groupBy("g_fp").agg(F.min("g_d").alias("g_first"), F.count(F.lit(1)).alias("g_n")), "distinct")
    count, total = each.agg(F.count(F.lit(1)), F.sum("g_n")).first()
    roots = components(links(each.select("g_fp"), radius, count)).withColumnRenamed("u", "g_fp")
    named = C.stage(each.join(roots, "g_fp", "left").withColumn("g_root", F.coalesce("root", "g_fp")).drop("root"), "named")
    least = C.stage(named.groupBy("g_root").agg(F.min("g_first").alias("g_least"), F.count(F.lit(1)).alias("g_m")), "least")
    known = C.stage(C.joined_by_size(named.drop("g_first"), least, "g_root", "g_m", count), "known")
    return C.joined_by_size(prints, known, "g_fp", "g_n", total or 0)


def classes(docs: DataFrame, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id within reach)."""
    found = near_duplicates(docs, radius, doc_id, text)
    return found.select(C.real_id(F.col("g_d")).alias("doc_id"), F.lpad(F.lower(F.hex("g_fp")), 16, "0").alias("fingerprint"), C.real_id(F.col("g_least")).alias("component_id"))


# similarity of sets


def shingles(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each different shingle, by document and hash.  A-Z count as a-z."""
    w = C.Words(raw, off)
    words = w.hashes(fold=True)
    g = C.grams(words, n)
    whole = w.doc[: len(g)] == w.doc[n - 1 :]
    h, doc = [g[whole]], [w.doc[: len(g)][whole]]
    size = np.diff(w.first)
    for k in range(1, n):
        d = np.flatnonzero(size == k)
        x = words[w.first[d]].copy()
        for i in range(1, k):
            x = x * C.M1 + words[w.first[d] + i]
        h.append(C.mix(x ^ np.uint64(k)))
        doc.append(d)
    h, doc = np.concatenate(h), np.concatenate(doc)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = R.first_of(doc, h)
    return h[new], doc[new]


def set_prints(raw: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, ...]:
    """Digest of each document's set of shingles, its size, and its fingerprint in two words."""
    docs = len(off) - 1
    digest, f0, f1 = np.zeros((3, docs), np.uint64)
    h, doc = shingles(raw, off, shingle)
    size = np.bincount(doc, minlength=docs)
    some = np.flatnonzero(size)
    if len(some):
        first = np.searchsorted(doc, some)
        digest[some] = C.mix(np.add.reduceat(C.mix(h * C.M1), first) + size[some].astype(np.uint64) * C.M2)
        f0[some], f1[some] = majority(C.mix(h * C.M2), first), majority(C.mix(h * C.M3), first)
    return digest, size, f0, f1


def set_printed(docs: DataFrame, shingle: int) -> DataFrame:
    """docs: g_k, g_d, g_h, g_text.  g_k, g_d, g_h, node (digest), n (size), f0, f1, of each row."""

    def work(batches):
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            got = [set_prints(raw[off[i] : off[j]], off[i : j + 1] - off[i], shingle) for i, j in C.runs(off)]
            cols = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*got, strict=True)] if got else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column("g_k"), b.column("g_d"), b.column("g_h"), *cols], names=["g_k", "g_d", "g_h", "node", "n", "f0", "f1"])

    return C.bounded(docs).mapInArrow(work, "g_k long, g_d long, g_h long, node long, n long, f0 long, f1 long")


def table_masks(bits: int, tables: int) -> list[tuple[int, int]]:
    """Masks of `bits` of 128 bits each, in two words; fixed choices."""
    rng = np.random.default_rng(42)
    out = []
    for _ in range(tables):
        chosen = rng.choice(128, bits, replace=False).tolist()
        out.append((sum(1 << x for x in chosen if x < 64), sum(1 << (x - 64) for x in chosen if x >= 64)))
    return out


def candidates(nodes: DataFrame, count: int, radius: int, tables: int) -> DataFrame:
    """nodes: node, f0, f1.  u, v: links enough to connect candidates.  Beyond TABLE_ROWS rows a
    key, a key takes more bits, and tables grow in number so as to miss no more."""
    bits = max(BITS, (count // TABLE_ROWS).bit_length())
    masks = table_masks(bits, round(tables / 0.848 ** (bits - BITS)))
    buckets = max(1, count // SET_GROUP)
    keys = F.array(*[F.xxhash64(F.lit(t), F.pmod(F.xxhash64(F.col("f0").bitwiseAND(F.lit(signed(x))), F.col("f1").bitwiseAND(F.lit(signed(y)))), F.lit(buckets))) for t, (x, y) in enumerate(masks)])
    ones = (F.bit_count("f0") + F.bit_count("f1")).cast("int").alias("ones")
    return grouped(nodes.select("node", "f0", "f1", ones, F.explode(keys).alias("g_key")), radius, 2)


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of `a` shares with each of `b`, by bit sets."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.int32)

    def bit_sets(sets, flat, members):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(members, flat), len(members) - 1)
        ok = members[at] == flat
        dense = np.zeros((len(sets), -(-len(members) // 64) * 64), bool)
        dense[row[ok], at[ok]] = True
        return np.packbits(dense, axis=1, bitorder="little").view(np.uint64)

    for x in range(0, len(both), MEMBERS):
        members = both[x : x + MEMBERS]
        p, q = bit_sets(a, flat_a, members), bit_sets(b, flat_b, members)
        for word in range(p.shape[1]):
            out += np.bitwise_count(p[:, None, word] & q[None, :, word])
    return out


def alike(a: list[np.ndarray], b: list[np.ndarray], least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of `a` and `b` have a Jaccard similarity of least[0] / least[1] or more."""
    found = []
    size_a, size_b = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            both = common_counts(a[i : i + TILE], b[j : j + TILE]).astype(np.int64)
            either = size_a[i : i + TILE, None] + size_b[None, j : j + TILE] - both
            x, y = np.nonzero(least[1] * both >= least[0] * either)
            found.append((x + i, y + j))
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def as_sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def settled(nodes: DataFrame, docs: DataFrame, roots: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """The links among nodes of one candidate component, enough to connect what is alike.  nodes:
    node, g_k, g_d; docs: g_k, g_d, g_text; roots: u, root."""
    both = roots.select("u", "root").unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    asked = nodes.join(both.withColumnRenamed("u", "node"), "node").select("node", "root", "g_k", "g_d")
    texts = docs.select("g_k", "g_d", "g_text").join(asked, ["g_k", "g_d"]).select("node", "root", "g_text")

    def make(batches):
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            sets, sizes = [], []
            for i, j in C.runs(off):
                h, doc = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                sets += [h[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
                sizes.append(np.diff(at))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), pa.array(np.concatenate([np.zeros(0, np.int64), *sizes])), pa.array(sets, pa.binary())], names=["node", "root", "n", "g_set"])

    # rows equal in id and text give one node's set more than once
    sets = C.stage(C.bounded(texts).mapInArrow(make, "node long, root long, n long, g_set binary").dropDuplicates(["node"]), "sets")
    hubs = sets.where("node = root").select("root", F.col("g_set").alias("g_hub"))

    def star(batches):
        for b in batches:
            mine, hubs = as_sets(b.column("g_set")), as_sets(b.column("g_hub"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(mine, hubs, strict=True)], np.int64)
            either = np.array([len(x) + len(y) for x, y in zip(mine, hubs, strict=True)], np.int64) - both
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), b.column("n"), pa.array(least[1] * both >= least[0] * either)], names=["node", "root", "n", "near"])

    stars = C.stage(sets.join(hubs, "root").mapInArrow(star, "node long, root long, n long, near boolean"), "stars")
    first = stars.where("near AND node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    tiles = lambda n, size: F.greatest(F.ceil(n / SET_ROWS), F.ceil(size / SET_MEMBERS)).cast("int")
    apart = F.when(~F.col("near"), F.col("n"))
    cut = stars.groupBy("root").agg(F.count(apart).alias("far"), tiles(F.count(apart), F.sum(apart)).alias("k_far"), tiles(F.count(F.lit(1)), F.sum("n")).alias("k_all")).where("far > 0").drop("far")
    open_ = sets.join(stars.select("node", "near"), "node").join(cut, "root")
    tile = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = open_.select("root", "node", "g_set", tile("k_all").alias("y"), F.explode(F.sequence(F.lit(0), F.col("k_far") - 1)).alias("x"), F.lit(1).alias("side"))
    far = open_.where("NOT near").select("root", "node", "g_set", tile("k_far").alias("x"), F.explode(F.sequence(F.lit(0), F.col("k_all") - 1)).alias("y"), F.lit(0).alias("side"))
    pairs = every.unionByName(far).select(F.xxhash64("root", "x", "y").alias("g_group"), "side", "node", "g_set")

    def compare(batches):
        held: list[tuple] = []

        def out():
            a, b = [r for r in held if r[1] == 0], [r for r in held if r[1] == 1]
            i, j = alike([np.frombuffer(r[3], np.uint64) for r in a], [np.frombuffer(r[3], np.uint64) for r in b], least)
            node = np.array([r[2] for r in a + b], np.int64)
            name, at = np.unique(node, return_inverse=True)
            found = Links(len(name))
            found.add(at[i], at[len(a) + j])
            u, v = found.spanning()
            return pa.RecordBatch.from_arrays([pa.array(name[u]), pa.array(name[v])], names=["u", "v"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("g_group", "side", "node", "g_set")), strict=True):
                if held and held[-1][0] != r[0]:
                    yield out()
                    held = []
                held.append(r)
        if held:
            yield out()

    n = C.partitions(nodes.sparkSession)
    return first.unionByName(pairs.repartition(n, "g_group").sortWithinPartitions("g_group").mapInArrow(compare, "u long, v long"))


def one_each(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5), radius: int = RADIUS, tables: int = TABLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with one document, the least id, of each group of near-duplicates: sets
    of `shingle`-word shingles with a Jaccard similarity of least[0] / least[1] or more, directly
    or by a chain."""
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keys = [C.doc_key(F.col(doc_id), F.col(text)).alias("g_k"), C.sort_id(F.col(doc_id)).alias("g_d"), F.xxhash64(*hashable).alias("g_h")]
    base = docs.select(*keys, F.col(text).alias("g_text"))
    prints = C.stage(set_printed(base, shingle), "prints")
    nodes = C.stage(prints.groupBy("node").agg(F.min(F.struct("g_d", "g_k", "g_h", "n", "f0", "f1")).alias("x")).select("node", "x.*"), "nodes")
    some = nodes.where("n > 0")
    roots = components(candidates(some, some.count(), radius, tables))
    joined = components(settled(nodes, base, roots, shingle, least)).withColumnRenamed("u", "node")
    found = nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = found.groupBy("root").agg(F.min(F.struct("g_d", "g_k", "g_h")).alias("x")).select("x.*")
    keyed = docs.select(F.struct("*").alias("g_row"), *keys)
    return keyed.join(stay, ["g_k", "g_d", "g_h"]).dropDuplicates(["g_k", "g_d", "g_h"]).select("g_row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))

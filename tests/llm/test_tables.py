import collections
import zlib

import numpy as np
import pytest
from compare import same

from granary.llm import mixing, queries, sharding, topk


def plain_best_fit(sizes, capacity, count=None):
    """Item by item: the fullest bin that an item fits."""
    left, out = [capacity] * (count or 0), collections.Counter()
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= s]
        if fits:
            i = min(fits, key=lambda i: (left[i], i))
        elif count:
            i = max(range(count), key=lambda i: (left[i], i))
        else:
            i = len(left)
            left.append(max(capacity, s))
        left[i] -= s
        out[s, i] += 1
    return out


def test_best_fit():
    assert sharding.capacity_of({100: 1, 1: 4}, 3) == 2 and sharding.capacity_of({}, 16) == 1
    rng = np.random.default_rng(0)
    for case in range(60):
        items = rng.integers(1, 60, rng.integers(1, 120)).tolist()
        sizes, count = collections.Counter(items), [None, 3, 16][case % 3]
        capacity = sharding.capacity_of(sizes, count) if count else int(rng.integers(40, 200))
        got, seen = collections.Counter(), collections.defaultdict(list)
        for size, lo, hi, bin_ in sharding.best_fit_decreasing(sizes, capacity, count):
            got[size, bin_] += hi - lo
            seen[size] += range(lo, hi)
        assert got == plain_best_fit(items, capacity, count)
        assert all(sorted(x) == list(range(sizes[s])) for s, x in seen.items())


def test_tree():
    rng = np.random.default_rng(1)
    keys, tree = set(), sharding.Tree()
    for _ in range(3000):
        k = (int(rng.integers(300)), 0)
        if k in keys:
            keys.remove(k)
            tree.remove(k)
        else:
            keys.add(k)
            tree.add(k)
        x = (int(rng.integers(300)), -1)
        assert tree.at_least(x) == min((k for k in keys if k >= x), default=None)
    assert tree.last() == max(keys) and tree.root.high <= 1.45 * np.log2(len(keys) + 2)


@pytest.mark.parametrize("capacity", [None, 3000])
def test_sharding(docs, corpus, nothing, capacity, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 20)  # some groups are hot
    rows = sharding.sharded(docs, None if capacity else 4, capacity).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    where, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        where[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # every group by its exact size, as best fit has it
    groups = collections.Counter()
    for (_, size, crc), n in want.items():
        groups[size, crc] += size * n
    counts = collections.Counter(groups.values())
    plain = plain_best_fit(list(groups.values()), capacity or sharding.capacity_of(counts, 4), None if capacity else 4)
    assert collections.Counter((groups[g], next(iter(s))) for g, s in where.items()) == plain
    assert sharding.sharded(nothing, None if capacity else 4, capacity).collect() == []


def test_op5_sharding(spark, sf_dir):
    rows = sharding.op5_sharding(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    groups = collections.Counter()
    for d in docs:
        groups[d.text] += len(d.text.encode()) + 1
    text, shard = {d.doc_id: d.text for d in docs}, {}
    for r in rows:
        assert shard.setdefault(text[r.doc_id], r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    plain = plain_best_fit(list(groups.values()), sharding.capacity_of(collections.Counter(groups.values()), 16), 16)
    assert collections.Counter((groups[t], s) for t, s in shard.items()) == plain and len(rows) == len(docs)


def test_shards_are_even(spark):
    rows = [(i, "x" * (i % 97)) for i in range(3000)] + [(i, f"{i} y") for i in range(3000, 9000)]
    sizes = collections.Counter()
    for r in sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) <= 1.02 * min(sizes.values())


def test_mixing(docs, corpus, nothing):
    rows = mixing.mixed(docs, carry=["size"]).collect()
    size = collections.Counter()
    for r in corpus:
        size[r[3]] += len((r[1] or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * size[s]]
        if not over:
            break
        capped |= {s: 3 * size[s] for s in over}
    want = capped | {s: rest * weight[s] / w for s in free}
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and r.carried.size == "7"
        taken[r.source] += r.taken
    # equal rows without an id may tie; each still counts once
    assert len(rows) == len(corpus) and all(abs(taken[s] - want[s]) <= 1 for s in order)
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert mixing.mixed(nothing).collect() == []


@pytest.mark.parametrize("quality", [1.0, 1 / 31, 0.2])
def test_key_ranges(spark, quality):
    """Ranges follow the keys' order, and none has many of a source, however bad its documents."""
    rng = np.random.default_rng(0)
    keys = np.sort(rng.exponential(size=50_000) / quality)
    rows = spark.createDataFrame([(float(k),) for k in keys], "k double").select("k", mixing.bucket(mixing.F.col("k")).alias("b")).orderBy("k").collect()
    b = [r.b for r in rows]
    assert b == sorted(b) and max(collections.Counter(b).values()) < 100


def test_mixing_prefers_quality(spark):
    rows = [(i, ("word " * 20) if i % 2 else ("w#rd " * 20), s) for s in "ab" for i in range(400)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3)).where("source = 'a'").collect()
    picked = collections.Counter(r.doc_id % 2 for r in got if r.taken)
    assert picked[1] > 1.5 * picked[0]


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)] + [(i, [0.5] * 8) for i in range(900, 1300)]
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, [1.0] * 8), (2400, [1.0] * 5), (2500, []), (901, [0.5] * 8)]
    return rows


@pytest.mark.parametrize(("block", "asked"), [(8192, 2048), (100, 3)])
def test_top_k(spark, vectors, block, asked):
    table = topk.prepared(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS score"))
    queries_ = table.where("vec_id % 100 = 0")
    got = sorted(map(tuple, topk.top_k(table, queries_, 10, block, asked).collect()))
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    wide = [(i, np.pad(v, (0, 8 - len(v)))) for i, v in ok]
    want = []
    for q, v in wide:
        if q % 100 == 0:
            best = sorted((-int(v @ x), i) for i, x in wide if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_empty(spark):
    none = topk.prepared(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).collect() == []


def test_tree_skips():
    """Bounds leave out most of well separated clusters."""
    rng = np.random.default_rng(0)
    x = np.floor(np.repeat(rng.normal(size=(40, 6)) * 2000, 100, 0) + rng.normal(size=(4000, 6)) * 5)
    tree = topk.MTree(np.arange(4000), x)
    seen = []

    class Counted:
        def __len__(self):
            return len(x)

        def __getitem__(self, i):
            seen.append(np.size(i))
            return x[i]

    tree.x = Counted()
    scores = x @ x[0]
    assert [s for s, _ in tree.search(-1, x[0], 10)] == sorted(scores.tolist(), reverse=True)[:10]
    assert sum(seen) < 2500


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_queries_share_nodes(kind):
    """A tree's nodes are scored for many queries at a time, not once for each, and exactly."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(2000, 16)), np.repeat(rng.normal(size=(20, 16)), 50, 0), rng.normal(size=(20, 1)).repeat(50, 0) + rng.normal(size=(1000, 16)) / 100])
    x, ids = np.floor(x * 1024).astype(kind), rng.permutation(len(x)) // 2  # ids come twice
    tree, calls = topk.MTree(ids, x), []

    class Counted:
        def __len__(self):
            return len(x)

        def __getitem__(self, i):
            calls.append(i)
            return x[i]

    tree.x, asked = Counted(), np.arange(0, len(x), 8)
    who, scores, found = tree.search_all(ids[asked], x[asked], 10)
    for n, a in enumerate(asked):
        want = sorted((-int(s), i) for s, i in zip(x @ x[a], ids.tolist(), strict=True) if i != ids[a])[:10]
        assert [(-int(s), i) for s, i in zip(scores[who == n], found[who == n].tolist(), strict=True)] == want
    assert len(calls) <= 4 * len(tree.nodes)


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op3_quality_rules", "op7_substring_dedup", "op9_mixing", "op10_topk"])
def test_against_sql(name, spark, sf_dir):
    same(queries.queries()[name], queries.oracle_sql()[name], spark, sf_dir)

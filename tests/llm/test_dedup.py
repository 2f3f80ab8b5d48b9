import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash

from granary.llm import components, repeats, simhash, substring_dedup, suffix_dedup
from granary.llm.common import WORD

SPACE_WORD = re.compile(WORD.encode())


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=["plain", "spread"])
def routing(request, monkeypatch):
    """With and without anchors whose rows are spread."""
    if request.param == "spread":
        real = repeats.frequent
        monkeypatch.setattr(repeats, "frequent", lambda docs, segments, one_in=1, least=1: real(docs, segments, 1, 2))
        monkeypatch.setattr(suffix_dedup, "SPREAD_FROM", 2)
        monkeypatch.setattr(suffix_dedup, "RUN_ROWS", 100)


def test_suffix_kernels():
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (9, 2), (300, 2), (500, 3)):
        raw = rng.integers(97, 97 + k, n).astype(np.uint8)
        raw[n // 3 : n // 3 + n // 4] = 97
        text = raw.tobytes()
        sa = suffix_dedup.suffix_array(raw)
        assert sa.tolist() == sorted(range(n), key=lambda i: text[i:])
        starts = np.array([0, n // 2]) if n > 1 else np.array([0])
        got = suffix_dedup.common_prefixes(raw, sa, starts, np.diff(np.append(starts, n)), 40)
        for i in range(1, n):
            a, b = text[sa[i - 1] :], text[sa[i] :]
            same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert got[i] == min(same, 40)


def test_merge_of_runs():
    x = (np.array([1, 5, 9], np.uint64), np.array([0, 0, 0], np.uint64), np.array([False, False, True]))
    y = (np.array([0, 5, 7], np.uint64), np.array([0, 0, 0], np.uint64), np.array([False, False, True]))
    a, _, known = suffix_dedup.merge_two(x, y)
    assert a.tolist() == [0, 1, 5, 7, 9] and known.tolist() == [False, False, True, True, True]


@pytest.mark.parametrize("length", [200, 40])
def test_suffix_dedup(docs, corpus, routing, length):
    texts = [(r[0], (r[1] or "").encode()) for r in corpus]
    seen = collections.Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    want = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        want.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    done = suffix_dedup.remove_repeats(docs, length, carry=["kept", "lang"])
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in done.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.carried.kept for r in done.collect()} == {"7"}


def test_shards_and_merge_find_what_is_repeated(spark, sf_dir, monkeypatch):
    """The query comes by its result through suffix arrays and the merge of shards: without either,
    repeated bytes stay."""
    whole = suffix_dedup.op2_suffix_dedup(spark, sf_dir).agg({"n_removed": "sum"}).first()[0]
    monkeypatch.setattr(suffix_dedup, "SPREAD_FROM", 2)  # so few documents have no anchor of many variants
    assert suffix_dedup.op2_suffix_dedup(spark, sf_dir).agg({"n_removed": "sum"}).first()[0] == whole

    def without(name, made):
        real = getattr(suffix_dedup, name)
        monkeypatch.setattr(suffix_dedup, name, made(real))
        less = suffix_dedup.op2_suffix_dedup(spark, sf_dir).agg({"n_removed": "sum"}).first()[0]
        monkeypatch.setattr(suffix_dedup, name, real)
        return less

    assert without("merged", lambda real: lambda runs: tuple(x[:0] for x in real(runs))) < whole
    assert without("shard_spans", lambda real: lambda *a: (tuple(x[:0] for x in real(*a)[0]), tuple(x[:0] for x in real(*a)[1]))) < whole


def test_long_document_in_tiles(monkeypatch):
    from granary.llm import common

    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[2000:2600] = raw[100:700]
    off = np.array([0, len(raw)])
    plain = suffix_dedup.byte_segments(200)(raw, off)
    monkeypatch.setattr(common, "CHUNK", 500)
    tiled = suffix_dedup.byte_segments(200)(raw, off)

    def windows(x):
        return {int(at) + i for at, n in zip(x[3], x[4], strict=True) for i in range(n)}

    assert windows(plain) == windows(tiled) == set(range(2801))


def test_long_document_of_words(monkeypatch):
    """More words than a place has bits for."""
    from granary.llm import common

    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 500, 3000)]
    words[2000:2600] = words[100:700]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    off = np.array([0, len(raw)])

    def anchors(x):
        return {int(at) + i: int(a) for a, at, n in zip(x[0], x[3], x[4], strict=True) for i in range(n)}

    plain = anchors(substring_dedup.word_segments(13)(raw, off))
    monkeypatch.setattr(common, "CHUNK", 500)
    monkeypatch.setattr(repeats, "INDEX", np.uint64(1023))
    tiled = anchors(substring_dedup.word_segments(13)(raw, off))
    assert plain == tiled and sorted(tiled) == list(range(2988))
    assert all(tiled[2000 + i] == tiled[100 + i] for i in range(588))


def test_windows_have_two_hashes(spark):
    """Each of the two parts the windows of a text, and neither follows from the other."""
    texts = [" ".join(f"{c}{i}" for i in range(100)) for c in "abc"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate([*texts, texts[0]])], "g_k long, g_d long, g_text string").repartition(4, "g_k")
    asked = docs.selectExpr("*", "array(struct(0 AS g_at, 88 AS g_n)) AS g_all")
    rows = repeats.segment_rows(asked, substring_dedup.word_segments(13, 13), True, []).where("g_state = 0").collect()
    pairs = {(r.g_a, r.g_s) for r in rows}
    assert len(pairs) == len({a for a, _ in pairs}) == len({s for _, s in pairs}) == 3 * 88
    assert len({a ^ s for a, s in pairs}) == 3 * 88


def test_levels(docs, monkeypatch):
    """Lengths double up to the window's; each level looks only at what the one before left."""
    assert substring_dedup.levels(13) == [4, 8, 13] and substring_dedup.levels(32) == [4, 8, 16, 32] and substring_dedup.levels(3) == [3]
    left, real = [], repeats.resolve

    def resolve(rows, earlier, hot):
        found = real(rows, earlier, hot)
        left.append({(r.g_k, r.g_d, r.g_at + i) for r in found.where("g_kind = 1").collect() for i in range(r.g_n)})
        return found

    monkeypatch.setattr(repeats, "resolve", resolve)
    substring_dedup.remove_repeats(docs).count()
    assert len(left) == 3 and left[0] > left[1] > left[2] == set()


@pytest.mark.parametrize("gram", [4, 8, 13])
def test_some_windows(gram):
    """The windows that are asked for, and no others."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, n)) for n in (50, 5, 30, 13)]
    raw = np.frombuffer(" ".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t) + 1 for t in texts)])
    off[-1] -= 1
    got = substring_dedup.word_segments(13, gram)(raw, off, np.array([0, 0, 2, 3]), np.array([2, 30, 0, 0]), np.array([5, 8, 18, 1]))
    have = {(d, at + i) for d, at, n in zip(got[2].tolist(), got[3].tolist(), got[4].tolist(), strict=True) for i in range(n)}
    assert have == {(0, x) for x in [*range(2, 7), *range(30, 38)]} | {(2, x) for x in range(18)} | {(3, 0)}


def test_substring_dedup(docs, corpus, routing):
    texts = [(2**63 - 1 if r[0] is None else r[0], SPACE_WORD.findall((r[1] or "").encode())) for r in corpus]
    least = {}
    for d, w in texts:
        for i in range(len(w) - 12):
            least[tuple(w[i : i + 13])] = min(d, least.get(tuple(w[i : i + 13]), d))
    want = []
    for d, w in texts:
        gone = bytearray(len(w))
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = b"\1" * 13
        want.append((None if d == 2**63 - 1 else d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    done = substring_dedup.remove_repeats(docs, carry=["kept"])
    assert rows_of(done.select("doc_id", "n_words", "n_removed", "kept")) == sorted(want, key=repr)


def test_xxh64():
    rng = np.random.default_rng(0)
    raw, start, size = rng.integers(0, 256, 3000).astype(np.uint8), rng.integers(0, 2800, 300), rng.integers(0, 150, 300)
    want = [xxhash.xxh64_intdigest(raw[a : a + n].tobytes(), 42) for a, n in zip(start, size, strict=True)]
    assert simhash.xxh64(raw, start, size).tolist() == want


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize(("tile", "group", "block"), [(128, 2048, 8192), (2, 4, 3)])
def test_simhash(docs, corpus, monkeypatch, tile, group, block):
    for name, value in (("TILE", tile), ("GROUP", group), ("BLOCK", block), ("SLICE", 7 * tile)):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(simhash.C, "HOT", 1000 if tile > 2 else 10)  # some keys are hot, or none
    prints = [fingerprint(r[1]) for r in corpus]
    label = [2**63 - 1 if r[0] is None else r[0] for r in corpus]
    while True:
        new = [min(m for q, m in zip(prints, label, strict=True) if (p ^ q).bit_count() <= 4) for p in prints]
        if new == label:
            break
        label = new
    want = [(r[0], f"{p:016x}", m) for r, p, m in zip(corpus, prints, label, strict=True)]
    assert rows_of(simhash.classes(docs)) == sorted(want, key=repr)


def test_tiles_compared_and_skipped():
    """Links of a group against all pairs; tiles too far apart in population count are skipped."""
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 2000, np.uint64) & rng.integers(0, 2**63, 2000, np.uint64) | rng.integers(0, 2**63, 2000, np.uint64) * (rng.random(2000) < 0.5)
    fp[1000:1300] = fp[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    for sides in (np.full(2000, -1), rng.integers(0, 2, 2000)):
        i, j, compared, skipped = simhash.near(fp[:, None], sides, 4)
        tiles = -(-2000 // simhash.TILE)
        assert compared + skipped == tiles * (tiles + 1) // 2 and skipped > 20 and compared >= tiles
        x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
        ok = (sides[x] < 0) | (sides[x] != sides[y])
        assert (simhash.forest(i, j, 2000) == simhash.forest(x[ok], y[ok], 2000)).all()


def test_query_compares_tiles(spark, sf_dir, monkeypatch):
    """Every link of the query comes out of tiles: without them there is none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    distinct = simhash.fingerprinted(docs).select("g_fp").distinct()
    assert simhash.links(distinct, 4, distinct.count()).count() > 0
    monkeypatch.setattr(simhash, "near", lambda fp, side, radius: (np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0))
    assert simhash.links(distinct, 4, distinct.count()).count() == 0


def test_tables_miss_few():
    """The chance that no table has a pair of a similarity, by its distribution of differing bits."""
    masks = [x | y << 64 for x, y in simhash.table_masks(simhash.BITS, simhash.TABLES)]
    bits = np.array([[m >> b & 1 for b in range(128)] for m in masks], bool)
    rng = np.random.default_rng(0)
    for similarity, most in ((0.8, 0.01), (0.9, 1e-3)):
        p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
        differ = rng.random((20_000, 128)) < p
        met = ((differ.astype(np.float32) @ bits.T.astype(np.float32)) == 0).any(1) & (differ.sum(1) <= simhash.RADIUS)
        assert 1 - met.mean() <= most


def test_bit_counts():
    rng = np.random.default_rng(1)
    h, first = rng.integers(0, 2**63, 2000, np.uint64), np.array([0, 1, 5, 800])
    want = [[sum(int(x) >> b & 1 for x in part) for b in range(64)] for part in np.split(h, first[1:])]
    assert simhash.counted(h, first).tolist() == want


def test_set_comparison(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(simhash, "TILE", 7)
    monkeypatch.setattr(simhash, "MEMBERS", 64)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 60))).astype(np.uint64) for _ in range(40)] + [np.arange(300, dtype=np.uint64)]
    i, j = simhash.alike(sets[:20], sets[10:], (1, 2))
    want = {(x, y) for x in range(20) for y in range(31) if 2 * len(np.intersect1d(sets[x], sets[10 + y])) >= len(np.union1d(sets[x], sets[10 + y]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("size", [1_000_000, 30, 1])
def test_components(spark, monkeypatch, size):
    """In one task, in several, and by stars alone."""
    monkeypatch.setattr(components, "EDGES", size)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)] + [(500, x) for x in range(501, 560)] + [(x, y) for x in range(600, 620) for y in range(600, 620)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {i: 0 for i in range(1, 61)} | {150: 100, 200: 100} | {x: 500 for x in range(501, 560)} | {x: 600 for x in range(601, 620)}
    assert got == want


def test_equal_rows_keep_the_same(spark):
    """Of rows equal in id and text, the same one stays in any order."""
    rows = [(1, "a b c d e f", "en", s) for s in "xyzw"] * 2 + [(2, "a b c d e f", "en", "v"), (3, None, "en", "x"), (3, "", "en", "x"), (4, " ", None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = [sorted(map(tuple, simhash.one_each(made.repartition(n, "source") if n else made.orderBy("source")).collect())) for n in (0, 3)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 3]


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, substring_dedup.remove_repeats, simhash.classes, simhash.one_each])
def test_empty(nothing, run):
    assert run(nothing).collect() == []


def shingle_set(text):
    w = [x.lower() for x in SPACE_WORD.findall((text or "").encode())]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    """The least id of each group of texts at 0.8 or more, pair by pair."""
    sets = [shingle_set(t) for _, t in rows]
    label = [2**63 - 1 if d is None else d for d, _ in rows]
    near = [[j for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)] for x in sets]
    while True:
        new = [min(label[j] for j in js) for js in near]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("rows", [4096, 2])
def test_one_each(docs, corpus, monkeypatch, rows):
    monkeypatch.setattr(simhash, "SET_ROWS", rows)
    want = near_groups([(r[0], r[1]) for r in corpus])
    kept = simhash.one_each(docs).collect()
    assert sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in kept) == sorted(set(want)) and kept[0].kept == "7"


def test_pipeline_edited_copies(spark):
    """Copies with words replaced, just over and just under 0.8, and chains of them."""
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            if i % 2:  # a chain: each an edit of the copy before
                words = list(words)
            else:
                words = rows[5 * i][1].split()
            for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.01, 0.035))), replace=False):
                words[at] = f"new{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(words)))
    want = near_groups(rows)
    assert 40 < len(set(want)) < 160
    made = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, made, "").collect()) == sorted(set(want))

"""Removal of repeated byte strings by suffix arrays.

Anchors (see repeats.py) bring together, in one shard, every stretch of text that could hold a
repeated string; copies of a stretch count as one.  Each shard sorts the suffixes of its
stretches by Larsson-Sadakane refinement and gets common prefixes with their neighbours by
Kasai's rule: a string is repeated if a neighbour shares `length` bytes.  The stretches of an
anchor that has SPREAD_FROM different ones or more are spread over shards; each shard sends its
distinct strings' digests in sorted runs, one for each bucket of digests, and the shards' runs are
merged by binary search.

Defined cases: a null text is an empty one; a null doc_id is an id like another, returned as
null; equal rows are two documents; an empty table gives an empty result; a text under `length`
bytes keeps all its bytes; other columns play no part and come back in `carried` if asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import repeats as R

GRAM = 32
SHARD_BYTES = 1 << 20
STRETCH = "g_shard int, g_a long, g_s long, g_k long, g_d long, g_at int, g_n int, g_kind int, g_open boolean, g_raw binary"
MERGED = "g_k long, g_d long, g_at int, g_n int"
SORTED = MERGED + ", g_bucket int, g_run binary"
#: Variants of an anchor from which they are spread over shards.
SPREAD_FROM = 64
#: Digests of a bucket aimed at.
RUN_ROWS = 1 << 18


def byte_segments(length: int):
    """length: over GRAM bytes."""

    def segments(raw: np.ndarray, off: np.ndarray) -> R.Segments:
        n = len(raw)
        if len(off) == 2 and n > 4 * C.CHUNK:  # one long document, in overlapping tiles
            tiles = [segments(raw[t : t + C.CHUNK + length - 1], np.array([0, min(C.CHUNK + length - 1, n - t)])) for t in range(0, n - length + 1, C.CHUNK)]
            for t, x in enumerate(tiles):
                x[3][:] += t * C.CHUNK
            return tuple(np.concatenate(x) for x in zip(*tiles, strict=True))
        m = n - GRAM + 1
        if n < length:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        packed = np.concatenate([raw, np.zeros(8, np.uint8)])
        view = np.ndarray((n,), np.uint64, buffer=packed.data, strides=(1,))
        h = view[:m] * C.M1
        for k in range(8, GRAM, 8):
            h ^= h >> np.uint64(29)
            h += view[k : k + m]
            h *= C.M1
        C.mix(h)
        step = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(np.diff(off) >= length)
        np.add.at(step, off[long], 1)
        np.add.at(step, off[long + 1] - length + 1, -1)
        valid = np.cumsum(step[:n]) > 0
        first, count, anchor = R.own(h, valid, length - GRAM + 1)
        doc = np.searchsorted(off, first, "right") - 1
        view8, digest = memoryview(packed), xxhash.xxh3_64_intdigest
        s = np.fromiter((digest(view8[i:j]) for i, j in zip(first.tolist(), (first + count + (length - 1)).tolist(), strict=True)), np.uint64, len(first))
        return h[anchor], s, doc, first - off[doc], count

    return segments


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes (Larsson-Sadakane): groups of equal prefixes are refined by
    the rank of what follows, with twice the prefix each time; single suffixes rest.  The order
    is complete, as Kasai's rule needs it."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    sa = np.argsort(key)
    key = key[sa]
    new = R.first_of(key)
    rank, h = np.empty(n, np.int64), 8
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while h < n:
        single = new & np.append(new[1:], True)
        act = np.flatnonzero(~single)
        if not len(act):
            break
        pos = sa[act]
        after = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        both = rank[pos] * (n + 1) + after
        o = np.argsort(both)
        both, pos = both[o], pos[o]
        fresh = R.first_of(both)
        sa[act] = pos
        new[act] = fresh
        rank[pos] = act[np.maximum.accumulate(np.where(fresh, np.arange(len(act)), 0))]
        h *= 2
    return sa


def common_prefixes(raw: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """For each place in `sa`, the bytes (up to depth) its suffix shares with the one before.
    Kasai's rule, a lane for each stretch: a suffix shares at least what the one that starts a
    byte earlier does, less one."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(depth + 16, np.uint8)])
    view = np.ndarray((n + depth + 8,), np.uint64, buffer=padded.data, strides=(1,))
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[:1]] = -1
    plcp = np.zeros(n, np.int16)
    o = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[o], sizes[o]
    shared = np.zeros(len(starts), np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, "left"))
        pos = starts[:live] + step
        prev = before[pos]
        h = np.maximum(shared[:live] - 1, 0)
        h[prev < 0] = 0
        todo = np.flatnonzero((prev >= 0) & (h < depth))
        while len(todo):
            x = view[pos[todo] + h[todo]] ^ view[prev[todo] + h[todo]]
            more = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            h[todo] += more
            todo = todo[(more == 8) & (h[todo] < depth)]
        h = np.minimum(h, np.minimum(depth, n - np.maximum(pos, prev)))
        shared[:live] = h
        plcp[pos] = h
    return plcp[sa]


def repeated_windows(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, place in it, and number of the class of equal strings, for each window of the
    stretches that `raw` has one after another."""
    sa = suffix_array(raw)
    lcp = common_prefixes(raw, sa, starts, sizes, length)
    group = np.cumsum(lcp < length)
    who = np.searchsorted(starts, sa, "right") - 1
    at = sa - starts[who]
    whole = at + length <= sizes[who]
    return who[whole], at[whole], group[whole]


def digests(raw: np.ndarray, at: np.ndarray, length: int, times: np.uint64) -> np.ndarray:
    """64-bit hashes of the strings of `length` bytes (8 or more) at some places."""
    view = np.ndarray((len(raw) - 7,), np.uint64, buffer=raw.data, strides=(1,))
    h = np.full(len(at), length, np.uint64) * times
    for k in [*range(0, length - 7, 8), length - 8]:
        h = C.mix((h ^ view[at + k]) * times)
    return h


def shard_spans(rows: list[tuple], length: int):
    """rows of STRETCH, one shard.  Spans found in it, and the distinct strings of the stretches
    that other shards may share, for the merge."""
    raw = np.frombuffer(b"".join([r[9] for r in rows]) + bytes(8), np.uint8)
    sizes = np.array([len(r[9]) for r in rows], np.int64)
    starts = np.cumsum(sizes) - sizes
    who, at, group = repeated_windows(raw[:-8], starts, sizes, length)
    sure = np.array([r[7] == R.WITNESS for r in rows], bool)[who]
    size = np.bincount(group)
    twice = (size > 1) | (np.bincount(group, weights=sure) > 0)
    cols = [np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5)]
    hit = twice[group] & ~sure
    spans = R.joined(cols[0][who[hit]], cols[1][who[hit]], cols[2][who[hit]] + at[hit], np.ones(int(hit.sum()), np.int64))
    open_ = np.array([r[8] for r in rows], bool)[who]
    _, first = np.unique(np.where(open_, group, -1), return_index=True)
    first = first[open_[first]]
    w, p = who[first], at[first]
    a, s = (digests(raw, starts[w] + p, length, x) for x in (C.M1, C.M3))
    state = np.where(twice[group[first]], R.SURE, R.OPEN).astype(np.int32)
    merge = (a, s, cols[1][w], cols[0][w], cols[2][w] + p, np.ones(len(w), np.int64), state)
    return spans, merge


def merge_two(x: tuple, y: tuple) -> tuple:
    """x, y: sorted digests, their second halves, and whether each is known as repeated."""
    at = np.searchsorted(x[0], y[0])
    near = np.minimum(at, max(len(x[0]) - 1, 0))
    both = (x[0][near] == y[0]) & (x[1][near] == y[1]) if len(x[0]) else np.zeros(len(y[0]), bool)
    known = x[2].copy()
    known[near[both]] = True
    new = ~both
    return tuple(np.insert(p, at[new], q[new]) for p, q in zip((x[0], x[1], known), y, strict=True))


def merged(runs: list[tuple]) -> tuple[np.ndarray, ...]:
    """Spans of the strings that more than one run has (or one knows as repeated), where their
    shards did not know.  runs: of each shard, sorted digests with what belongs to them."""
    level = [(r[0], r[1], r[6] == R.SURE) for r in runs]
    while len(level) > 1:
        level = [merge_two(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    digests, _, known = level[0]
    hit = [known[np.searchsorted(digests, r[0])] & (r[6] == R.OPEN) for r in runs]
    return R.joined(*(np.concatenate([r[c][h] for r, h in zip(runs, hit, strict=True)]) for c in (3, 2, 4, 5)))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """docs: g_k, g_d, g_text, bucketed.  One row a document that has repeated windows."""
    spark = docs.sparkSession
    n = C.partitions(spark)
    segments = byte_segments(length)
    hot = R.frequent(docs, segments)
    found = C.stage(R.resolve(R.segment_rows(docs, segments, False, hot), False, hot), "anchors")
    variants = found.where(F.col("g_kind") != R.SPAN)
    counts = C.stage(variants.groupBy("g_a").agg(F.count(F.lit(1)).alias("n")), "counts")
    dealt = C.joined_by_size(variants, counts.withColumn("g_open", F.col("n") >= SPREAD_FROM), "g_a", "n", counts.agg(F.sum("n")).first()[0] or 0)
    dealt = C.stage(dealt, "variants")
    total = dealt.agg(F.sum(F.col("g_n") + (length - 1)), F.sum(F.when(F.col("g_open"), F.col("g_n")))).first()
    shards, buckets = max(n, (total[0] or 0) // SHARD_BYTES), np.uint64(max(1, -(-(total[1] or 0) // RUN_ROWS)))
    spread = F.when(F.col("g_open"), F.xxhash64("g_a", "g_s")).otherwise(F.xxhash64("g_a"))
    asked = dealt.select("g_k", "g_d", F.struct(F.pmod(spread, F.lit(shards)).cast("int").alias("shard"), "g_a", "g_s", "g_at", "g_n", "g_kind", "g_open").alias("g_one")).groupBy("g_k", "g_d").agg(F.collect_list("g_one").alias("g_all"))

    def fetch(batches):
        schema = C.arrow_schema(STRETCH)
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            lists = b.column("g_all")
            at = lists.offsets.to_numpy()
            one = lists.values
            doc = np.repeat(np.arange(len(lists)), np.diff(at))
            shard, a, s, pos, m, kind, spread_ = (C.ints(one.field(i))[at[0] : at[-1]] for i in range(7))
            k, d = C.ints(b.column("g_k"))[doc], C.ints(b.column("g_d"))[doc]
            i = off[doc] + pos
            view = memoryview(raw)
            for x in range(0, len(doc), 5_000):
                y = slice(x, x + 5_000)
                cut = [bytes(view[p:q]) for p, q in zip(i[y].tolist(), (i[y] + m[y] + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v[y]) for v in (shard, a, s, k, d, pos, m, kind, spread_)] + [pa.array(cut, pa.binary())], schema=schema)

    def sort(batches):
        held: list[tuple] = []
        schema = C.arrow_schema(SORTED)

        def out(rows):
            spans, merge = shard_spans(rows, length)
            o = np.lexsort((merge[1], merge[0]))
            merge = [c[o] for c in merge]
            bucket = (merge[0] % buckets).astype(np.int32)
            which = np.unique(bucket)
            packed = [np.stack([c[bucket == w].astype(np.int64, copy=False) if i > 1 else c[bucket == w].view(np.int64) for i, c in enumerate(merge)]).tobytes() for w in which]
            n, m = len(spans[0]), len(which)
            cols = [np.concatenate([c, np.zeros(m, np.int64)]) for c in spans] + [np.concatenate([np.full(n, -1), which])]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if i > 1 else c) for i, c in enumerate(cols)] + [pa.array([None] * n + packed, pa.binary())], schema=schema)

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                if held and held[-1][0] != r[0]:
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)

    def merge(table: pa.Table) -> pa.Table:
        runs = []
        for raw in table.column("g_run").to_pylist():
            x = np.frombuffer(raw, np.int64).reshape(7, -1)
            runs.append((x[0].view(np.uint64), x[1].view(np.uint64), *x[2:]))
        spans = merged(runs)
        return pa.Table.from_arrays([pa.array(c.astype(np.int32) if i > 1 else c) for i, c in enumerate(spans)], schema=C.arrow_schema(MERGED))

    stretches = R.within(docs.select("g_k", "g_d", "g_text"), asked).mapInArrow(fetch, STRETCH)
    done = C.stage(stretches.repartition(n, "g_shard").sortWithinPartitions("g_shard", "g_a", "g_s").mapInArrow(sort, SORTED), "suffixes")
    columns = ["g_k", "g_d", "g_at", "g_n"]
    across = done.where("g_bucket >= 0").groupBy("g_bucket").applyInArrow(merge, MERGED)
    spans = found.where(F.col("g_kind") == R.SPAN).select(*columns).unionByName(across).unionByName(done.where("g_bucket < 0").select(*columns))
    return spans.groupBy("g_k", "g_d").agg(F.collect_list(F.struct("g_at", "g_n")).alias("g_spans"))


def cover(spans: list | None, width: int) -> list[tuple[int, int]]:
    """Units covered by spans of windows, as maximal ranges."""
    out: list[tuple[int, int]] = []
    for i, j in sorted((x["g_at"], x["g_at"] + x["g_n"] - 1 + width) for x in spans or ()):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def remove_repeats(docs: DataFrame, length: int = 200, carry: list[str] | None = None, decode: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every byte covered by a `length`-byte string that starts twice or more goes.

    Returns doc_id, carried, kept (bytes; with `decode` a string, without the rests of characters
    that were cut), n_bytes, n_removed, spans (start, stop: the maximal removed runs)."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), C.carried(docs, carry).alias("carried"), F.col(text).alias("g_text"), C.doc_key(F.col(doc_id), F.col(text)).alias("g_k"), C.sort_id(F.col(doc_id)).alias("g_d"))
    base = C.bucketed(base, ["g_k", "g_d"], "texts")
    whole = base.join(repeated_spans(base, length).hint("shuffle_hash"), ["g_k", "g_d"], "left").select("doc_id", "carried", "g_text", "g_spans")
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([whole.schema["doc_id"], whole.schema["carried"], T.StructField("kept", T.StringType() if decode else T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span_type)])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            view = memoryview(raw)
            kept, gone, where = [], [], []
            for i, spans in enumerate(b.column("g_spans").to_pylist()):
                lo, hi = int(off[i]), int(off[i + 1])
                cuts = cover(spans, length)
                at, parts = 0, []
                for p, q in cuts:
                    parts.append(view[lo + at : lo + p])
                    at = q
                parts.append(view[lo + at : hi])
                kept.append(b"".join(parts))
                gone.append(sum(q - p for p, q in cuts))
                where.append([{"start": p, "stop": q} for p, q in cuts])
            cols = [b.column("doc_id"), b.column("carried"), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if decode else pa.array(kept, pa.binary()), pa.array(np.diff(off)), pa.array(gone, pa.int64()), pa.array(where, arrow.field("spans").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return whole.mapInArrow(work, schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

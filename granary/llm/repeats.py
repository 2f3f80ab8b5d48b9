"""Which windows of a corpus occur more than once: the engine under both exact deduplicators.

A window is W consecutive units (bytes or words) of one document.  Each window is owned by its
anchor: the g-unit string in it with the least hash, the first on ties.  That choice depends on
the window's content alone, so equal windows have equal anchors at equal places.  Consecutive
windows with one anchor form a segment, and one row for each segment is dealt out by the
anchor's hash: about 2/(W-g+2) rows a unit instead of one.  Where the anchors meet,

* an anchor seen once has no repeated window;
* segments of equal content repeat window for window: the verdict is at hand;
* segments of different content (variants) may share some windows: one representative of each
  content goes on to be compared window for window.

A batch of documents settles what repeats inside it before anything is shuffled, so a passage
with any number of copies sends at most one row a batch.  Anchors that a sample shows to be
frequent are dealt out by content as well; the sample steers routing only, never a result.

Equality is that of 64-bit hash pairs (anchor and content, 128 bits together).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROWS = "g_part long, g_a long, g_s long, g_d long, g_k long, g_at int, g_n int, g_state int"
FOUND = "g_k long, g_d long, g_at int, g_n int, g_kind int, g_a long, g_s long"
OPEN, SEEN, SURE = 0, 1, 2  # states: undecided; repeated, a final span; undecided but seen twice
SPAN, ASKS, WITNESS = 0, 1, 2  # kinds of findings
#: Rows that are settled together before the shuffle.
BATCH = 75_000
INDEX = np.uint64((1 << 24) - 1)

Segments = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def own(h: np.ndarray, valid: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor's place of each segment.  h: hashes of the
    grams; w: grams in a window; valid: whether a window starts at each place."""
    keys = (h & ~INDEX) | np.arange(len(h), dtype=np.uint64)
    at = (C.sliding_min(keys, w) & INDEX).astype(np.int64)
    valid = valid[: len(at)]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    firsts = np.flatnonzero(new & valid)
    breaks = np.append(np.flatnonzero(new | ~valid), len(at))
    stop = breaks[np.searchsorted(breaks, firsts, "right")]
    return firsts, stop - firsts, at[firsts]


def first_of(*cols: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    new = np.ones(len(cols[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new


def joined(k: np.ndarray, d: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of a document that touch or overlap become one."""
    if not len(k):
        return k, d, at, n
    o = np.lexsort((at, k))
    k, d, at, n = k[o], d[o], at[o].astype(np.int64), n[o].astype(np.int64)
    new = first_of(k)
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(at + n + group * (1 << 33)) - group * (1 << 33)
    new[1:] |= at[1:] > reach[:-1]
    i = np.flatnonzero(new)
    return k[i], d[i], at[i], np.append(reach[i[1:] - 1], reach[-1]) - at[i]


def settle(a, s, d, k, at, n, earlier: bool, hot: np.ndarray) -> pa.RecordBatch:
    """What one batch of segments already shows of itself, as rows of ROWS."""
    o = np.lexsort((at, d, s, a))
    a, s, d, k, at, n = (x[o] for x in (a, s, d, k, at, n))
    new = first_of(a, s)
    i = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    if earlier:
        seen = d > d[i][group] if len(i) else new
        state = np.zeros(len(a), np.int32)
    else:
        many = np.diff(np.append(i, len(a))) > 1
        seen = ~new
        state = np.where(many[group], SURE, OPEN).astype(np.int32) if len(i) else np.zeros(0, np.int32)
    left = ~seen
    spans = joined(*(x[seen] for x in (k, d, at, n)))
    part = np.where(np.isin(a, hot), C.mix((a * C.M1) ^ s), a) if len(hot) else a
    zero = np.zeros(len(spans[0]), np.uint64)
    cols = [
        np.concatenate([part[left], spans[0].view(np.uint64)]).view(np.int64), np.concatenate([a[left], zero]).view(np.int64), np.concatenate([s[left], zero]).view(np.int64),
        np.concatenate([d[left], spans[1]]), np.concatenate([k[left], spans[0]]), np.concatenate([at[left], spans[2]]).astype(np.int32), np.concatenate([n[left], spans[3]]).astype(np.int32),
        np.concatenate([state[left], np.full(len(zero), SEEN, np.int32)]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=C.arrow_schema(ROWS))


def resolve(rows: DataFrame, earlier: bool, hot: list[int]) -> DataFrame:
    """Rows of ROWS to findings: final spans, and the variants that must be compared further.
    earlier: a repeat counts only if a smaller document has it."""
    n = C.partitions(rows.sparkSession)
    hots = np.array(hot, np.int64)

    def whole(x: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        a, s, d, k, at, m, state = x
        new_a, new_s = first_of(a), first_of(a, s)
        i_s, i_a = np.flatnonzero(new_s), np.flatnonzero(new_a)
        of_s, of_a = np.cumsum(new_s) - 1, np.cumsum(new_a) - 1
        classes = np.add.reduceat(new_s.astype(np.int64), i_a) if len(i_a) else i_a
        vary = (classes[of_a] > 1) | np.isin(a, hots)
        if earlier:
            sure = d > d[i_s][of_s]
            asks = vary & ~sure
            witness = np.zeros(len(a), bool)
        else:
            weight = np.add.reduceat(np.where(state == SURE, 2, 1), i_s)
            sure = (weight > 1)[of_s]
            some = np.logical_or.reduceat(~sure, i_a)[of_a]
            asks, witness = vary & ~sure, vary & sure & new_s & (some | np.isin(a, hots))
        return a, s, d, k, at, m, sure, asks, witness

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = C.arrow_schema(FOUND)

        def out(k, d, at, m, kind, a, s):
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (k, d, at.astype(np.int32), m.astype(np.int32), kind.astype(np.int32), a, s)], schema=schema)

        def decide(x):
            a, s, d, k, at, m, sure, asks, witness = whole(x)
            sp = joined(k[sure], d[sure], at[sure], m[sure])
            v = asks | witness
            zero = np.zeros(len(sp[0]), np.int64)
            return out(*(np.concatenate(p) for p in ((sp[0], k[v]), (sp[1], d[v]), (sp[2], at[v]), (sp[3], m[v]), (zero + SPAN, np.where(asks, ASKS, WITNESS)[v]), (zero, a[v]), (zero, s[v]))))

        held: list[np.ndarray] | None = None
        for b in batches:
            x = [C.ints(b.column(c)) for c in ("g_a", "g_s", "g_d", "g_k", "g_at", "g_n", "g_state")]
            done = x[6] == SEEN
            if done.any():
                sp = joined(x[3][done], x[2][done], x[4][done], x[5][done])
                zero = np.zeros(len(sp[0]), np.int64)
                yield out(*sp, zero + SPAN, zero, zero)
                x = [c[~done] for c in x]
            if held is not None:
                x = [np.concatenate(p) for p in zip(held, x, strict=True)]
            if not len(x[0]):
                continue
            cut = int(np.flatnonzero(first_of(x[0]))[-1])  # the last anchor's rows may go on
            held = [c[cut:] for c in x]
            if cut:
                yield decide([c[:cut] for c in x])
        if held is not None and len(held[0]):
            yield decide(held)

    last = F.when(F.col("g_state") == SEEN, 0).otherwise(1)
    return rows.repartition(n, "g_part").sortWithinPartitions(last, "g_a", "g_s", "g_d", "g_k", "g_at").mapInArrow(work, FOUND)


def frequent(docs: DataFrame, segments: Callable[[np.ndarray, np.ndarray], Segments], one_in: int = 64, least: int = 20) -> list[int]:
    """Anchors with many variants in one of `one_in` documents, at most four for each partition."""

    def work(batches):
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            for i, j in C.runs(off):
                a, s = segments(raw[off[i] : off[j]], off[i : j + 1] - off[i])[:2]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s.view(np.int64))], names=["g_a", "g_s"])

    some = docs.where(F.pmod(F.xxhash64("g_k", F.lit(1)), F.lit(one_in)) == 0).select("g_text").mapInArrow(work, "g_a long, g_s long").distinct()
    top = some.groupBy("g_a").count().where(F.col("count") >= least).orderBy(F.desc("count"), "g_a")
    return [r[0] for r in top.limit(4 * C.partitions(docs.sparkSession)).collect()]


def segment_rows(docs: DataFrame, segments: Callable[..., Segments], earlier: bool, hot: list[int]) -> DataFrame:
    """docs: g_k, g_d, g_text, and g_all if only some windows of theirs count: lists of (first
    window, number)."""
    hots = np.array(hot, np.int64).view(np.uint64)
    some = "g_all" in docs.columns

    def work(batches):
        got: list[list[np.ndarray]] = [[] for _ in range(6)]
        rows = 0
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            ks, ds = C.ints(b.column("g_k")), C.ints(b.column("g_d"))
            if some:
                lists = b.column("g_all")
                upto = lists.offsets.to_numpy()
                begin, many = (C.ints(lists.values.field(i)).astype(np.int64) for i in range(2))
            for i, j in C.runs(off):
                ask = ()
                if some:
                    x = slice(upto[i], upto[j])
                    ask = (np.repeat(np.arange(j - i), np.diff(upto[i : j + 1])), begin[x], many[x])
                a, s, doc, at, n = segments(raw[off[i] : off[j]], off[i : j + 1] - off[i], *ask)
                for to, x in zip(got, (a, s, ds[i + doc], ks[i + doc], at, n), strict=True):
                    to.append(x)
                rows += len(a)
                if rows > BATCH:
                    yield settle(*map(np.concatenate, got), earlier, hots)
                    got, rows = [[] for _ in range(6)], 0
        if rows:
            yield settle(*map(np.concatenate, got), earlier, hots)

    return C.bounded(docs).select("g_k", "g_d", "g_text", *(["g_all"] if some else [])).mapInArrow(work, ROWS)


def within(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """docs: bucketed by g_k, g_d.  The texts that `asked` names, with what it says of them; only
    `asked` moves, and each task holds its part of it."""
    return docs.join(asked.hint("shuffle_hash"), ["g_k", "g_d"])


def spans_of(found: DataFrame) -> DataFrame:
    """One row a document: its spans of repeated windows, as (first window, number)."""
    return found.where(F.col("g_kind") == SPAN).groupBy("g_k", "g_d").agg(F.collect_list(F.struct("g_at", "g_n")).alias("g_spans"))

"""Packing token sequences by minimum bin slack.

A document's ids are cut at every multiple of the window, so only its last piece is short.  How
many pieces have each length is a table of at most `window` rows.  On it, windows are filled one
after another: the longest length left opens a window, a subset-sum dynamic programme over
bitsets finds the multiset of remaining lengths that leaves least slack, and backtracking gives
the count of each length; the multiset is then used for as many windows as the counts allow.
Each use ends with one length having fewer pieces than the multiset takes, so the plan has at
most window * log2(window) multisets, whatever the corpus.  Pieces get gapless numbers within
their length and so find their window and offset in the plan.

Ids come from a public tokenizer.  Its pre-tokens (it lower-cases, drops white space, and cuts at
letters, digits and signs) are found by a scan and looked up in a table; the ids are those of the
whole text, special strings in it included.

Defined cases: a null text is an empty one, with the end id alone; a null doc_id stays null;
equal rows are packed each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 2048
END = 1
#: Strings of the vocabulary that stand for themselves in a text, as the tokenizer reads it.
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: Places in a task's table of pre-tokens, and ids that it holds at most.
SLOTS = 1 << 19
POOL = 1 << 23
PIECES = "g_k long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"

SPACE, LETTER, DIGIT, OTHER = range(4)
#: Class of each byte.  Bytes of characters beyond ASCII are letters here, and texts where that is
#: not so (ODD) go word by word through the tokenizer.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[list(C.SPACES)] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = LETTER
ODD = np.zeros(256, bool)
ODD[list(range(0x1C, 0x20))] = True  # white space to some
ODD[0x80:0xC0] = ODD[0xC4:] = ODD[0xC0:0xC3] = True


def tokenizer(path: str):
    """The tokenizer in `path`."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes lower-cased, and which of them stand for characters beyond ASCII and the letters
    from U+00C0 to U+00FF."""
    lead = raw == 0xC3
    after = np.zeros(len(raw), bool)
    after[1:] = lead[:-1]
    low = np.where((raw >= 65) & (raw <= 90) | after & (raw >= 0x80) & (raw <= 0x9E), raw + 32, raw)
    odd = ODD[raw] & ~after | after & ((raw == 0x97) | (raw == 0xB7))
    return low.astype(np.uint8), odd


def cut(low: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens: runs of letters, single digits, runs of other signs, and
    the contractions 's 't 'm 'd 're 've 'll.  edges: where texts start."""
    kind = CLASS[low]
    n = len(low)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    start[edges[edges < n]] = True
    start &= kind != SPACE
    more = np.concatenate([low, np.zeros(3, np.uint8)])
    quote = np.flatnonzero((low == 39) & start)
    if len(quote):
        edge = np.zeros(n + 4, bool)
        edge[edges] = True
        a, b = more[quote + 1], more[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & ~edge[quote + 1]
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~edge[quote + 1] & ~edge[quote + 2]
        for hit, k in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            start[q + 1] = False
            q = q[q + k + 1 < n]
            start[q + k + 1] |= kind[q + k + 1] == LETTER
    begin = np.flatnonzero(start)
    stop = np.ones(n, bool)  # whether a byte is followed by a start, a space or the end
    stop[:-1] = start[1:] | (kind[1:] == SPACE)
    stop &= kind != SPACE
    last = edges[(edges > 0) & (edges <= n)] - 1
    stop[last] = kind[last] != SPACE
    return begin, np.flatnonzero(stop) + 1


class PreTokens:
    """Ids of texts as the tokenizer gives them.

    Its pre-tokens are found by a vectorised scan and looked up in a table with a place for each
    of SLOTS hashes, where a new one replaces an old one; the ids of those that are not there come
    from the tokenizer, many at a time.  A pre-token is known by its length, its first eight bytes
    and a 64-bit hash.  Texts with characters beyond Latin letters, or with special strings, go
    through the tokenizer whole."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hash, self.head = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at, self.count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pre-tokens, one after another, and how many each has."""
        ids = np.array(self.tok.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a vocabulary without marks of a word's end
            each = [e.ids for e in self.tok.encode_batch([w.decode() for w in words], add_special_tokens=False)]
            return np.array([i for e in each for i in e], "<u4"), np.array([len(e) for e in each], np.int64)
        return ids, np.diff(ends, prepend=0)

    def learn(self, raw: bytes, begin: np.ndarray, end: np.ndarray, h: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool and counts of new pre-tokens, each given once."""
        words = [raw[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
        ids, count = self.encoded(words)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")])
        at = self.used + np.cumsum(count) - count
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        slot = (h >> np.uint64(45)).astype(np.int64)
        self.hash[slot], self.head[slot], self.at[slot], self.count[slot] = h, head, at, count
        return at, count

    def common(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts without odd characters, and how many each has."""
        if self.used > POOL:
            self.forget()
        low, _ = plain(raw)
        begin, end = cut(low, off)
        if not len(begin):
            return np.zeros(0, "<u4"), np.zeros(len(off) - 1, np.int64)
        h, head = C.hashed(low, begin, end)
        slot = (h >> np.uint64(45)).astype(np.int64)
        at, count = self.at[slot], self.count[slot].astype(np.int64)
        new = np.flatnonzero((self.hash[slot] != h) | (self.head[slot] != head))
        if len(new):
            o = new[np.lexsort((head[new], h[new]))]
            first = np.ones(len(o), bool)
            first[1:] = (h[o[1:]] != h[o[:-1]]) | (head[o[1:]] != head[o[:-1]])
            one, group = o[first], np.cumsum(first) - 1
            a, n = self.learn(low.tobytes(), begin[one], end[one], h[one], head[one])
            at[o], count[o] = a[group], n[group]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(at - (total - count), count) + np.arange(total[-1])]
        edge = np.searchsorted(begin, off)
        upto = np.append(0, total)[edge]
        return ids, np.diff(upto)

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        n = len(off) - 1
        _, odd = plain(raw)
        before = np.append(0, np.cumsum(odd))
        whole = before[off[1:]] > before[off[:-1]]
        if 124 in raw:  # a bar, as special strings have
            view = raw.tobytes()
            for d in np.flatnonzero(~whole).tolist():
                whole[d] = any(view.find(x, off[d], off[d + 1]) >= 0 for x in SPECIAL)
        if not whole.any():
            return self.common(raw, off)
        view, parts, counts = memoryview(raw), [], np.zeros(n, np.int64)
        step = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
        for i, j in zip(step.tolist(), np.append(step[1:], n).tolist(), strict=True):
            if whole[i]:
                each = [np.array(self.tok.encode(bytes(view[off[d] : off[d + 1]]).decode(), add_special_tokens=False).ids, "<u4") for d in range(i, j)]
                parts += each
                counts[i:j] = [len(e) for e in each]
            else:
                ids, counts[i:j] = self.common(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                parts.append(ids)
        return np.concatenate(parts), counts


def pieces(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    base = C.bounded(docs).select(C.doc_key(F.col(doc_id), F.col(text)).alias("g_k"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("g_text"))
    end = np.array([END], "<u4").tobytes()

    def work(batches):
        encode, schema = PreTokens(path), C.arrow_schema(PIECES)
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            keys, names = C.ints(b.column("g_k")), b.column("doc_id").to_pylist()
            for i, j in C.runs(off):
                ids, counts = encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                data, upto = memoryview(ids.tobytes()), 4 * np.append(0, np.cumsum(counts))
                rows: list[tuple] = []
                for d in range(i, j):
                    mine = bytes(data[upto[d - i] : upto[d - i + 1]]) + end
                    total = len(mine) // 4
                    for at in range(0, total, window):
                        part = mine[4 * at : 4 * (at + window)]
                        rows.append((keys[d], names[d], at, len(part) // 4, zlib.crc32(part), total, part if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return base.mapInArrow(work, PIECES)


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (longest first, `counts` of each) whose sum is nearest to room."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        steps.append((n, reach))
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        k = 0
        while not before >> at & 1:
            at -= n
            k += 1
        if k:
            used[n] = k
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """Windows to fill: how many, with how many pieces of each length."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    out = []
    while left:
        first = next(iter(left))
        left[first] -= 1
        used = fill([n for n in left if left[n]], left, window - first)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        out.append((times, used))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def packed(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """cut: rows of PIECES, staged.  Adds sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # `window` rows at most
    rows, sequence, before = [], 0, dict.fromkeys(counts, 0)
    for times, used in plan(counts, window):
        at = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            rows.append((n, before[n], before[n] + times * k, sequence, k, at))
            before[n] += times * k
            at += n * k
        sequence += times
    table = spark.createDataFrame(rows, "length int, g_lo long, g_hi long, g_first long, g_each int, g_at int")
    parts = max(16, C.partitions(spark) // 8)
    ranked = C.numbered(cut, ["length"], ["g_k", "doc_id", "start"], "g_rank", ["g_k", "start"], parts)
    near = (F.col("g_rank") >= F.col("g_lo")) & (F.col("g_rank") < F.col("g_hi"))
    found = ranked.alias("a").join(F.broadcast(table.alias("b")), (F.col("a.length") == F.col("b.length")) & near)  # the plan's size is bounded by the window
    nth = F.col("g_rank") - F.col("g_lo")
    return found.select("a.*", (F.col("g_first") + F.floor(nth / F.col("g_each"))).cast("long").alias("sequence_id"), (F.col("g_at") + (nth % F.col("g_each")) * F.col("a.length")).cast("long").alias("offset")).drop("g_rank", "g_k")


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids (null unless asked for), sequence_id,
    offset.  Sequences are to be padded to `window`, unless their length is a power of two."""
    return packed(C.stage(pieces(docs, path, window, with_ids), "pieces"), window)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    done = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return done.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")

"""Removal of repeated word strings by level-wise doubling.

The levels are strings of 4, 8, ... words, and at last windows of `length` words.  On a level,
each window that is still undecided is represented by the one of its strings with the least hash
(see repeats.py), so that equal windows have equal strings at equal places, and a part of the
places suffices.  Windows whose string is found once end there.  Stretches of windows that share a
string and are equal as a whole are settled.  What is left, where stretches around one string
differ, is extended to twice the length, until nothing is left.

Texts are dealt by document once; from level to level only the places of survivors move.

Defined cases: a null text has no words; a null doc_id sorts after every other id and is
returned as null; of equal rows or equal ids none is smaller, so they keep each other's words;
texts under `length` words keep all; other columns play no part and come back in `carried`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import repeats as R
from .suffix_dedup import cover

GRAM = 4


def levels(length: int) -> list[int]:
    """Words of the strings of each level: doubled, and cut at the window's length."""
    out = [min(GRAM, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def word_segments(length: int, gram: int = GRAM):
    """Segments by the least of their `gram`-word strings; gram = length: every window by itself."""

    def segments(raw: np.ndarray, off: np.ndarray, who: np.ndarray | None = None, begin: np.ndarray | None = None, many: np.ndarray | None = None) -> R.Segments:
        """who, begin, many: documents, first windows and numbers of the windows that count."""
        w = C.Words(raw, off)
        if len(w.start) < length:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        words, others = w.hashes(), w.hashes(times=C.M3)
        h = C.grams(words, gram)
        valid = w.doc[: len(w.doc) - length + 1] == w.doc[length - 1 :]
        if who is not None:
            step = np.zeros(len(w.start) + 1, np.int32)
            np.add.at(step, w.first[who] + begin, 1)
            np.add.at(step, w.first[who] + begin + many, -1)
            valid = valid & (np.cumsum(step)[: len(valid)] > 0)
        # a place has few bits in own(), so a long document goes in tiles that overlap
        parts = []
        for t in range(0, len(valid), C.CHUNK):
            parts.append(R.own(h[t : t + C.CHUNK + length - gram], valid[t : t + C.CHUNK], length - gram + 1))
            parts[-1][0][:] += t
            parts[-1][2][:] += t
        first, count, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        s = count.astype(np.uint64)
        size = count + length - 1
        for k in range(int(size.max()) if len(size) else 0):
            live = np.flatnonzero(size > k) if k >= length else slice(None)
            x = s[live] * C.M1 + others[first[live] + k]
            x ^= x >> np.uint64(29)
            s[live] = x
        doc = w.doc[first]
        return h[anchor], C.mix(s), doc, first - w.first[doc], count

    return segments


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """docs: g_k, g_d, g_text, bucketed.  The spans of windows that a smaller document has."""
    spans, asked = [], None
    for gram in levels(length):
        segments = word_segments(length, gram)
        hot = R.frequent(docs, segments) if asked is None else []
        rows = R.segment_rows(docs.select("g_k", "g_d", "g_text") if asked is None else R.within(docs.select("g_k", "g_d", "g_text"), asked), segments, True, hot)
        found = C.stage(R.resolve(rows, True, hot), f"words-{gram}")
        spans.append(found.where(F.col("g_kind") == R.SPAN))
        left = found.where(F.col("g_kind") == R.ASKS)
        if gram == length or left.isEmpty():
            break
        asked = left.groupBy("g_k", "g_d").agg(F.collect_list(F.struct("g_at", "g_n")).alias("g_all"))
    return R.spans_of(reduce(DataFrame.unionByName, spans))


def remove_repeats(docs: DataFrame, length: int = 13, carry: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word covered by a `length`-word window that a document of smaller id has too goes.

    Returns doc_id, carried, kept (the words left, joined by one space), n_words, n_removed,
    spans (first word, word after the last: the maximal removed runs)."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), C.carried(docs, carry).alias("carried"), F.col(text).alias("g_text"), C.doc_key(F.col(doc_id), F.col(text)).alias("g_k"), C.sort_id(F.col(doc_id)).alias("g_d"))
    base = C.bucketed(base, ["g_k", "g_d"], "texts")
    whole = base.join(repeated_spans(base, length).hint("shuffle_hash"), ["g_k", "g_d"], "left").select("doc_id", "carried", "g_text", "g_spans")
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([whole.schema["doc_id"], whole.schema["carried"], T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span_type)])

    def work(batches):
        import re

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, word = to_arrow_schema(schema), re.compile(rb"[^\x20\x09-\x0d]+")
        for b in batches:
            off, raw = C.texts(b.column("g_text"))
            view = memoryview(raw)
            kept, total, gone, where = [], [], [], []
            for i, spans in enumerate(b.column("g_spans").to_pylist()):
                words = word.findall(bytes(view[off[i] : off[i + 1]]))
                cuts = cover(spans, length)
                total.append(len(words))
                for p, q in reversed(cuts):
                    del words[p:q]
                kept.append(b" ".join(words))
                gone.append(sum(q - p for p, q in cuts))
                where.append([{"start": p, "stop": q} for p, q in cuts])
            cols = [b.column("doc_id"), b.column("carried"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, arrow.field("spans").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return whole.mapInArrow(work, schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

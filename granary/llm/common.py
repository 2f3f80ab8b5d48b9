"""Shared pieces: staged tables, row keys, gapless numbering and batch views."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of other characters.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a pattern for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Sort key of a row without doc_id: after every other.
NO_ID = 2**63 - 1
#: Bytes that one vectorised step works on; its arrays stay in the processor's cache.
CHUNK = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; in the warehouse, which
    they share too, where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/granary-staging"
    return found.rstrip("/")


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, and a lost executor
    costs a re-read.  The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    deleted_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """As stage(), dealt by the keys once: joins on them move the other side only."""
    spark = df.sparkSession
    n, table = partitions(spark), f"granary_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/granary/{table}"
    bounded(df).repartition(n, *keys).write.bucketBy(n, *keys).option("compression", "zstd").option("path", path).saveAsTable(table)
    deleted_at_exit(spark, path)
    return spark.table(table)


#: Rows and bytes of an Arrow batch, and rows of a Parquet reader's batch, for texts.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def bounded(df: DataFrame) -> DataFrame:
    """Sees to it that a batch of texts stays small in readers and Python workers, where the
    session does not say how large a batch is."""
    conf = df.sparkSession.conf
    for name, value in SMALL.items():
        if conf.get(name, None) is None:
            conf.set(name, value)
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key(doc_id: Column, text: Column) -> Column:
    """Never-null key of a row; only rows equal in id and text share both it and the id."""
    return F.xxhash64(doc_id.cast("long"), text)


def sort_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def real_id(column: Column) -> Column:
    """Undoes sort_id()."""
    return F.when(column != NO_ID, column)


def about(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About `rows` rows of `df` (all, if there are fewer), chosen by a hash of `by`: no row moves,
    and a rerun chooses the same.  Rows with equal `by` are chosen together."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), *[F.col(c) for c in by]), F.lit(1_000_000_007)) < rows * 1_000_000_007 // n)


#: A key with more than one of so many rows is hot; there are at most so many.
HOT = 1000


def joined_by_size(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns of `table` (a row for each key, staged; `count`: how many of `total`
    rows have it).  What hot keys have is sent to every task, so that none gathers such a key's
    rows; the rest meets by key."""
    hot = table.where(F.col(count) > total // HOT).drop(count)  # under HOT rows
    names = [c for c in table.columns if c not in (key, count)]
    known = rows.join(F.broadcast(hot.select(key, F.struct(*names).alias("g_hot"))), key, "left")
    near = known.where("g_hot is not null").select(*rows.columns, *[F.col(f"g_hot.{c}").alias(c) for c in names])
    rest = known.where("g_hot is null").select(*rows.columns).join(table.where(F.col(count) <= total // HOT).drop(count), key)
    return near.unionByName(rest)


def carried(df: DataFrame, keep: list[str] | None) -> Column:
    """The columns that the caller wants back, as one struct, so that no name can clash."""
    names = keep or []
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("struct<nothing:boolean>")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, salt: list[str], parts: int = 256) -> DataFrame:
    """Gapless numbers from 0 within each `by`, whatever a group's size: groups are split into
    `parts` by a hash of `salt`, counted, and each split numbered after the ones before it.

    The count table has at most groups x parts rows.  Groups are numbered split by split, in
    the splits by `order`."""
    from pyspark.sql import Window

    cut = df.withColumn("g_part", F.pmod(F.xxhash64(*[F.col(c) for c in salt]), F.lit(parts)))
    counts = cut.groupBy(*by, "g_part").agg(F.count(F.lit(1)).alias("g_n"))
    before = Window.partitionBy(*by).orderBy("g_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "g_part", F.coalesce(F.sum("g_n").over(before), F.lit(0)).alias("g_start"))
    within = Window.partitionBy(*by, "g_part").orderBy(*order)
    local = cut.withColumn("g_local", F.row_number().over(within) - 1)
    return local.join(starts, [*by, "g_part"]).withColumn(name, F.col("g_start") + F.col("g_local")).drop("g_part", "g_local", "g_start")


def arrow_schema(ddl: str) -> pa.Schema:
    """For columns of plain types; works without a session, as in Python workers."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, raw


def runs(off: np.ndarray, limit: int = CHUNK):
    """Ranges of documents of about `limit` bytes together; one longer document is its own range."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to
        at = to


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; in place."""
    h ^= h >> np.uint64(31)
    h *= M2
    h ^= h >> np.uint64(29)
    return h


class Words:
    """The words of some documents: start, end and document of each, and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, gaps: np.ndarray | None = None):
        """raw: bytes; off: the documents' offsets in it, from its start; gaps: whether each
        byte parts words."""
        n = len(raw)
        if gaps is None:
            gaps = np.zeros(256, bool)
            gaps[list(SPACES)] = True
        gap = gaps[raw]
        before = np.ones(n + 1, bool)
        before[1:] = gap
        edge = off[(off < n)]
        first = before[:n].copy()
        first[edge] = True
        first &= ~gap
        last = np.ones(n, bool)
        last[:-1] = gap[1:]
        last[edge[edge > 0] - 1] = True
        last &= ~gap
        self.raw = raw
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.start, off)  # of each document's first word

    def hashes(self, fold: bool = False, cut: int | None = None, times: np.uint64 = M1) -> np.ndarray:
        """fold: A-Z as a-z; cut: of so many leading bytes at most; times: an odd factor, of which
        another makes another hash."""
        raw = self.raw
        if fold:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        return hashed(raw, self.start, self.end, cut, times)[0]


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray, cut: int | None = None, times: np.uint64 = M1) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of many byte ranges, and their first eight bytes; cut, times: as in
    Words.hashes."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    view = np.ndarray((len(raw) + 8,), np.uint64, buffer=padded.data, strides=(1,))
    size = (end - start).astype(np.uint64)
    if cut is not None:
        size = np.minimum(size, np.uint64(cut))
    h = size * M2
    at, left, who, head = start, size.astype(np.int64), None, None
    while True:
        drop = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
        got = (view[at] << drop) >> drop
        if who is None:
            head = got
            h = mix((h ^ got) * times)
        else:
            h[who] = mix((h[who] ^ got) * times)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h, head
        at, left, who = at[more] + 8, left[more] - 8, more if who is None else who[more]


def grams(h: np.ndarray, n: int, times: np.uint64 = M1) -> np.ndarray:
    """Hashes of n consecutive hashes, at each start; times: as in Words.hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    x = h[:m].copy()
    for k in range(1, n):
        x *= times
        x += h[k : k + m]
    return mix(x)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == w else np.minimum(x[: len(x) - (w - span)], x[w - span :])

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words, at most `most` times its own size; what a
capped source leaves is shared again by weight.  Targets come from one pass over the sources
sorted by cap over weight: the sources before a point are capped, the others share the rest.

Each source gives floor(target / size) complete epochs.  What remains is drawn without
replacement: document keys -ln(u) / quality, u from a hash of doc_id, ascending, prefix-summed
until the budget is spent; the document at the border gives its first words.  A source of any
size is sorted in some thousand ranges of the key, whose sums are prefix-summed first.

Quality lies in (0, 1]: one over one plus ten times the symbols a word.

Defined cases: a null text has no words; a null source is a source, last in order; a null doc_id
draws by the text alone; equal rows are drawn alike, each for itself; a source without words has
target 0; an empty table gives an empty result; other columns come back in `carried` if asked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS, TAIL, OCTAVE = 4096, 4.0, 512
SYMBOLS = "#*$%&|<>"


def n_words(text: Column) -> Column:
    """Words of a text: places where one starts."""
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def quality(text: Column, words: Column) -> Column:
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return 1.0 / (1.0 + 10.0 * F.coalesce(symbols, F.lit(0)) / F.greatest(words, F.lit(1)))


def bucket(key: Column) -> Column:
    """The range of a key: any monotone map does.  This one evens out exponential keys of good
    documents, and parts those from TAIL on, where bad ones are, by their logarithm."""
    edge = int((1.0 - math.exp(-TAIL / 2.0)) * BUCKETS) + 1
    return F.when(key < TAIL, F.floor((1.0 - F.exp(-key / 2.0)) * BUCKETS)).otherwise(edge + F.floor(F.log2(key / TAIL) * OCTAVE)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, source_size (one row a source).  Adds target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source: a small table
    nth = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1))
    weighed = weighed.withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    past = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(past), F.lit(0.0))
    level = rest / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(past), F.lit(0.0)))
    stepped = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    # the first source that its share does not cap sets the level for itself and all after it
    final = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    return stepped.select("source", "source_size", F.when(F.col("free"), F.least(F.col("cap"), final * F.col("w"))).otherwise(F.col("cap")).alias("target"))


def mixed(docs: DataFrame, carry: list[str] | None = None, weights: Sequence[int] = WEIGHTS, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, carried."""
    words = n_words(F.col(text))
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))), 1, 13), 16, 10).cast("double") + 1.0) / 4503599627370497.0
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words.alias("size"), F.xxhash64(F.col(text)).alias("g_text"), u.alias("g_u"), quality(F.col(text), words).alias("g_q"), C.carried(docs, carry).alias("carried"))
    base = base.withColumn("g_key", -F.log("g_u") / F.col("g_q")).drop("g_u", "g_q")
    base = C.stage(base, "words")
    base = base.withColumn("g_bucket", bucket(F.col("g_key")))
    by = base.groupBy("source", "g_bucket").agg(F.sum("size").alias("g_words"))
    sizes = by.groupBy("source").agg(F.sum("g_words").alias("source_size"))
    aims = targets(sizes, weights, most)
    before = Window.partitionBy("source").orderBy("g_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by.select("source", "g_bucket", F.coalesce(F.sum("g_words").over(before), F.lit(0)).alias("g_before"))
    starts = starts.join(aims, starts["source"].eqNullSafe(aims["source"])).select(starts["source"].alias("g_source"), F.col("g_bucket").alias("g_b"), "g_before", "source_size", "target")
    within = Window.partitionBy("source", "g_bucket").orderBy("g_key", "doc_id", "g_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("g_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, rows["source"].eqNullSafe(F.col("g_source")) & (rows["g_bucket"] == F.col("g_b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("g_before") - F.col("g_in")))
    taken = (epochs * F.col("size") + part).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "carried")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")

"""A training corpus from `documents`, in five stages.

Each stage takes the whole table that its predecessor kept; all but the last return the columns
of `documents`.  Between stages the table is written as Parquet and read again.

In every stage: a null text counts as empty and stays null where a stage does not rewrite it; a
null doc_id, lang or source is a value like another and comes back as null; equal rows are
documents each, where the stage does not say otherwise; further columns, whatever their names,
play no part and are left behind; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import mixing, packing, simhash, suffix_dedup, toxicity
from granary.llm.common import WORD, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.  One without words scores by the bias and stays.
    Without labels nothing is learned, and all stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near-duplicates stays: texts whose sets
    of five-word shingles have a Jaccard similarity of 0.8 or more, directly or by a chain.  Texts
    without words are one group; of rows equal in id and text one stays, the same in any order; a
    null id is the greatest."""
    return simhash.one_each(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes covered by 200-byte strings that start twice or more; a document
    that loses all stays, with an empty text, as does one whose text is null.  The rests of a
    character that was cut go with it."""
    done = suffix_dedup.remove_repeats(docs, carry=["lang", "source"], decode=True)
    return done.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's border by its first words.
    A document without words is taken no times, so it goes.  Equal rows are taken alike."""
    done = mixing.mixed(docs, carry=["text", "lang"])
    text, whole = F.col("carried.text"), F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), rest), " ")
    copies = F.concat(F.array_repeat(text, whole), F.when(rest > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    rows = done.where("taken > 0").select("doc_id", F.explode(copies).alias("text"), F.col("carried.lang").alias("lang"), "source")
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each with its place in a packed one.  A document without text is
    a piece of the end id alone."""
    return packing.pack(docs, packing.default_tokenizer()).drop("ids")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("sequences", sequences)]

#: The learned model, the suffix arrays' byte strings and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

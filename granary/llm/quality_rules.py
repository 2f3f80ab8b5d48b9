"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Each document gets whole-number rates (hundredths of a character a word; symbols, repeated lines
and repeated words a thousand words).  Per language and source every rate has a quantile sketch of
the documents that pass the base rules: a histogram with exact small values and then 16 (for
characters a word 256) bins for each power of two, so a value is known to 1/16 (1/256) of itself.
Sketches merge by adding counts; a group under LEAST documents takes its language's merged
sketch, and if that is small too, everyone's.

A threshold is where a group's values end: the least value from the third quartile on above which
the sketch is all but empty (STRAYS of the documents) as far as GAP times that value.  What lies
beyond is not the tail of the group's own values.  No cutoff is given; a group whose documents
have many symbols gets a high threshold for symbols.  Characters a word have a lower threshold
too, found downwards from the first quartile.  A document stays if no base rule and no threshold
fails it.

Two three-word windows count as equal if their 64-bit hashes are.

Defined cases: a null text has no words and fails the base rules; null lang and source are
groups of their own; a null doc_id stays null; equal rows are judged alike; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAST = 200
#: Documents that may lie in an empty stretch: one in so many.
STRAYS = 500
#: How far beyond a rate's threshold nothing lies, as a multiple.
GAP = {"r_chars": 1.25, "r_symbols": 16, "r_lines": 16, "r_repeats": 16}
#: Leading bits of a value that its bin keeps.
BITS = {"r_chars": 9, "r_symbols": 5, "r_lines": 5, "r_repeats": 5}
#: Rates with a lower threshold.
BOTH = ("r_chars",)
LIMITS = [f"high_{r}" for r in GAP] + [f"low_{r}" for r in BOTH]
BETWEEN = r"[\x20\x09-\x0D]+"


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(C.WORD))
    split = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), "lang", "source",
        F.array_remove(F.split(body, BETWEEN), "").alias("words"), lines.alias("lines"),
        F.coalesce(F.regexp_count(body, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
    )
    # windows: hash of the words i, i+1, i+2
    hashed = split.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) >= 3 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE array() END").cast("array<bigint>").alias("w"),
    )
    # sorted (hash, place) pairs in one number: the place in the low bits
    keyed = hashed.withColumn("k", F.length(F.bin(F.size("w"))))
    ordered = keyed.withColumn("s", F.expr("sort_array(transform(w, (h, i) -> shiftleft(shiftrightunsigned(h, k + 1), k) | cast(i AS bigint)))"))
    same = "shiftright(x, k) = shiftright(s[{0}], k) AND w[cast(x & (shiftleft(1L, k) - 1) AS int)] = w[cast(s[{0}] & (shiftleft(1L, k) - 1) AS int)]"
    twice = ordered.withColumn("p", F.expr(f"transform(filter(s, (x, i) -> (i > 0 AND {same.format('i - 1')}) OR (i < size(s) - 1 AND {same.format('i + 1')})), x -> x & (shiftleft(1L, k) - 1))"))
    covered = F.size(F.array_distinct(F.expr("flatten(transform(p, x -> array(x, x + 1, x + 2)))"))).cast("long")
    return twice.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines")


def rates(m: DataFrame) -> DataFrame:
    """Adds the rates and base_failed."""
    per = lambda x, n: F.expr(f"({n} * {x}) div greatest(n_words, 1)")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumns({"r_chars": per("word_chars", 100), "r_symbols": per("n_symbols", 1000), "r_lines": per("n_dup_lines", 1000), "r_repeats": per("n_repeat_words", 1000), "base_failed": base})


def to_bin(v: Column, bits: int = 5) -> Column:
    """The bin of a whole number from 0: exact under 2**bits, then by its leading `bits` bits."""
    shift = F.greatest(F.length(F.bin(v)) - bits, F.lit(0))
    return (shift * (1 << (bits - 1)) + F.call_function("shiftright", v, shift)).cast("int")


def of_bin(b: Column, bits: int = 5, least: bool = False) -> Column:
    """The greatest (or least) value in a bin."""
    half = 1 << (bits - 1)
    shift = F.greatest(F.floor(b / half) - 1, F.lit(0)).cast("int")
    low = F.call_function("shiftleft", (b - shift * half).cast("long"), shift)
    return low if least else low + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1


def sketches(rated: DataFrame) -> DataFrame:
    """rated: staged, as its columns are used many times.  lang, source, rate, bin, n, of the
    documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(r).alias("rate"), to_bin(F.col(r), BITS[r]).alias("bin")) for r in GAP])
    long = rated.where(~F.col("base_failed")).select("lang", "source", F.explode(each).alias("x"))
    return long.groupBy("lang", "source", "x.rate", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def edge(rate: str, up: bool) -> Column:
    """The threshold of a rate, from `bins` (structs of bin, n and seen, the count up to the bin;
    ascending, a few hundred at most) and `total`."""
    bits, gap = BITS[rate], GAP[rate]
    bins = F.col("bins") if up else F.reverse("bins")

    def ends(x: Column) -> Column:
        if up:
            far = to_bin(F.floor((of_bin(x["bin"], bits) + 1) * gap).cast("long"), bits)
            there = F.filter("bins", lambda y: (y["bin"] > x["bin"]) & (y["bin"] < far))
            begun = x["seen"] * 4 >= F.col("total") * 3
        else:
            far = to_bin(F.floor(of_bin(x["bin"], bits, True) / gap).cast("long"), bits)
            there = F.filter("bins", lambda y: (y["bin"] < x["bin"]) & (y["bin"] > far))
            begun = (x["seen"] - x["n"]) * 4 <= F.col("total")
        strays = F.aggregate(there, F.lit(0).cast("long"), lambda a, y: a + y["n"])
        return begun & (strays * STRAYS <= F.col("total"))

    return of_bin(F.element_at(F.filter(bins, ends), 1)["bin"], bits, not up)


def thresholds(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, docs, and the LIMITS."""
    up_to = Window.partitionBy(*by, "rate").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sketch.withColumn("seen", F.sum("n").over(up_to))
    whole = seen.groupBy(*by, "rate").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bin", "n", "seen"))).alias("bins"))
    at = lambda r, up: F.max(F.when(F.col("rate") == r, edge(r, up)))
    return whole.groupBy(*by).agg(F.max("total").alias("docs"), *[at(r, True).alias(f"high_{r}") for r in GAP], *[at(r, False).alias(f"low_{r}") for r in BOTH])


def limits(rated: DataFrame) -> DataFrame:
    """rated: staged.  a_lang, a_source and t, the group's LIMITS: its own, its language's or
    everyone's."""
    fine = C.stage(sketches(rated), "sketches")

    def level(by: list[str], name: str) -> DataFrame:
        t = thresholds(merged(fine, by) if len(by) < 2 else fine, by)
        return t.select(*[F.col(c).alias(f"{name}_{c}") for c in by], F.struct("docs", *LIMITS).alias(name))

    pair, lang = level(["lang", "source"], "a"), level(["lang"], "b")
    whole = level([], "c").first()  # one row, if there is any
    everyone = F.struct(*[F.lit(whole["c"][x] if whole else None).cast("long").alias(x) for x in ("docs", *LIMITS)])
    known = pair.join(lang, pair["a_lang"].eqNullSafe(lang["b_lang"]), "left")
    rule = F.when(F.col("a.docs") >= LEAST, F.col("a")).when(F.col("b.docs") >= LEAST, F.col("b")).otherwise(everyone)
    return known.select("a_lang", "a_source", rule.alias("t"))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """measured() and rates() with kept."""
    rated = C.stage(rates(measured(docs, doc_id, text)), "rates")
    known = limits(rated)
    found = rated.join(known, rated["lang"].eqNullSafe(F.col("a_lang")) & rated["source"].eqNullSafe(F.col("a_source")), "left")
    fine = F.lit(True)
    for r in GAP:
        fine = fine & (F.col(r) <= F.col(f"t.high_{r}"))
    for r in BOTH:
        fine = fine & (F.col(r) >= F.col(f"t.low_{r}"))
    return found.select(*rated.columns, (~F.col("base_failed") & F.coalesce(fine, F.lit(False))).alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    done = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

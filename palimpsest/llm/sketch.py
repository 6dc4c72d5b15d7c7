"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
sketches of any two texts are samples of the same part of the hash space: they
merge by union and estimate containment however unequal the texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import common

SHINGLE = 5
#: The fraction of the hash range that is kept.
FRACTION = 0.25
#: Rows of a range of ids that are ordered together, and the quantiles that ranges are cut from.
RANGE_ROWS, QUANTILES = 1000, 64


def words_of(text: Column) -> Column:
    """The runs without white space of a text with A-Z lower-cased."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def sketch_of(words: Column, fraction: float = FRACTION, size: int = SHINGLE) -> Column:
    """Sorted distinct 64-bit hashes below `fraction` of the range, of the shingles of `size` words. With fewer words
    the whole sequence is one shingle; without words the sketch is empty."""
    below = int((fraction * 2.0 - 1.0) * (1 << 63)) if fraction < 1 else (1 << 63) - 1
    n = F.size(words)
    long = F.transform(
        F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))),
        lambda i: F.xxhash64(*(F.get(F.col("__h"), i + (k - 1)) for k in range(size))),
    )
    made = F.when(n >= size, long).when(n > 0, F.array(F.xxhash64(F.col("__h")))).otherwise(F.array().cast("array<long>"))
    return F.array_sort(F.array_distinct(F.filter(made, lambda h: h <= below)))


def with_sketch(df: DataFrame, text: str, name: str, fraction: float = FRACTION) -> DataFrame:
    """Adds the sketch of column `text` (null: empty) as array<long> `name`."""
    words = df.withColumn("__w", words_of(F.coalesce(F.col(text), F.lit(""))))
    hashed = words.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    return hashed.withColumn(name, sketch_of(F.col("__w"), fraction)).drop("__w", "__h")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column, equal: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other has too. `equal` (the texts are the same) decides
    where a sketch is empty."""
    both = F.size(F.array_intersect(a, b))
    least = F.least(F.size(a), F.size(b))
    return F.when(equal, F.lit(1.0)).when(least > 0, both / least).otherwise(F.lit(0.0))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), " ")


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, n_chars, and `ghost` rows, parted by `__range` so that within a range, by key and digest downward, each
    row is followed by the next of the whole table (the last by the first). Ghosts end ranges: copies of the row that
    comes after, with n_chars null. Null keys come last, as the lowest. Ties go by length and hash of the text."""
    base = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    info = base.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q")).first()
    cuts = sorted(set(info["q"] or []))
    # A range is a quantile's, cut evenly by the key into parts of about RANGE_ROWS rows.
    parts = max(1, -(-(info["n"] or 0) // (RANGE_ROWS * max(1, len(cuts) - 1))))
    if len(cuts) > 1:
        lows = F.array(*(F.lit(c).cast("long") for c in cuts))
        at = F.size(F.filter(lows, lambda c: c <= keyed))
        low, high = F.get(lows, at - 1), F.get(lows, at)
        inner = F.floor((F.col("doc_id").cast("double") - low) / (high.cast("double") - low) * parts)
        found = F.when(F.col("doc_id").isNull() | (at == 0), F.lit(-1)).when(at >= len(cuts), F.lit(len(cuts) * parts)).otherwise(at * parts + F.least(inner, F.lit(parts - 1)))
        ranged = base.withColumn("__range", found.cast("long"))
    else:
        ranged = base.withColumn("__range", F.lit(0).cast("long"))
    order = F.struct(keyed.alias("k"), F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    ranged = ranged.withColumn("__order", order)
    # The first row of each range; it follows the last row of the range above (the top range's: of the lowest range).
    tops = ranged.groupBy("__range").agg(F.max_by(F.struct("doc_id", "text", "__order"), "__order").alias("top"))
    # Ranges are chained within runs of RANGE_ROWS of them, and runs among themselves: a row for a million rows.
    names = tops.select("__range", F.floor(F.col("__range") / RANGE_ROWS).alias("__run"))
    runs = names.groupBy("__run").agg(F.min("__range").alias("low"))
    outer = Window.partitionBy(F.lit(0)).orderBy(F.desc("__run"))
    whole = outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("__run", F.coalesce(F.lag("low").over(outer), F.last("low").over(whole)).alias("__low"))
    chain = Window.partitionBy("__run").orderBy(F.desc("__range"))
    inner = names.withColumn("__lag", F.lag("__range").over(chain)).join(runs, "__run")
    above = inner.select(F.col("__range").alias("__from"), F.coalesce("__lag", "__low").alias("__above"))
    ghosts = tops.join(above, tops["__range"] == above["__from"]).select("top.doc_id", "top.text", F.col("__above").alias("__range"), "top.__order", F.lit(True).alias("ghost"))
    return ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, next_text, edited_text: the text with its last third replaced by as many first characters of the
    next text (or all), in descending order of the key, the first after the last. One row: its own next."""
    order = Window.partitionBy("__range").orderBy("ghost", F.desc("__order"))
    rows = with_next(df, key, text).withColumn("next_text", F.lead("text").over(order))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    return rows.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))


def fingerprints(df: DataFrame, fraction: float = FRACTION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    Null texts are empty. Equal texts have equal fingerprints and a likeness of 1. Repeated keys and null keys are kept
    and ordered as in with_next. An empty table gives no rows.
    """
    order = Window.partitionBy("__range").orderBy("ghost", F.desc("__order"))
    rows = with_sketch(with_sketch(edited(df, key, text), "text", "sketch", fraction), "edited_text", "edited_sketch", fraction)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("ghost"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited_text")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text")).alias("near_next"),
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.load(spark, sf_dir, "documents").select("doc_id", "text"))
